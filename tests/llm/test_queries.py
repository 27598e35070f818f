from __future__ import annotations

import os

import pytest

from textloom.llm import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["field_name", "term_value"], "p2_found": ["sentence_id_a", "sentence_id_b"], "p4_found": ["table_name", "record_id"], "p5_found": ["query_id", "source_text", "line_no"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.queries()[name](spark, SMALL)
    assert df.columns == COLUMNS[name] and df.count() >= 0
