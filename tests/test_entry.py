from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from textloom.plans import search_queries

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_seed_occurrences_of_every_length(spark):
    got = {r["gram"]: (r["gram_size"], r["occurrences"], r["position_sum"]) for r in contract.queries()["seed_occurrences"](spark, SMALL).collect()}
    seeds = {r["text"] for r in spark.read.parquet(f"{SMALL}/seed_candidates.parquet").collect() if r["text"]}
    texts = [r["normalized_text"] or "" for r in spark.read.parquet(f"{SMALL}/prepared_sentences.parquet").collect()]
    want = {}
    for seed in seeds:
        at = [i for t in texts for i in range(len(t)) if t.startswith(seed, i)]
        if at:
            want[seed] = (len(seed), len(at), sum(at))
    assert got == want and max(map(len, want)) > 3


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_generated_queries_are_searched(spark):
    folder = SMALL.replace("0.001", "0.01")
    ids = {f"q{i:08}" for i in range(50, 401, 50)}
    asked = [r["query_id"] for r in search_queries.asked(spark, folder).collect()]
    assert ids == {i for i in asked if i.startswith("q")} and len(asked) == len(set(asked)) == 48 + len(ids)
    assert ids & {r["query_id"] for r in contract.queries()["complete"](spark, folder).collect()}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "completed_sentence", "source_text", "line_no", "score", "rank"] and df.count() > 0
