from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F
from reference_definition import compare

from textloom.operators import verify


def test_closed_form_equals_the_definition(spark):
    texts = ["".join(x) for n in range(1, 7) for x in product("ab", repeat=n)] + ["éab", "ééé", "aéé", "éé"]
    pairs = [(i, q, t, 0) for i, (q, t) in enumerate((q, t) for q in texts if len(q) <= 5 for t in texts if len(t) <= len(q) + 1)]
    rows = spark.createDataFrame(pairs, "id long, q string, t string, match_start int")
    want = set()
    for i, q, t, _ in pairs:
        for size in (len(q) - 1, len(q), len(q) + 1):
            if 0 < size <= len(t):
                want |= {(i, 0, *x) for x in compare(q, t[:size])}
    got = [tuple(r) for r in verify.verified(rows, ["id"], 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plain = rows.select("id", F.inline(verify.matches_at(F.col("q"), F.col("t")))).collect()
    assert {(r[0], 0, *r[1:]) for r in plain} == want
