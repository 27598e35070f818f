from __future__ import annotations

import random

from textloom.operators import search


def test_cheapest_pair_equals_brute_force(spark):
    pick = random.Random(12)
    seeds, want = [], {}
    for query in range(40):
        for size in (1, 2, 3):
            m = pick.randint(0, 9)
            freq = [pick.randint(0, 3) for _ in range(max(0, m - size + 1))]
            seeds += [(query, "x" * 9, size, f"g{i}", i, f) for i, f in enumerate(freq)]
            pairs = [(a + b, i, j) for i, a in enumerate(freq) for j, b in enumerate(freq) if i + size <= j]
            if pairs:
                want[query, size] = min(pairs)
    df = spark.createDataFrame(seeds, "query_id int, q string, gram_size int, gram string, query_start int, frequency long")
    rows = search.anchor_pairs(df).collect()
    assert {(r["query_id"], r["gram_size"]): (r["cost"], r["first_start"], r["second_start"]) for r in rows} == want
    assert all(r["first_gram"] == f"g{r['first_start']}" and r["second_gram"] == f"g{r['second_start']}" for r in rows)
    plan = {r["query_id"]: (r["cost"], r["gram_size"]) for r in search.anchor_plan(search.anchor_pairs(df)).collect()}
    best: dict = {}
    for (query, size), (cost, *_) in want.items():
        best[query] = min(best.get(query, (10**9, 0)), (cost, -size))
    assert plan == {q: (c, -s) for q, (c, s) in best.items()}
