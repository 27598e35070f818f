from __future__ import annotations

import random

import pytest

from textloom.llm.topn import top_n_per_group


def brute(rows, n):
    best = {}
    for g, item, s in rows:
        if g is not None and s is not None:
            best[g, item] = max(s, best.get((g, item), s))
    groups = {}
    for (g, item), s in best.items():
        groups.setdefault(g, []).append((-s, tuple((x is not None, x if x is not None else "") for x in item), item))
    return {(g, item, -s, r) for g, x in groups.items() for r, (s, _, item) in enumerate(sorted(x)[:n], 1)}


@pytest.mark.parametrize("salts", [1, 7])
def test_equals_brute_force(spark, salts):
    pick = random.Random(8)
    rows = [("hot", (f"t{pick.randint(0, 300)}", pick.choice(["a", "b", None])), pick.choice([1, 2, 2, 3, None])) for _ in range(2000)]
    rows += [(pick.choice(["x", "y", None, f"g{pick.randint(0, 50)}"]), (f"t{pick.randint(0, 3)}", "a"), pick.randint(-5, 5)) for _ in range(500)]
    rows += [("ties", (f"é{i}", None), 7) for i in range(20)] * 2
    df = spark.createDataFrame([(g, a, b, s, 0) for g, (a, b), s in rows], "g string, a string, b string, s int, __r int")
    got = [tuple(r) for r in top_n_per_group(df, "g", ["a", "b"], "s", 5, salts).collect()]
    assert {(g, (a, b), s, r) for g, a, b, s, r in got} == brute(rows, 5) and len(got) == len(brute(rows, 5))


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "g string, a string, s int")
    assert top_n_per_group(df, "g", ["a"], "s").count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "g", ["a"], "s", 0)
