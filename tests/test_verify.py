from __future__ import annotations

from itertools import product

import pytest
from pyspark.sql import functions as F
from reference_definition import compare

from textloom.operators import ranking, verify

CASES = [
    ("python", "python", [("exact", None, 6)]),
    ("pythom", "python", [("replacement", 5, 5)]),
    ("pyton", "python", [("insertion", 3, 5)]),
    ("pythhon", "python", [("deletion", 3, 6), ("deletion", 4, 6)]),
    ("aa", "aaa", [("insertion", 0, 2), ("insertion", 1, 2), ("insertion", 2, 2)]),
    ("aaa", "aa", [("deletion", 0, 2), ("deletion", 1, 2), ("deletion", 2, 2)]),
    ("ython", "python", [("insertion", 0, 5)]),
    ("pytho", "python", [("insertion", 5, 5)]),
    ("programing", "programming", [("insertion", 6, 10), ("insertion", 7, 10)]),
    ("pyxxom", "python", []),
    ("a", "", []),
    ("", "a", []),
    ("abc", "abcde", []),
]


def matches(spark, pairs):
    rows = spark.createDataFrame(pairs, "q string, t string")
    return [[tuple(x) for x in r["m"]] for r in rows.select(verify.compare(F.col("q"), F.col("t")).alias("m")).collect()]


def test_cases(spark):
    assert matches(spark, [(q, t) for q, t, _ in CASES]) == [want for *_, want in CASES]


def test_every_pair_over_a_small_alphabet(spark):
    texts = ["".join(x) for n in range(5) for x in product("ab ", repeat=n)]
    pairs = [(q, t) for q in texts for t in texts if abs(len(q) - len(t)) <= 2 and len(q) <= 3]
    assert matches(spark, pairs) == [compare(q, t) for q, t in pairs]


def test_may_match_loses_nothing(spark):
    texts = ["".join(x) for n in range(1, 6) for x in product("ab", repeat=n)]
    pairs = [(q, t) for q in texts if len(q) <= 4 for t in texts if len(t) <= len(q) + 1]
    rows = spark.createDataFrame(pairs, "q string, t string")
    lost = rows.where(~verify.may_match(F.col("q"), F.col("t")) & (F.size(verify.matches_at(F.col("q"), F.col("t"))) > 0))
    assert lost.count() == 0


@pytest.mark.parametrize(
    "kind,index,correct,want",
    [("exact", None, 6, 12), ("replacement", 0, 5, 5), ("replacement", 4, 5, 9), ("insertion", 0, 6, 2), ("deletion", 2, 5, 4), ("deletion", 3, 11, 18), ("replacement", 9, 5, 9), ("insertion", 7, 6, 10), ("replacement", 0, 0, -5)],
)
def test_scores(spark, kind, index, correct, want):
    row = spark.createDataFrame([(kind, index, correct)], "e string, i int, c int")
    assert row.select(ranking.score(F.col("e"), F.col("i"), F.col("c"))).first()[0] == want
