from __future__ import annotations

import hashlib
import os
import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluate, workload
from textloom.operators.numbering import row_numbers
from textloom.plans import evaluate_queries


def test_nearest_rank(spark):
    pick = random.Random(1)
    for n in (1, 2, 7, 20, 99):
        values = [pick.randint(0, 50) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v int")
        got = df.agg(*[evaluate.disc("v", p).alias(f"p{p}") for p in (25, 50, 95, 99)]).first()
        assert list(got) == [sorted(values)[max(0, ceil(n * p / 100) - 1)] for p in (25, 50, 95, 99)]


def test_latency_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in evaluate.latency_summary(df, ["k"], "v").collect()}
    assert got["a"]["stdev"] == 0 and got["a"]["p95"] is None and got["b"]["median"] == 2 and got["b"]["n"] == 2


def test_wins_speedups_and_break_even(spark):
    rows = [("q1", "naive", 100.0), ("q1", "fast", 10.0), ("q2", "naive", 50.0), ("q2", "fast", 50.5), ("q1", "slow", 200.0), ("q2", "slow", 200.0)]
    m = spark.createDataFrame(rows, "query_id string, algorithm_id string, median double")
    wins = {r["algorithm_id"]: (r["wins"], r["ties"], r["split_wins"]) for r in evaluate.win_rates(m).collect()}
    assert wins == {"naive": (0, 1, 0.5), "fast": (1, 1, 1.5), "slow": (0, 0, 0.0)}
    speed = {r["algorithm_id"]: (r["best"], round(r["worst"], 3)) for r in evaluate.speedups(m, "naive").collect()}
    assert speed == {"fast": (10.0, round(50 / 50.5, 3)), "slow": (0.5, 0.25)}
    builds = spark.createDataFrame([("naive", 1.0), ("fast", 900.0), ("slow", 9.0)], "algorithm_id string, build double")
    assert {r["algorithm_id"]: r["queries"] for r in evaluate.break_even(m, builds, "naive").collect()} == {"fast": ceil(899 / 44.75), "slow": None}


def test_multiset_comparison(spark):
    a = spark.createDataFrame([("q", 1), ("q", 1), ("q", 2), ("r", 1)], "query_id string, v int")
    b = spark.createDataFrame([("q", 1), ("q", 3)], "query_id string, v int")
    got = {r["query_id"]: tuple(r)[1:] for r in evaluate.compare_results(a, b, ["query_id", "v"]).collect()}
    assert got == {"q": (2, 1, 1), "r": (1, 0, 0)}
    one = evaluate.signature(a, ["v"]).collect()
    assert sorted(one) == sorted(evaluate.signature(a.orderBy(F.desc("v")), ["v"]).collect())
    assert evaluate.missing_pairs(spark.createDataFrame([("q", "x")], "query_id string, algorithm_id string"), a.select("query_id").distinct(), ["x", "y"]).count() == 3


def test_naive_work(spark):
    q = spark.createDataFrame([("a", "abc"), ("b", "x"), ("c", "")], "query_id string, q string")
    s = spark.createDataFrame([(0, "abcd"), (1, "ab"), (2, None)], "sentence_id long, n string")
    want = {i: sum(max(0, n - size + 1) for n in (4, 2) for size in (m - 1, m, m + 1) if size > 0) for i, m in (("a", 3), ("b", 1))}
    assert {r["query_id"]: r["verifier_calls"] for r in evaluate.naive_work(q, s).collect()} == want


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int")
    assert sorted((r["v"], r["n"]) for r in row_numbers(df, ["v"], "n").collect()) == [(i, i) for i in range(1000)]
    assert row_numbers(df.limit(0), ["v"], "n").count() == 0


def test_slices(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "id long, source string")
    assert sorted(r["id"] for r in workload.even_slice(df, "id", 4).collect()) == [0, 10, 19, 29]
    assert [r["id"] for r in workload.prefix_slice(df, "id", 10).orderBy("id").collect()] == [0, 1, 2]
    picked = workload.stratified_slice(df, "source", "id", 0.2)
    assert {r["source"]: r["count"] for r in picked.groupBy("source").count().collect()} == {"s0": 2, "s1": 2, "s2": 2}
    assert workload.even_slice(df, "id", 99).count() == 30


def test_generated_workload(spark):
    corpus = ["programming in python is orderly", "the quiet ledger stores a meadow", "hello wonderful little world"]
    s = spark.createDataFrame(list(enumerate(corpus)), "sentence_id long, n string")
    rows = workload.generate(s, per_category=3).collect()
    texts = {i: n for i, n in enumerate(corpus)}
    assert len({r["query_text"] for r in rows}) == len(rows) == len({r["query_id"] for r in rows})
    for r in rows:
        assert r["query_text"].strip() == r["query_text"] != ""
        inside = any(r["query_text"] in t for t in corpus)
        assert inside or r["mutation_type"] is not None
        if r["mutation_type"] is None and r["source_sentence_id"] is not None:
            assert r["query_text"] in texts[r["source_sentence_id"]]
    assert {"exact", "whole_word", "inside_word", "cross_word", "boundary_near_start", "boundary_near_end", "near_miss", "no_match"} <= {c for r in rows for c in r["categories"]}


@pytest.mark.parametrize("kind", ["synthetic", "repetitive", "high_frequency", "cross_word"])
def test_synthetic(spark, kind):
    assert workload.synthetic_corpus(spark, kind, 10).where(F.length("n") > 0).count() == 10


def test_signature_query_keeps_its_hash_sums(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    want = {}
    for r in spark.read.parquet(f"{folder}/completions.parquet").where("query_id is not null").collect():
        line = "\u0001".join("\u0000" if r[c] is None else str(r[c]) for c in ("completed_sentence", "source_text", "line_no", "score"))
        h = hashlib.md5(line.encode()).hexdigest()
        n, a, b = want.get(r["query_id"], (0, 0, 0))
        want[r["query_id"]] = (n + 1, a + int(h[:8], 16), b + int(h[8:16], 16))
    assert {r["query_id"]: (r["n"], r["sum_1"], r["sum_2"]) for r in evaluate_queries.signature(spark, folder).collect()} == want
