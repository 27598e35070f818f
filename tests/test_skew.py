from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import skew


def keyed(spark, keys, name="k"):
    return spark.createDataFrame([(i, k, f"x{i}") for i, k in enumerate(keys)], f"id long, {name} string, __slot_name string")


KEYS = ["hot"] * 400 + ["warm"] * 90 + [f"k{i % 137}" for i in range(500)] + [None] * 10


def test_counts_equal_plain_counts(spark):
    got = {r["k"]: r["n_rows"] for r in skew.key_counts(keyed(spark, KEYS), "k", row_id="id").collect()}
    assert got == Counter(KEYS)


def test_heavy_keys(spark):
    assert {r["k"] for r in skew.heavy_keys(keyed(spark, KEYS), "k", 0.05).collect()} == {"hot", "warm"}


def _per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_no_task_holds_much_more_than_its_share(spark):
    """The placement counts in the operators' own output, with adaptive execution off."""
    keys = ["hot"] * 12_000 + [f"w{i % 9}" for i in range(2_700)] + [f"k{i % 1370}" for i in range(9_000)] + [None] * 300
    rows = keyed(spark, keys)
    fair = len(keys) / 8
    plan = skew.plan_loads(rows, "k", tasks=8)
    assert len(plan.task_load) == 8 and max(plan.task_load) <= 1.1 * fair
    hot = next(tasks for h, tasks in plan.large.items() if h == rows.where("k = 'hot'").select(F.xxhash64("k").alias("h")).first()["h"])
    assert len(set(hot)) == 8
    right = spark.createDataFrame([(k,) for k in {*keys} - {None}], "k string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = _per_task(skew.fragment_replicate_join(rows, right, "k", plan, "left", "id").select("id"))
        assert len(joined) == 8 and sum(joined) == len(keys) and max(joined) <= 1.5 * fair
        shards = skew.exchange(skew.place(rows, "k", plan, "id"), plan)
        assert max(_per_task(shards)) <= 1.5 * fair
        for plan_text in (shards.groupBy("__slot", "k").count(), skew.fragment_replicate_join(rows, right, "k", plan)):
            text = plan_text._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in text and "shufflepartitionidpassthrough" in text
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_counts_are_combined_before_the_exchange(spark):
    rows = keyed(spark, ["hot"] * 5_000 + ["cold"]).coalesce(2)
    plan = skew.plan_loads(rows, "k", tasks=4)
    combined = skew.place(rows.select("k", "id"), "k", plan, "id").select("__slot", "k").mapInArrow(skew._combine, "__slot int, k string, __n long")
    assert combined.count() <= 2 * 5


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain_join(spark, how):
    left = keyed(spark, KEYS)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("absent", 4), (None, 5)], "k string, v int")
    want = Counter(tuple(r) for r in left.join(right, "k", how).select("id", "k", "v").collect())
    plan = skew.plan_loads(left, "k", tasks=8)
    got = Counter(tuple(r) for r in skew.fragment_replicate_join(left, right, "k", plan, how).select("id", "k", "v").collect())
    assert got == want
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(left, right, "k", plan, "full")


def test_identical_rows_and_empty_table(spark):
    same = spark.createDataFrame([("a",)] * 300, "k string")
    plan = skew.plan_loads(same, "k", tasks=4)
    placed = skew.place(same, "k", plan).groupBy("__slot").count().collect()
    assert len(placed) == 4 and sum(r["count"] for r in placed) == 300
    assert skew.key_counts(same.limit(0), "k").count() == 0


def test_aggregates_combine(spark):
    rows = keyed(spark, KEYS)
    got = skew.aggregate_by_key(rows, "k", {"lo": F.min("id"), "n": F.count("id")}, {"lo": F.min("lo"), "n": F.sum("n")})
    want = rows.groupBy("k").agg(F.min("id").alias("lo"), F.count("id").alias("n"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
