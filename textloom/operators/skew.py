"""Per-key work without hot tasks: fragment-replicate by estimated load.

Loads are estimated in one pass by a frequent-items sketch, whose size depends on the number of tasks alone. Keys that
the sketch shows are placed one by one: those above a task's fair share are cut into shards in proportion to their load.
All other keys are folded into hash buckets. Shards, single keys and buckets are bin-packed, largest first, onto tasks.
Rows carry the number of their task and are exchanged by that number alone (`repartitionById`), so the packing is the
placement; a matching table is copied only to the tasks that hold a shard of a large key. Grouping by task and key, or
joining on both, then needs no further exchange.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import partitions, ship

#: Hash buckets a task; together they stand for all keys that the sketch doesn't show.
BUCKETS_PER_TASK = 64
#: A key is placed by itself from this share of a task's fair load on, and cut into shards of about `SHARD_SHARE`.
KEY_SHARE, SHARD_SHARE = 0.1, 0.25
#: Items that the sketch tracks for each task: its error is then about a twentieth of a fair load.
TRACKED_PER_TASK, TRACKED_MIN, TRACKED_MAX = 64, 1024, 1_000_000
#: Rows that one task combines before it sends counts on.
COMBINED_ROWS = 500_000


@dataclass
class LoadPlan:
    """Where rows go. `bucket_task[b]` is the task of a bucket, `large[hash]` the tasks of the shards of the key with that hash."""

    tasks: int
    rows: int
    bucket_task: list[int]
    large: dict[int, list[int]] = field(default_factory=dict)
    task_load: list[float] = field(default_factory=list)


def _hash(key: str | Column) -> Column:
    """Keys are planned by hash, whatever their type; two keys of one hash merely share their tasks."""
    return F.xxhash64(key)


def pack(loads: list[tuple[float, object]], tasks: int) -> tuple[dict[object, int], list[float]]:
    """Largest first, each onto the task with the least load so far. Returns unit -> task, and the loads."""
    heap = [(0.0, t) for t in range(tasks)]
    placed: dict[object, int] = {}
    for load, unit in sorted(loads, key=lambda x: (-x[0], str(x[1]))):
        total, task = heapq.heappop(heap)
        placed[unit] = task
        heapq.heappush(heap, (total + load, task))
    final = [0.0] * tasks
    for total, task in heap:
        final[task] = total
    return placed, final


def plan_loads(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Estimates the load of the keys of `df`, in one pass over the key, and places them.

    The driver receives the sketch's items above `KEY_SHARE` of a fair load, at most `tasks / KEY_SHARE` of them. Null
    is a key like others here. An empty table gives a plan of empty tasks.
    """
    tasks = tasks or partitions(df.sparkSession)
    tracked = min(TRACKED_MAX, max(TRACKED_MIN, TRACKED_PER_TASK * tasks))
    sketch = F.expr(f"approx_top_k(__fr_key, {min(tracked, int(tasks / KEY_SHARE))}, {tracked})")
    got = df.select(_hash(key).alias("__fr_key")).agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    rows = got["n"]
    fair = max(1.0, rows / tasks)
    large = {r["item"]: r["count"] for r in got["top"] if r["count"] >= max(2.0, KEY_SHARE * fair)}
    shards = {k: max(1, min(tasks, -(-n // max(1, int(SHARD_SHARE * fair))))) for k, n in large.items()}
    buckets = BUCKETS_PER_TASK * tasks
    light = max(0, rows - sum(large.values())) / buckets
    units = [(light, ("b", b)) for b in range(buckets)]
    units += [(large[k] / n, ("k", k, i)) for k, n in shards.items() for i in range(n)]
    placed, load = pack(units, tasks)
    return LoadPlan(
        tasks, rows, [placed["b", b] for b in range(buckets)], {k: [placed["k", k, i] for i in range(n)] for k, n in shards.items()}, load
    )


def _light_task(hashed: Column, plan: LoadPlan) -> Column:
    tasks = F.split(F.lit(",".join(map(str, plan.bucket_task))), ",").cast("array<int>")
    return F.element_at(tasks, (F.pmod(hashed, F.lit(len(plan.bucket_task))) + 1).cast("int"))


def _large_table(spark: SparkSession, plan: LoadPlan) -> DataFrame:
    """At most `tasks / KEY_SHARE` rows."""
    return F.broadcast(spark.createDataFrame(list(plan.large.items()), "__fr_key long, __fr_shards array<int>"))


def place(df: DataFrame, key: str, plan: LoadPlan, row_id: str | None = None, slot: str = "__slot") -> DataFrame:
    """`df` with the task of each row. `row_id` (else the row's number in its partition) spreads a large key's rows over its shards."""
    spread = F.xxhash64(F.col(row_id)) if row_id else F.monotonically_increasing_id()
    if not plan.large:
        return df.withColumn(slot, _light_task(_hash(key), plan))
    joined = df.withColumn("__fr_spread", spread).withColumn("__fr_hash", _hash(key)).join(_large_table(df.sparkSession, plan), F.col("__fr_hash") == F.col("__fr_key"), "left")
    sharded = F.element_at("__fr_shards", (F.pmod(F.col("__fr_spread"), F.size("__fr_shards")) + 1).cast("int"))
    there = F.when(F.col("__fr_shards").isNotNull(), sharded).otherwise(_light_task(F.col("__fr_hash"), plan))
    return joined.withColumn(slot, there).drop("__fr_key", "__fr_shards", "__fr_spread", "__fr_hash")


def replicate(df: DataFrame, key: str, plan: LoadPlan, slot: str = "__slot") -> DataFrame:
    """The matching side: a row of a large key goes to each task that holds a shard of it, any other row to one task."""
    if not plan.large:
        return df.withColumn(slot, _light_task(_hash(key), plan))
    joined = df.withColumn("__fr_hash", _hash(key)).join(_large_table(df.sparkSession, plan), F.col("__fr_hash") == F.col("__fr_key"), "left")
    tasks = F.array_distinct(F.coalesce("__fr_shards", F.array(_light_task(F.col("__fr_hash"), plan))))
    return joined.withColumn(slot, F.explode(tasks)).drop("__fr_key", "__fr_shards", "__fr_hash")


def exchange(placed: DataFrame, plan: LoadPlan, slot: str = "__slot") -> DataFrame:
    """Rows at the task that `slot` names."""
    return placed.repartitionById(plan.tasks, F.col(slot))


def aggregate_by_key(df: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column], plan: LoadPlan | None = None, row_id: str | None = None) -> DataFrame:
    """One row per key. `partial` are aggregates of a shard's rows, `final` combine the shards' values (which have the names of `partial`).

    For aggregates that need the rows themselves: rows are exchanged by task, so that none holds much more than the
    plan's fair load, aggregated per shard there, and the shards' values, few per key, combined. Every row counts, rows
    with a null key too (they form the group of the null key).
    """
    plan = plan or plan_loads(df, key)
    shards = exchange(place(df, key, plan, row_id), plan).groupBy("__slot", key).agg(*[c.alias(n) for n, c in partial.items()])
    return shards.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal (slot, key) rows of a task, a stretch of rows at a time."""

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        sums = rows.group_by(rows.column_names, use_threads=False).aggregate([([], "count_all")])
        yield from sums.select([*rows.column_names, "count_all"]).to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= COMBINED_ROWS:
            yield from counted(held)
            held, n = [], 0
    if held:
        yield from counted(held)


def key_counts(df: DataFrame, key: str, plan: LoadPlan | None = None, row_id: str | None = None) -> DataFrame:
    """`key, n_rows, share` for every key (null included); `share` is of all rows of `df`.

    Rows of one task and key are combined before the exchange, so a hot key sends a few counts, not its rows.
    """
    ship(df.sparkSession)
    plan = plan or plan_loads(df, key)
    placed = place(df.select(*dict.fromkeys([key, *([row_id] if row_id else [])])), key, plan, row_id).select("__slot", key)
    kind = df.schema[key].dataType.simpleString()
    combined = placed.mapInArrow(_combine, f"__slot int, `{key}` {kind}, __n long")
    shards = exchange(combined, plan).groupBy("__slot", key).agg(F.sum("__n").alias("__n"))
    counted = shards.groupBy(key).agg(F.sum("__n").alias("n_rows"))
    return counted.withColumn("share", F.col("n_rows") / F.lit(float(max(1, plan.rows))))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, plan: LoadPlan | None = None, how: str = "inner", row_id: str | None = None) -> DataFrame:
    """`left` joined to `right` on `key`, where a few keys hold most rows of `left`.

    Shards of large keys meet copies of the matching rows; the result is that of the plain join. Null keys match
    nothing, as in SQL; with `how='left'` their rows stay, and so do rows without a match.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left: a copied right side can't keep its unmatched rows once")
    plan = plan or plan_loads(left, key)
    copies = exchange(replicate(right.where(F.col(key).isNotNull()), key, plan), plan)
    return exchange(place(left, key, plan, row_id), plan).join(copies, ["__slot", key], how).drop("__slot")


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, row_id: str | None = None) -> DataFrame:
    """`key, n_rows, share` of the keys with at least `share` of all rows; null is no key. None if `df` is empty."""
    return key_counts(df, key, row_id=row_id).where(F.col(key).isNotNull() & (F.col("share") >= F.lit(share)))
