"""Prefixes typed over several lines: each line adds to the session's prefix, `#` alone starts anew, blank lines do nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.session import ship

RESET = "#"


def session_prefixes(lines: DataFrame) -> DataFrame:
    """`session, turn, prefix` for every line of `session, turn, line` that adds to a prefix. Null lines count as blank; ties of turn go by line."""
    trimmed = lines.select("session", "turn", F.coalesce(F.trim("line"), F.lit("")).alias("line")).where(F.col("line") != "")
    order = W.partitionBy("session").orderBy("turn", "line").rowsBetween(W.unboundedPreceding, W.currentRow)
    grouped = trimmed.withColumn("part", F.sum((F.col("line") == RESET).cast("int")).over(order)).where(F.col("line") != RESET)
    within = W.partitionBy("session", "part").orderBy("turn", "line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return grouped.select("session", "turn", F.array_join(F.collect_list("line").over(within), " ").alias("prefix"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    prefix = state.get[0] if state.exists else ""
    rows = pd.concat(list(batches)).sort_values(["turn", "line"])
    out = []
    for turn, line in zip(rows["turn"], rows["line"]):
        line = (line or "").strip(" ")
        if line == RESET:
            prefix = ""
        elif line:
            prefix = f"{prefix} {line}" if prefix else line
            out.append((key[0], turn, prefix))
    state.update((prefix,))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=["session", "turn", "prefix"])


def stream_prefixes(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream of `session string, turn long, line string`; the state is the session's prefix.

    A stream that runs on should name `idle_ms`, after which a session without a line is forgotten; a stream that is
    run to its end (`availableNow`) can't, since waiting for idle sessions has no end.
    """
    ship(lines.sparkSession)
    kept = lines.select(F.col("session").cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), "line")

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _advance(key, batches, state, idle_ms)

    return kept.groupBy("session").applyInPandasWithState(advance, "session string, turn long, prefix string", "prefix string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def complete_stream(lines: DataFrame, complete: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands the completions of each micro-batch to `sink`; `complete` maps (query_id, prefix) to completions."""

    def each(batch: DataFrame, epoch: int) -> None:
        asked = batch.select(F.concat_ws(":", "session", F.col("turn").cast("string")).alias("query_id"), "prefix")
        sink(complete(asked), epoch)

    return stream_prefixes(lines).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
