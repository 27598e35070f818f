"""How often every distinct term occurs, and in how many records.

Method: last-seen counters. A task walks its tokens in record order; a term keeps its occurrences, its records and
the number of the record in which it was last seen. A token counts a new record when that number is another one, so
no set of records is kept per term. Records are whole rows, so the counters of two tasks simply add up; only
`(term, occurrences, records)` is shuffled, never a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import spread

#: A task hands its counters on and starts anew when it holds this many terms.
FLUSH_TERMS = 200_000

RARE, COMMON = "too_rare", "too_common"


class LastSeenCounters:
    """Counters of one task: term -> occurrences, records, record in which it was last seen."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)

    def add(self, terms: pa.Array, record: np.ndarray) -> None:
        """`terms[i]` stands in record number `record[i]`; the numbers ascend."""
        if not len(terms):
            return
        coded = terms.dictionary_encode()
        known = self.ids
        to_id = np.fromiter((known.setdefault(t, len(known)) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if len(known) > len(self.last):
            more = max(len(known), 2 * len(self.last)) - len(self.last)
            self.occurrences, self.records = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (self.occurrences, self.records))
            self.last = np.concatenate([self.last, np.full(more, -1, np.int64)])
        ids = to_id[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(ids, kind="stable")
        ids, record = ids[order], record[order]
        first = np.r_[True, ids[1:] != ids[:-1]]
        seen = np.r_[-1, record[:-1]]
        seen[first] = self.last[ids[first]]
        np.add.at(self.occurrences, ids, 1)
        np.add.at(self.records, ids[seen != record], 1)
        final = np.r_[first[1:], True]
        self.last[ids[final]] = record[final]

    def take(self) -> pa.RecordBatch:
        n = len(self.ids)
        out = pa.RecordBatch.from_arrays([pa.array(list(self.ids), pa.string()), pa.array(self.occurrences[:n]), pa.array(self.records[:n])], ["term", "occurrences", "records"])
        self.__init__()
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters, rows = LastSeenCounters(), 0
    for batch in batches:
        lists = batch.column(0)
        terms = pc.list_flatten(lists).cast(pa.string())
        record = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64) + rows
        there = pc.is_valid(terms)
        counters.add(terms.filter(there), record[there.to_numpy(zero_copy_only=False)])
        rows += len(lists)
        if len(counters.ids) >= FLUSH_TERMS:
            yield counters.take()
    yield counters.take()


def term_frequencies(df: DataFrame, terms: Column) -> DataFrame:
    """`term string, occurrences long, records long` for every distinct term of the array column `terms`.

    A row is a record; repeated rows count again. A null array, an empty one and null elements hold no term; the empty
    string is a term. An empty table gives no rows. Terms are compared exactly as stored.
    """
    parts = spread(df.select(terms.cast("array<string>").alias("terms"))).mapInArrow(_count, "term string, occurrences long, records long")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(frequencies: DataFrame, n_rows: int, min_records: int = 3, max_share: float = 0.05) -> DataFrame:
    """Adds `mark`: too_rare (in fewer than `min_records` records), too_common (in more than `max_share` of `n_rows`), else null.

    In a table so small that both hold, the term is too rare.
    """
    return frequencies.withColumn(
        "mark", F.when(F.col("records") < min_records, F.lit(RARE)).when(F.col("records") > F.lit(max_share * n_rows), F.lit(COMMON))
    )


def marked_frequencies(df: DataFrame, terms: Column, field_name: str, min_records: int = 3, max_share: float = 0.05) -> DataFrame:
    """`field_name, term_value, occurrences, records, mark` for every term; the share is of all rows of `df`, without terms too."""
    marked = mark_terms(term_frequencies(df, terms), df.count(), min_records, max_share)
    return marked.select(F.lit(field_name).alias("field_name"), F.col("term").alias("term_value"), "occurrences", "records", "mark")
