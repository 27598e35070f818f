"""Scores of matches, the best match of each source record, and the k best records of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from textloom.functions import text as tx
from textloom.operators import scan, search

#: Strategies by name; each takes (queries, sentences).
STRATEGIES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "naive": search.search_naive,
    "qgram": search.search_qgram,
    "bi_anchor": search.search_bi_anchor,
    "hybrid": search.search_hybrid,
}
#: Queries up to which their matches are joined with the records; of more, the best match of each record is found where the sentences are read.
FEW_ASKED = 16


def score(edit_type: Column, edit_index: Column, correct: Column) -> Column:
    """Two points a correct character, less a penalty that falls with the place of the edit, from the fifth character on the least."""
    place = F.least(edit_index, F.lit(4))
    penalty = F.when(edit_type == "exact", 0).when(edit_type == "replacement", place - 5).otherwise(2 * place - 10)
    return (2 * correct + penalty).cast("int")


def scored(matches: DataFrame) -> DataFrame:
    return matches.withColumn("score", score(F.col("edit_type"), F.col("edit_index"), F.col("correct_characters")))


def best_per_record(matches: DataFrame, records: DataFrame) -> DataFrame:
    """`query_id, completed_sentence, source_text, line_no, score, sentence_id`: each source record once, with its best score.

    `records` is `sentence_id, original_text, source_path, line_no`. Scores are taken per sentence before texts are
    joined, so no text is shuffled for a match that loses.
    """
    per_sentence = scored(matches).groupBy("query_id", "sentence_id").agg(F.max("score").alias("score"))
    texts = records.select("sentence_id", F.col("original_text").alias("completed_sentence"), F.col("source_path").alias("source_text"), "line_no")
    return per_sentence.join(texts, "sentence_id").groupBy("query_id", "completed_sentence", "source_text", "line_no").agg(F.max("score").alias("score"), F.min("sentence_id").alias("sentence_id"))


def best_in_place(queries: DataFrame, sentences: DataFrame, k: int | None = None) -> DataFrame | None:
    """`best_per_record` of the matches of `query_id, q` by the anchors, found where the sentences are read, so that no match is exchanged.

    With `k`, at least the k best of each query. `sentences` is `sentence_id, n, original_text, source_path, line_no`;
    those of one record follow each other in one task. None if the workload is none for this: too large or too few
    queries, ids that stand twice or aren't whole numbers.
    """
    asked = search.Asked(queries)
    if not asked.small or sentences.schema["sentence_id"].dataType.simpleString() not in ("int", "bigint") or queries.limit(FEW_ASKED + 1).count() <= FEW_ASKED:
        return None
    splits = search.anchored(asked, sentences, [1, 2, 3])
    if not splits.unique or not search.one_each(sentences):
        return None
    matcher, ids = splits.matcher, splits.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan.best_of(matcher, ids, k, batches)

    record = ["completed_sentence", "source_text", "line_no"]
    rows = sentences.where(F.col("sentence_id").isNotNull()).select("sentence_id", "n", F.col("original_text").alias("completed_sentence"), F.col("source_path").alias("source_text"), "line_no")
    kept = {f.name: f.dataType for f in rows.schema}
    fields = [("query_id", splits.id_type), *((c, kept[c]) for c in record), ("score", IntegerType()), ("sentence_id", kept["sentence_id"])]
    return search.grouped_windows(rows, record, splits.longest + 1, record).mapInArrow(run, StructType([StructField(*f) for f in fields]))


def top_k(best: DataFrame, k: int = 5) -> DataFrame:
    """The k best records of each query: score descending, then text, then sentence_id; `rank` counts from 1."""
    if k < 1:
        raise ValueError("k is 1 or more")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("completed_sentence").asc_nulls_first(), "sentence_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "completed_sentence", "source_text", "line_no", "score", "rank")


class SearchEngine:
    """Sentences with a strategy: raw candidates, and completions of typed prefixes."""

    def __init__(self, strategy: str | Callable[[DataFrame, DataFrame], DataFrame] = "bi_anchor") -> None:
        self.search_with = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
        self.sentences: DataFrame | None = None

    def build(self, sentences: DataFrame) -> SearchEngine:
        """`sentences` is `sentence_id, original_text, normalized_text, source_path, line_no`; ids are unique."""
        missing = {"sentence_id", "original_text", "normalized_text", "source_path", "line_no"} - set(sentences.columns)
        if missing:
            raise TypeError(f"sentences lack {sorted(missing)}")
        self.sentences = sentences
        return self

    @classmethod
    def from_index(cls, index: dict[str, DataFrame], sizes: list[int]) -> SearchEngine:
        """An engine over a stored index (`sources.index_store.load_index`); `sizes` are its gram sizes."""
        return cls(lambda q, s: search.search_bi_anchor(q, s, tuple(sizes), index=index)).build(index["sentences"])

    def _built(self) -> DataFrame:
        if self.sentences is None:
            raise RuntimeError("build() comes first")
        return self.sentences

    def raw_candidates(self, queries: DataFrame) -> DataFrame:
        """Matches of `query_id, q`, before ranking."""
        sentences = self._built()
        part = ["part"] if "part" in sentences.columns else []
        return self.search_with(queries, sentences.select("sentence_id", F.col("normalized_text").alias("n"), *part))

    def complete(self, prefixes: DataFrame, k: int = 5, on_candidates: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """The k best completions of `query_id, prefix`; prefixes that normalize to nothing have none."""
        asked = prefixes.select("query_id", tx.normalize(F.col("prefix")).alias("q")).where(F.col("q") != "")
        if k > 0 and not on_candidates and self.search_with is search.search_bi_anchor:
            best = best_in_place(asked, self._built().withColumn("n", F.col("normalized_text")), k)
            if best is not None:
                return top_k(best, k)
        found = self.raw_candidates(asked)
        if on_candidates:
            on_candidates(found)
        return top_k(best_per_record(found, self._built()), k)


_ENGINE: dict[str, SearchEngine] = {}


def init_completions(engine: SearchEngine) -> None:
    """Names the built engine that `best_completions` asks."""
    engine._built()
    _ENGINE["default"] = engine


def best_completions(prefix: str, k: int = 5) -> list[Row]:
    """The k best completions of one typed prefix, as rows; RuntimeError before `init_completions`."""
    if "default" not in _ENGINE:
        raise RuntimeError("init_completions() comes first")
    engine = _ENGINE["default"]
    asked = engine._built().sparkSession.createDataFrame([("1", prefix)], "query_id string, prefix string")
    return engine.complete(asked, k).orderBy("rank").collect()  # at most k rows
