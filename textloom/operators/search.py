"""Search strategies: a table of queries against a table of sentences, one-edit matches out.

Queries are `query_id, q` (normalized, not trimmed), sentences `sentence_id, n` (normalized). Every strategy but the
hybrid gives the same set, keyed by (query_id, sentence_id, match_start, edit_type, edit_index). Empty and null queries
give no rows, nor do null sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from textloom.functions import text as tx
from textloom.operators import scan, verify
from textloom.session import partitions, ship, spread

#: Sentences are cut into windows of this many start positions before positions are enumerated, so that no row
#: carries a long text through an explode.
WINDOW = 256
#: Characters up to which a table of queries, or the starts that a stored index gives for them, is broadcast.
BROADCAST_CHARS = 8_000_000
#: Queries, and grams of theirs, up to which a stored index is read by filters that Parquet skips by; more are joined.
FEW_QUERIES, LOOKUP_GRAMS = 500, 10_000
#: Postings of their anchors, known from the stored frequencies, up to which the starts are worked out on the driver; and
#: folders of stored sentences up to which they are named in a filter.
FEW_STARTS, FEW_PARTS = 50_000, 5_000
#: A small workload whose anchors have more postings than one in so many characters of the stored texts is matched where these are read.
SCAN_SHARE = 8
#: Largest length gap of a short word, longest short word, and most results of the hybrid.
SHORT_WORD, HYBRID_CAP = 4, 2000

MATCH_COLUMNS = ["query_id", "sentence_id", "match_start", "edit_type", "edit_index", "correct_characters"]


def require(df: DataFrame, what: str, columns: set[str]) -> None:
    """TypeError if a structure handed to a strategy isn't one it can search."""
    if missing := columns - set(df.columns):
        raise TypeError(f"{what} lack {sorted(missing)}")


class Asked:
    """The queries that can match, their number, the length of the longest, and the blocks to broadcast them in."""

    def __init__(self, queries: DataFrame) -> None:
        require(queries, "queries", {"query_id", "q"})
        self.rows = queries.where(F.length("q") > 0).select("query_id", "q")
        r = self.rows.agg(F.coalesce(F.sum(F.length("q") + 16), F.lit(0)).alias("s"), F.coalesce(F.max(F.length("q")), F.lit(1)).alias("m")).first()
        self.longest: int = r["m"]
        self.blocks: int = max(1, -(-r["s"] // BROADCAST_CHARS))
        self.small: bool = self.blocks == 1


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def windows(sentences: DataFrame, reach: int, dealt: bool = True) -> DataFrame:
    """`sentence_id, at, text, starts`: overlapping windows; each holds `starts` start positions and `reach` characters more.

    `dealt`: a small table in few files is dealt out over all cores first.
    """
    require(sentences, "sentences", {"sentence_id", "n"})
    rows = sentences.where("length(n) > 0").select("sentence_id", "n")
    rows = (spread(rows) if dealt else rows).selectExpr("sentence_id", "n", "length(n) as len")
    cut = rows.selectExpr("sentence_id", "n", "len", f"explode(sequence(0, len - 1, {WINDOW})) as at")
    return cut.selectExpr("sentence_id", "at", f"substring(n, at + 1, {WINDOW + reach}) as text", f"least({WINDOW}, len - at) as starts")


class Splits:
    """The queries of a small workload on the driver, each with the places at which it is split (`scan`)."""

    def __init__(self, asked: Asked, split: Callable[[object, str], scan.Split], indexed: bool, some: DataFrame | None = None) -> None:
        rows = (asked.rows if some is None else some).toArrow()
        self.ids: pa.Array = rows["query_id"].combine_chunks()
        self.id_type: DataType = asked.rows.schema["query_id"].dataType
        self.matcher = scan.Matcher([split(i, q) for i, q in zip(self.ids.to_pylist(), rows["q"].to_pylist())], indexed)
        self.longest = asked.longest

    def __len__(self) -> int:
        return len(self.ids)


    @property
    def unique(self) -> bool:
        return len(self.ids.unique()) == len(self.ids)


def one_each(sentences: DataFrame) -> bool:
    """Whether no sentence_id stands twice."""
    return not sentences.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()


def grouped_windows(sentences: DataFrame, by: list[str], reach: int, carried: list[str]) -> DataFrame:
    """`windows` of sentences of which those with equal `by` follow each other in one task, in the order of their ids.

    `fresh` is true in the first row of each group, which alone holds the columns `carried`.
    """
    ship(sentences.sparkSession)
    rows = sentences.where("length(n) > 0").repartition(partitions(sentences.sparkSession), *by)
    marked = rows.withColumn("fresh", F.row_number().over(W.partitionBy(*by).orderBy("sentence_id")) == 1).withColumn("len", F.length("n"))
    cut = marked.select("sentence_id", "n", "len", "fresh", *carried, F.expr(f"explode(sequence(0, len - 1, {WINDOW}))").alias("at"))
    first = F.col("fresh") & (F.col("at") == 0)
    return cut.select("sentence_id", "at", F.expr(f"substring(n, at + 1, {WINDOW + reach})").alias("text"), F.expr(f"least({WINDOW}, len - at)").alias("starts"), first.alias("fresh"), *[F.when(first, F.col(c)).alias(c) for c in carried])


def count_kinds(queries: DataFrame, sentences: DataFrame) -> DataFrame:
    """`query_id, edit_type, matches, n_sentences` by the anchors; counted where the sentences are read, if the queries are few enough to be broadcast."""
    asked = Asked(queries)
    splits = anchored(asked, sentences, [1, 2, 3]) if asked.small else None
    if splits is None or not splits.unique:
        found = search_bi_anchor(queries, sentences)
        return found.groupBy("query_id", "edit_type").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("sentence_id").alias("n_sentences"))
    matcher, ids = splits.matcher, splits.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan.kinds_of(matcher, ids, batches)

    fields = (("query_id", splits.id_type), ("edit_type", StringType()), ("matches", LongType()), ("n_sentences", LongType()))
    parts = grouped_windows(sentences, ["sentence_id"], splits.longest + 1, []).mapInArrow(run, StructType([StructField(*f) for f in fields]))
    return parts.groupBy("query_id", "edit_type").agg(F.sum("matches").alias("matches"), F.sum("n_sentences").alias("n_sentences"))


def count_starts(plan: DataFrame, sentences: DataFrame, asked: Asked) -> DataFrame:
    """`query_id, candidate_count, calls`: distinct `candidate_contexts` of each query that have a slice in bounds, and their `context_slices`."""
    rows = plan.select("query_id", "q", "gram_size", "first_start", "second_start")
    at = {(r["query_id"], r["q"]): (r["gram_size"], r["first_start"], r["second_start"]) for r in rows.collect()} if asked.small else {}
    splits = Splits(asked, lambda i, q: scan.anchors(q, *at[i, q]), True, rows.select("query_id", "q")) if at else None
    if splits is None or not splits.unique or max(size for size, *_ in at.values()) > splits.matcher.grams or not one_each(sentences):
        slices = context_slices(candidate_contexts(plan, sentences, sorted({size for size, *_ in at.values()} or {1, 2, 3})), sentences)
        starts = slices.select("query_id", "sentence_id", "match_start").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"))
        return starts.join(slices.groupBy("query_id").agg(F.count(F.lit(1)).alias("calls")), "query_id")
    matcher, ids = splits.matcher, splits.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan.starts_of(matcher, ids, batches)

    fields = (("query_id", splits.id_type), ("candidate_count", LongType()), ("calls", LongType()))
    texts = spread(sentences.where("length(n) > 0 and sentence_id is not null").select(F.col("n").alias("text")))
    parts = texts.mapInArrow(run, StructType([StructField(*f) for f in fields]))
    return parts.groupBy("query_id").agg(F.sum("candidate_count").alias("candidate_count"), F.sum("calls").alias("calls"))


def _listed(splits: Splits, sentences: DataFrame) -> DataFrame:
    """All matches, found where the sentences are read, and handed on in lists."""
    matcher, ids = splits.matcher, splits.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan.grouped(matcher, ids, batches)

    int_, text = IntegerType(), StringType()
    fields = (("query_id", splits.id_type), ("edit_type", text), ("edit_index", int_), ("correct_characters", int_), ("sentence_ids", ArrayType(sentences.schema["sentence_id"].dataType)), ("match_starts", ArrayType(int_)))
    lists = windows(sentences, splits.longest + 1).mapInArrow(run, StructType([StructField(*f) for f in fields]))
    each = lists.selectExpr("query_id", "edit_type", "edit_index", "correct_characters", "sentence_ids", "posexplode(match_starts) as (p, match_start)")
    return each.withColumn("sentence_id", F.col("sentence_ids")[F.col("p")]).select(MATCH_COLUMNS)


def search_naive(queries: DataFrame, sentences: DataFrame) -> DataFrame:
    """Every start of every sentence against both halves of every query; where a half may stand is read from the sorted starts of a batch.

    With more queries than are broadcast at once, a window that holds neither half of a query is skipped before positions are enumerated.
    """
    asked = Asked(queries)
    if asked.small:
        return _listed(halved(asked), sentences)
    return _scan(asked.rows, sentences, asked)


def halved(asked: Asked) -> Splits:
    return Splits(asked, lambda _, q: scan.halves(q), True)


def _scan(rows: DataFrame, sentences: DataFrame, asked: Asked) -> DataFrame:
    """All starts of all sentences for the queries `rows`, a block of them at a time, so that each block can be broadcast."""
    out = None
    for b in range(asked.blocks):
        block = rows if asked.small else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(asked.blocks)) == b)
        part = _scan_block(F.broadcast(block), sentences, asked.longest)
        out = part if out is None else out.unionByName(part)
    return out


def _scan_block(asked: DataFrame, sentences: DataFrame, longest: int) -> DataFrame:
    m, q, text = F.length("q"), F.col("q"), F.col("text")
    half = F.floor(m / 2).cast("int")
    possible = (m < 2) | text.contains(F.left(q, half)) | text.contains(F.substring(q, half + 1, m))
    pairs = windows(sentences, longest + 1).join(asked, possible)
    starts = pairs.select("query_id", "q", "sentence_id", "at", "text", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("p"))
    slices = starts.select("query_id", "q", "sentence_id", (F.col("at") + F.col("p")).alias("match_start"), F.substring("text", F.col("p") + 1, m + 1).alias("t"))
    return verify.verified(slices, ["query_id", "sentence_id"], longest).select(MATCH_COLUMNS)


def postings(sentences: DataFrame, sizes: list[int]) -> DataFrame:
    """`gram_size, gram, sentence_id, position` of all grams of the given sizes (J5, J14)."""
    cut = windows(sentences, max(sizes) - 1)
    places = cut.select("sentence_id", "at", "text", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("p"))
    tails = places.select("sentence_id", (F.col("at") + F.col("p")).alias("position"), F.substring("text", F.col("p") + 1, F.lit(max(sizes))).alias("tail"))
    made = tails.select("sentence_id", "position", F.inline(F.array(*[F.struct(F.lit(s).alias("gram_size"), F.left("tail", F.lit(s)).alias("gram")) for s in sizes])))
    return made.where(F.length("gram") == F.col("gram_size")).select("gram_size", "gram", "sentence_id", "position")


def posting_lists(sentences: DataFrame, sizes: list[int]) -> DataFrame:
    """`tail, n, sentence_ids, positions`: each start once, under the characters of the largest size (`scan.runs`)."""
    longest, least = max(sizes), min(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan.runs(longest, least, batches)

    ids = ArrayType(sentences.schema["sentence_id"].dataType)
    fields = (("tail", StringType()), ("n", IntegerType()), ("sentence_ids", ids), ("positions", ArrayType(IntegerType())))
    return windows(sentences, longest - 1).mapInArrow(run, StructType([StructField(*f) for f in fields]))


def grams_of(lists: DataFrame, sizes: list[int]) -> DataFrame:
    """`lists` once for each gram size that its `tail` has, with `gram_size, gram` in place of it."""
    rest = [c for c in lists.columns if c != "tail"]
    made = F.inline(F.array(*[F.struct(F.lit(s).alias("gram_size"), F.left("tail", F.lit(s)).alias("gram")) for s in sizes]))
    return lists.select(made, *rest).where(F.length("gram") == F.col("gram_size"))


def listed_postings(lists: DataFrame, sizes: list[int]) -> DataFrame:
    """`postings` of stored lists."""
    return grams_of(lists, sizes).selectExpr("gram_size", "gram", "inline(arrays_zip(sentence_ids, positions)) as (sentence_id, position)")


def query_grams(queries: DataFrame, sizes: list[int]) -> DataFrame:
    """`query_id, q, gram_size, gram, query_start`."""
    places = queries.where(F.length("q") > 0).select("query_id", "q", F.explode(F.sequence(F.lit(0), F.length("q") - 1)).alias("query_start"))
    made = F.array(*[F.struct(F.lit(s).alias("gram_size"), F.substring("q", F.col("query_start") + 1, F.lit(s)).alias("gram")) for s in sizes])
    grams = places.select("query_id", "q", "query_start", F.inline(made)).where(F.length("gram") == F.col("gram_size"))
    return grams.select("query_id", "q", "gram_size", "gram", "query_start")


def choose_q(m: Column, q: int) -> Column:
    """The gram size for a query of m characters: 1 up to 3, 2 up to 5, else q."""
    return F.when(m <= 3, 1).when(m <= 5, 2).otherwise(q)


def _near(hits: DataFrame) -> DataFrame:
    """`query_id, q, sentence_id, at, starts`: per query and window the distinct starts within one of (position - query_start), in one exchange."""
    around = hits.selectExpr("query_id", "q", "sentence_id", "explode(sequence(position - query_start - 1, position - query_start + 1)) as start")
    starts = around.where("start >= 0").selectExpr("query_id", "q", "sentence_id", "start", f"start - start % {WINDOW} as at")
    return starts.groupBy("query_id", "q", "sentence_id", "at").agg(F.collect_set("start").alias("starts"))


def _slices(near: DataFrame, sentences: DataFrame, longest: int, few: bool = False) -> DataFrame:
    """Texts at the starts. Windows meet starts, so neither the join nor the explode carries a long text, and a slice is cut from a window's begin.

    `few`: the starts are known to be few enough to be broadcast, and the sentences stay where they are.
    """
    cut = windows(sentences, longest + 1, not few).selectExpr("sentence_id", "at", "text", "starts as n_starts")
    met = cut.join(F.broadcast(near) if few else near, ["sentence_id", "at"])
    slices = "transform(filter(starts, s -> s < at + n_starts), s -> struct(s as match_start, substring(text, s - at + 1, length(q) + 1) as t))"
    return met.selectExpr("query_id", "q", "sentence_id", f"inline({slices})")


def search_qgram(queries: DataFrame, sentences: DataFrame, q: int = 3) -> DataFrame:
    """Grams of the query looked up, starts verified; queries shorter than two grams go to the exhaustive scan.

    One edit leaves the first or the last gram whole, so these two are looked up, in the sorted grams of the texts at
    hand. With more queries than are broadcast at once, every gram is, and the hits of a window meet in one exchange.
    """
    if q < 2:
        raise ValueError("q is 2 or more")
    asked = Asked(queries)
    if asked.small:
        gram = lambda text: 1 if len(text) <= 3 else 2 if len(text) <= 5 else q
        return _listed(Splits(asked, lambda _, text: scan.ends(text, gram(text)) if len(text) >= 2 * gram(text) else scan.halves(text), True), sentences)
    size = choose_q(F.length("q"), q)
    sizes = sorted({1, 2, q})
    grams = query_grams(asked.rows.where(F.length("q") >= 2 * size), sizes).where(F.col("gram_size") == size)
    hits = postings(sentences, sizes).join(_hinted(grams, asked.small), ["gram_size", "gram"])
    found = verify.verified(_slices(_near(hits), sentences, asked.longest), ["query_id", "sentence_id"], asked.longest).select(MATCH_COLUMNS)
    return found.unionByName(_scan(asked.rows.where(F.length("q") < 2 * size), sentences, asked))


def seed_frequency(sentences: DataFrame, sizes: list[int]) -> DataFrame:
    """`gram_size, gram, frequency` over the corpus, combined on the map side."""
    return postings(sentences, sizes).groupBy("gram_size", "gram").agg(F.count(F.lit(1)).alias("frequency"))


def indexed_only(grams: DataFrame, sizes: list[int]) -> DataFrame:
    """`grams` with a column that fails the job at the first gram of a size that isn't among `sizes` (J17, J20)."""
    known = F.col("gram_size").isin(sizes)
    return grams.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gram size not indexed: "), F.col("gram_size"))).cast("boolean")))


def frequency_of(seeds: DataFrame, index: dict[str, DataFrame], sizes: list[int]) -> DataFrame:
    """`seed, frequency` from a stored index for `seeds` (`seed`); 0 if absent, an error for a length that isn't indexed."""
    grams = indexed_only(seeds.select("seed", F.length("seed").alias("gram_size"), F.col("seed").alias("gram")), sizes)
    stored = index["frequencies"].select("gram_size", "gram", "frequency")
    return grams.join(stored, ["gram_size", "gram"], "left").select("seed", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))


def _lookup(stored: DataFrame, grams: DataFrame, small: bool) -> DataFrame:
    """The rows of a stored index table for the grams of a large table of queries."""
    return stored.join(_hinted(grams.select("gram_size", "gram").distinct(), small), ["gram_size", "gram"], "left_semi")


def _filtered(stored: DataFrame, grams: set[tuple[int, str]]) -> DataFrame:
    """The rows of a stored index table for few grams, as a filter that reaches the scan: sizes prune folders, grams skip row groups and pages."""
    return stored.where(F.col("gram_size").isin(sorted({s for s, _ in grams})) & F.col("gram").isin(sorted({g for _, g in grams})))


def _postings_of(index: dict, grams: set[tuple[int, str]], sizes: list[int]) -> DataFrame:
    """`_filtered` postings: lists whose tails begin with none of the grams are skipped."""
    if "lists" not in index:
        return _filtered(index["postings"], grams)
    longest = max(sizes)
    tests = [F.col("tail").isin(sorted({g for s, g in grams if s == longest})), *(F.col("tail").startswith(g) for s, g in sorted(grams) if s < longest)]
    while len(tests) > 1:  # a shallow tree, however many
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return _filtered(listed_postings(index["lists"].where(tests[0]), sizes), grams)


def best_plan(q: str, frequency: dict[tuple[int, str], int], sizes: list[int]) -> list[tuple[int, str, int]]:
    """`gram_size, gram, query_start` of both anchors of one query, as `anchor_plan` has them; empty without a plan."""
    best = None
    for size in sizes:
        windows_ = [(frequency.get((size, q[i : i + size]), 0), i) for i in range(len(q) - size + 1)]
        first = None
        for begin in range(size, len(windows_)):
            ended = windows_[begin - size]
            first = ended if first is None else min(first, ended)
            key = (first[0] + windows_[begin][0], -size, first[1], begin)
            best = key if best is None else min(best, key)
    if best is None:
        return []
    _, size, *starts = best
    return [(-size, q[i : i - size], i) for i in starts]


def _near_here(postings_: DataFrame, anchors: list[tuple], q_type: str) -> tuple[DataFrame, np.ndarray]:
    """`_near` of few postings, counted before they are read, worked out on the driver; and the ids of their sentences."""
    names = ["query_id", "q", "gram_size", "gram", "query_start"]
    wanted = pa.table(dict(zip(names, map(list, zip(*anchors))))).cast(pa.schema([pa.field("query_id", pa.table({"x": [anchors[0][0]]}).schema[0].type), ("q", pa.string()), ("gram_size", pa.int32()), ("gram", pa.string()), ("query_start", pa.int32())]))
    hits = postings_.selectExpr("int(gram_size) as gram_size", "gram", "sentence_id", "position").toArrow()
    met = hits.join(wanted, ["gram_size", "gram"], join_type="inner", use_threads=False)
    first = pc.subtract(met["position"], met["query_start"]).to_numpy()
    start = np.concatenate([first - 1, first, first + 1])
    rows = pa.concat_tables([met.select(["query_id", "q", "sentence_id"])] * 3).append_column("starts", pa.array(start, pa.int32()))
    rows = rows.append_column("at", pa.array(start // WINDOW * WINDOW, pa.int32())).filter(pa.array(start >= 0))
    near = rows.group_by(["query_id", "q", "sentence_id", "at"], use_threads=False).aggregate([("starts", "distinct")]).rename_columns(["query_id", "q", "sentence_id", "at", "starts"])
    spark = postings_.sparkSession
    made = spark.createDataFrame(near) if near.num_rows else spark.createDataFrame([], f"query_id {q_type}, q string, sentence_id long, at int, starts array<int>")
    return made, near["sentence_id"].to_numpy()


def _holding(index: dict, sentences: DataFrame, ids: np.ndarray) -> DataFrame:
    """The stored sentences, of the folders alone that can hold these ids."""
    if "layout" not in index or "part" not in index["sentences"].columns:
        return sentences
    low, high, parts = index["layout"]
    wanted = np.unique((ids.astype(object) - low) * parts // (high - low + 1))
    if len(wanted) == parts or len(wanted) > FEW_PARTS:
        return sentences
    return sentences.where(F.col("part").isin([int(x) for x in wanted]))


def _many(starts: int, index: dict) -> bool:
    """Whether it is less work to read the stored texts than so many postings."""
    return starts * SCAN_SHARE > index.get("characters", float("inf"))


def _search_few(queries: list[tuple[object, str]], q_type: str, sentences: DataFrame, sizes: list[int], minimum: int, index: dict[str, DataFrame]) -> DataFrame:
    """Few queries over a stored index: one read of the frequencies of their grams, planned on the driver, one read of the anchors' postings."""
    spark = sentences.sparkSession
    grams = {(s, q[i : i + s]) for _, q in queries for s in sizes for i in range(len(q) - s + 1)}
    rows = _filtered(index["frequencies"], grams).select("gram_size", "gram", "frequency").collect() if grams else []
    frequency = {(r["gram_size"], r["gram"]): r["frequency"] for r in rows}
    longest = max(len(q) for _, q in queries)
    anchors, left, at = [], [], {}
    for query_id, q in queries:
        plan = best_plan(q, frequency, sizes) if len(q) >= max(minimum, 2 * sizes[0]) else []
        if plan:
            at[query_id, q] = (plan[0][0], plan[0][2], plan[1][2])
            anchors += [(query_id, q, size, gram, start) for size, gram, start in plan if (size, gram) in frequency]
        else:
            left.append((query_id, q))
    schema = f"query_id {q_type}, q string"
    out = None
    starts = sum(frequency[size, gram] for _, _, size, gram, _ in anchors)
    if starts > FEW_STARTS and _many(starts, index):
        return _listed(split_at(Asked(spark.createDataFrame(queries, schema)), at), sentences)
    if anchors:
        met = _postings_of(index, {(size, gram) for _, _, size, gram, _ in anchors}, sizes)
        asked = spark.createDataFrame(anchors, f"{schema}, gram_size int, gram string, query_start int")
        if starts <= FEW_STARTS:
            near, ids = _near_here(met, anchors, q_type)
            if len(ids):
                out = verify.verified(_slices(near, _holding(index, sentences, ids), longest, True), ["query_id", "sentence_id"], longest).select(MATCH_COLUMNS)
            elif not left:
                return verify.verified(asked.selectExpr("query_id", "q", "0L as sentence_id", "0 as match_start", "'' as t").limit(0), ["query_id", "sentence_id"], longest).select(MATCH_COLUMNS)
        else:
            near = _near(met.join(F.broadcast(asked), ["gram_size", "gram"]))
            out = verify.verified(_slices(near, sentences, longest), ["query_id", "sentence_id"], longest).select(MATCH_COLUMNS)
    if left or out is None:
        scanned = _scan_block(F.broadcast(spark.createDataFrame(left, schema)), sentences, longest)
        out = scanned if out is None else out.unionByName(scanned)
    return out


def query_seeds(queries: DataFrame, sentences: DataFrame, sizes: list[int]) -> DataFrame:
    """`query_id, q, gram_size, gram, query_start, frequency`: all windows of the queries with their corpus frequency, 0 if absent."""
    asked = Asked(queries)
    return _query_seeds(asked.rows, sentences, sizes, asked.small)


def _query_seeds(asked: DataFrame, sentences: DataFrame, sizes: list[int], small: bool, index: dict[str, DataFrame] | None = None) -> DataFrame:
    grams = query_grams(asked, sizes)
    if index:
        frequency = _lookup(index["frequencies"], grams, small).select("gram_size", "gram", "frequency")
    else:
        counted = postings(sentences, sizes).join(_hinted(grams.select("gram_size", "gram").distinct(), small), ["gram_size", "gram"], "left_semi")
        frequency = counted.groupBy("gram_size", "gram").agg(F.count(F.lit(1)).alias("frequency"))
    return grams.join(frequency, ["gram_size", "gram"], "left").select("query_id", "q", "gram_size", "gram", "query_start", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))


def anchor_pairs(seeds: DataFrame) -> DataFrame:
    """Per query and gram size the cheapest pair of windows that don't overlap: least frequency in sum, then leftmost.

    One walk along the query, not a join of its windows with each other: the cheapest window that has ended so far is
    the best partner of the window that begins here.
    """
    here, ends = F.col("query_start"), F.col("query_start") + F.col("gram_size")
    window = F.struct("frequency", "query_start", "gram")
    events = F.array(F.struct(ends.alias("at"), F.lit(0).alias("kind"), window.alias("w")), F.struct(here.alias("at"), F.lit(1).alias("kind"), window.alias("w")))
    along = W.partitionBy("query_id", "q", "gram_size").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = seeds.select("query_id", "q", "gram_size", F.inline(events)).withColumn("first", F.min(F.when(F.col("kind") == 0, F.col("w"))).over(along))
    pairs = rows.where((F.col("kind") == 1) & F.col("first").isNotNull())
    cost = F.col("first.frequency") + F.col("w.frequency")
    best = pairs.groupBy("query_id", "q", "gram_size").agg(F.min(F.struct(cost.alias("cost"), F.col("first.query_start").alias("first_start"), F.col("w.query_start").alias("second_start"), F.col("first.gram").alias("first_gram"), F.col("w.gram").alias("second_gram"))).alias("x"))
    return best.select("query_id", "q", "gram_size", "x.first_gram", "x.first_start", "x.second_gram", "x.second_start", "x.cost")


def anchor_plan(pairs: DataFrame, minimum_anchor_length: int = 2) -> DataFrame:
    """Per query the gram size of least cost, the larger on a tie. Queries without a plan have no row."""
    if minimum_anchor_length < 2:
        raise ValueError("minimum_anchor_length is 2 or more")
    best = W.partitionBy("query_id").orderBy(F.col("cost"), F.col("gram_size").desc())
    return pairs.where(F.length("q") >= minimum_anchor_length).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def _contexts(plan: DataFrame, sentences: DataFrame, sizes: list[int], small: bool, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """`query_id, q, sentence_id, starts` around the occurrences of both anchors; `small` if the plan, two rows a query, may be broadcast."""
    anchors = plan.select("query_id", "q", "gram_size", F.inline(F.array(F.struct(F.col("first_gram").alias("gram"), F.col("first_start").alias("query_start")), F.struct(F.col("second_gram").alias("gram"), F.col("second_start").alias("query_start")))))
    source = _lookup(index["postings"], anchors, small) if index else postings(sentences, sizes)
    return _near(source.join(_hinted(anchors, small), ["gram_size", "gram"]))


def candidate_contexts(plan: DataFrame, sentences: DataFrame, sizes: list[int]) -> DataFrame:
    """Distinct `query_id, q, sentence_id, match_start` around the occurrences of both anchors."""
    return _contexts(plan, sentences, sizes, False).select("query_id", "q", "sentence_id", F.explode("starts").alias("match_start"))


def context_slices(contexts: DataFrame, sentences: DataFrame) -> DataFrame:
    """`query_id, sentence_id, match_start, target_length`: contexts with each length m-1, m, m+1 that stays in bounds."""
    at = contexts.join(sentences.select("sentence_id", F.length("n").alias("len")), "sentence_id")
    m = F.length("q")
    lengths = at.select("query_id", "sentence_id", "match_start", "len", F.explode(F.array(m - 1, m, m + 1)).alias("target_length"))
    return lengths.where((F.col("target_length") > 0) & (F.col("match_start") >= 0) & (F.col("match_start") + F.col("target_length") <= F.col("len"))).select("query_id", "sentence_id", "match_start", "target_length")


def search_bi_anchor(queries: DataFrame, sentences: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), minimum_anchor_length: int = 2, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """The two rarest windows of a query that don't overlap are looked up: one edit leaves one of them whole. Other queries go to the exhaustive scan.

    With the `postings` and `frequencies` of a stored index (`sources.index_store`) the corpus grams aren't made again;
    up to `FEW_QUERIES` queries are then planned on the driver and read just their grams.
    """
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1:
        raise ValueError("gram sizes are positive")
    if index:
        few = queries.where(F.length("q") > 0).select("query_id", "q").limit(FEW_QUERIES + 1).collect()
        if few and len(few) <= FEW_QUERIES and sum(len(r["q"]) for r in few) * len(sizes) <= LOOKUP_GRAMS:
            rows = [(r["query_id"], r["q"]) for r in few]
            return _search_few(rows, queries.schema["query_id"].dataType.simpleString(), sentences, sizes, minimum_anchor_length, index)
    asked = Asked(queries)
    plan = anchor_plan(anchor_pairs(_query_seeds(asked.rows, sentences, sizes, asked.small, index)), minimum_anchor_length)
    if asked.small:
        at, cost = _places(plan)
        if not index or _many(cost, index):
            return _listed(split_at(asked, at), sentences)
    contexts = _contexts(plan, sentences, sizes, asked.small, index)
    found = verify.verified(_slices(contexts, sentences, asked.longest), ["query_id", "sentence_id"], asked.longest).select(MATCH_COLUMNS)
    planned = F.length("q") >= max(minimum_anchor_length, 2 * sizes[0])
    return found.unionByName(_scan(asked.rows.where(~planned), sentences, asked))


def anchored(asked: Asked, sentences: DataFrame, sizes: list[int], minimum_anchor_length: int = 2) -> Splits:
    """A small workload split at the anchors of its plan; at the half where there is no plan."""
    plan = anchor_plan(anchor_pairs(_query_seeds(asked.rows, sentences, sizes, asked.small)), minimum_anchor_length)
    return split_at(asked, _places(plan)[0])


def _places(plan: DataFrame) -> tuple[dict[tuple, tuple[int, int, int]], int]:
    """Gram size and starts of both anchors of each query of a small plan, and how many postings they have in all."""
    rows = plan.select("query_id", "q", "gram_size", "first_start", "second_start", "cost").collect()
    return {(r["query_id"], r["q"]): (r["gram_size"], r["first_start"], r["second_start"]) for r in rows}, sum(r["cost"] for r in rows)


def split_at(asked: Asked, at: dict[tuple, tuple[int, int, int]]) -> Splits:
    return Splits(asked, lambda i, q: scan.anchors(q, *at[i, q]) if (i, q) in at else scan.halves(q), True)


def words(sentences: DataFrame) -> DataFrame:
    """`word, sentence_id, start_pos`: the word table, one row per occurrence."""
    return sentences.where(F.col("n").isNotNull()).select("sentence_id", F.inline(tx.word_positions(F.col("n")))).select("word", "sentence_id", "start_pos")


def seed_index(sentences: DataFrame, sizes: list[int]) -> DataFrame:
    """`gram_size, gram, frequency, is_boundary`: seeds inside words, from the distinct words and their counts, and seeds with a space, from the sentences."""
    vocabulary = words(sentences).groupBy("word").agg(F.count(F.lit(1)).alias("n_word"))
    inside = [vocabulary.select(F.lit(s).alias("gram_size"), F.inline(tx.grams(F.col("word"), s)), "n_word").groupBy("gram_size", "gram").agg(F.sum("n_word").alias("frequency"), F.lit(False).alias("is_boundary")) for s in sizes]
    boundary = postings(sentences, sizes).where(F.col("gram").contains(" ")).groupBy("gram_size", "gram").agg(F.count(F.lit(1)).alias("frequency"), F.lit(True).alias("is_boundary"))
    out = boundary
    for part in inside:
        out = out.unionByName(part)
    return out


def seed_occurrences(seeds: DataFrame, sentences: DataFrame) -> DataFrame:
    """`gram_size, gram, sentence_id, position` for a table of seeds `gram_size, gram`: word references times word occurrences, and boundary seeds."""
    sizes = sorted(r["gram_size"] for r in seeds.select("gram_size").distinct().collect())
    if not sizes:
        return seeds.select("gram_size", "gram", F.lit(None).cast("long").alias("sentence_id"), F.lit(None).cast("int").alias("position")).limit(0)
    asked = seeds.select("gram_size", "gram").distinct()
    occurrences = words(sentences)
    references = None
    for s in sizes:
        part = occurrences.select("word").distinct().select("word", F.lit(s).alias("gram_size"), F.inline(tx.grams(F.col("word"), s)))
        references = part if references is None else references.unionByName(part)
    inside = references.join(asked, ["gram_size", "gram"], "left_semi").join(occurrences, "word").select("gram_size", "gram", "sentence_id", (F.col("start_pos") + F.col("position")).alias("position"))
    boundary = postings(sentences, sizes).join(asked.where(F.col("gram").contains(" ")), ["gram_size", "gram"], "left_semi")
    return inside.unionByName(boundary)


def hybrid_candidates(queries: DataFrame, sentences: DataFrame, q: int = 3) -> DataFrame:
    """Distinct `query_id, q, word`: short words of about the query's length for short queries, else longer words that share a gram."""
    asked = Asked(queries)
    vocabulary = words(sentences).select("word").distinct()
    m, w = F.length("q"), F.length("word")
    of_length = asked.rows.where(m <= SHORT_WORD).select("query_id", "q", F.explode(F.array(m - 1, m, m + 1)).alias("w"))
    short = vocabulary.where(w <= SHORT_WORD).withColumn("w", w).join(_hinted(of_length, asked.small), "w").select("query_id", "q", "word")
    grams = query_grams(asked.rows.where(m > SHORT_WORD), [q]).select("query_id", "q", "gram").distinct()
    of_words = vocabulary.where(w > SHORT_WORD).select("word", F.inline(tx.grams(F.col("word"), q))).select("word", "gram").distinct()
    long = of_words.join(_hinted(grams, asked.small), "gram").select("query_id", "q", "word").distinct()
    return short.unionByName(long)


def hybrid_edits(candidates: DataFrame) -> DataFrame:
    """`query_id, word, edit_type, edit_index, correct_characters`: the query against the start of each word, only the first slot of each kind."""
    q, word, m = F.col("q"), F.col("word"), F.length("q")
    first = lambda matches: F.slice(matches, 1, 1)
    n = F.length("word")
    none = F.array().cast(f"array<{verify.MATCH}>")
    edits = F.concat(
        F.when(n >= m, verify.equal_length(q, F.left(word, m))).otherwise(none),
        F.when(n >= m + 1, first(verify.one_longer(q, F.left(word, m + 1)))).otherwise(none),
        F.when((m >= 2) & (n >= m - 1), first(verify.one_shorter(q, F.left(word, m - 1)))).otherwise(none),
    )
    return candidates.select("query_id", "word", F.inline(edits))


def search_hybrid(queries: DataFrame, sentences: DataFrame, q: int = 3, cap: int = HYBRID_CAP) -> DataFrame:
    """Words whose start is within one edit of the query, at most `cap` results a query, by kind of edit, then word, then place.

    Not the semantics of the other strategies: nothing inside or across words, first slots only, and capped, as documented.
    """
    order = F.when(F.col("edit_type") == "exact", 0).when(F.col("edit_type") == "replacement", 1).when(F.col("edit_type") == "insertion", 2).otherwise(3)
    edits = hybrid_edits(hybrid_candidates(queries, sentences, q)).withColumn("kind", order)
    # words of which the words before them already fill the cap have no result: their occurrences aren't joined
    counted = edits.join(words(sentences).groupBy("word").agg(F.count(F.lit(1)).alias("n_word")), "word")
    upto = F.sum("n_word").over(W.partitionBy("query_id").orderBy("kind", "word").rangeBetween(W.unboundedPreceding, W.currentRow))
    own = F.sum("n_word").over(W.partitionBy("query_id", "kind", "word"))
    first_words = counted.withColumn("before", upto - own).where(F.col("before") < cap).drop("before", "n_word")
    results = first_words.join(words(sentences), "word")
    first = W.partitionBy("query_id").orderBy("kind", "word", "sentence_id", "start_pos")
    kept = results.withColumn("r", F.row_number().over(first)).where(F.col("r") <= cap)
    return kept.select("query_id", "sentence_id", F.col("start_pos").alias("match_start"), "edit_type", "edit_index", "correct_characters")


def matches_at(starts: DataFrame, queries: DataFrame, sentences: DataFrame) -> DataFrame:
    """The matches at the places `query_id, sentence_id, match_start` alone, as the exhaustive scan has them."""
    asked = Asked(queries)
    at = starts.select("query_id", "sentence_id", "match_start").distinct().withColumn("at", F.expr(f"match_start - match_start % {WINDOW}"))
    near = at.groupBy("query_id", "sentence_id", "at").agg(F.collect_set("match_start").alias("starts")).join(_hinted(asked.rows, asked.small), "query_id")
    return verify.verified(_slices(near, sentences, asked.longest), ["query_id", "sentence_id"], asked.longest).select(MATCH_COLUMNS)


def gram_votes(queries: DataFrame, sentences: DataFrame, q: int = 3) -> DataFrame:
    """`query_id, q, sentence_id, votes`: query grams that the sentence has within one place of where the query has them."""
    asked = Asked(queries)
    hits = postings(sentences, [q]).join(_hinted(query_grams(asked.rows, [q]), asked.small), ["gram_size", "gram"])
    near = hits.where(F.abs(F.col("position") - F.col("query_start")) <= 1)
    return near.groupBy("query_id", "q", "sentence_id").agg(F.countDistinct("query_start").alias("votes"))


def select_by_votes(votes: DataFrame, q: int = 3) -> DataFrame:
    """Sentences with as many votes as one edit must leave: max(1, (m-q+1)-q); all of them for queries shorter than q."""
    m = F.length("q")
    return votes.where((m < q) | (F.col("votes") >= F.greatest(F.lit(1), m - q + 1 - q)))
