"""Query workloads and samples drawn from a corpus. Picks are ordered by a hash with a seed, so they are the same on every cluster."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import search
from textloom.operators.numbering import row_numbers


#: The seed of all draws; any other gives samples of the same kind.
SEED = 7141


def draw(key: Column, seed: int) -> Column:
    """A pseudo-random order of keys, the same in any SQL engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_order(df: DataFrame, source: str, row_id: str, seed: int = SEED) -> DataFrame:
    """Adds `turn` (the row's number within its source) and `source_draw`: ordered by both, sources take turns.

    Rows are numbered over all sources at once, by range, and each source's first number is taken off, so that a source
    with most of the rows isn't sorted by one task.
    """
    drawn = df.withColumn("__draw", draw(F.col(row_id), seed)).withColumn("source_draw", draw(F.col(source), seed))
    numbered = row_numbers(drawn, [source, "__draw", row_id], "__n")
    first = numbered.groupBy(F.col(source).alias("__source")).agg(F.min("__n").alias("__first"))
    joined = numbered.join(first, F.col(source).eqNullSafe(F.col("__source")))
    return joined.withColumn("turn", (F.col("__n") - F.col("__first") + 1).cast("int")).drop("__draw", "__n", "__first", "__source")


def _cut(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows by `keys`, numbered by range: no task holds more than a range of them, however large n is."""
    return row_numbers(df, keys, "__n").where(F.col("__n") < n).drop("__n")


def stratified_slice(df: DataFrame, source: str, row_id: str, fraction: float, seed: int = SEED) -> DataFrame:
    """ceil(n * fraction) rows, the sources taking turns."""
    n = ceil(df.count() * fraction)
    return _cut(stratified_order(df, source, row_id, seed), ["turn", "source_draw", row_id], n).drop("turn", "source_draw")


def prefix_slice(df: DataFrame, row_id: str, percent: float) -> DataFrame:
    """The first ceil(n * percent / 100) rows by id."""
    return _cut(df, [row_id], ceil(df.count() * percent / 100))


def even_slice(df: DataFrame, row_id: str, wanted: int) -> DataFrame:
    """`wanted` rows at even distances in id order: places round-half-even(i * (n-1) / (wanted-1)); all rows if there are no more."""
    n = df.count()
    if wanted >= n:
        return df
    places = [0] if wanted == 1 else [round(i * (n - 1) / (wanted - 1)) for i in range(wanted)]
    spark = df.sparkSession
    numbered = row_numbers(df, [row_id], "__n")
    return numbered.join(F.broadcast(spark.createDataFrame([(p,) for p in sorted(set(places))], "__n long")), "__n").drop("__n")


def number(key: Column) -> Column:
    """A number of 32 bits that looks random, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def _row(q: Column, category: str, mutation: str | None, sentence: str = "sentence_id", start: Column | None = None) -> list[Column]:
    return [q.alias("q"), F.lit(category).alias("category"), F.lit(mutation).cast("string").alias("mutation_type"), F.col(sentence).alias("source_sentence_id"), (F.lit(0) if start is None else start).cast("int").alias("source_start")]


def _few(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    return df.orderBy(draw(key, seed), key).limit(n)


# The categories of a generated workload, as the tables name them; and what a query that matches nothing is.
EXACT, WHOLE, INSIDE, CROSS, START, END, NEAR, NONE = "exact", "whole_word", "inside_word", "cross_word", "boundary_near_start", "boundary_near_end", "near_miss", "no_match"
DERIVED = "real_derived_no_match"


def generate(sentences: DataFrame, per_category: int = 50, seed: int = SEED) -> DataFrame:
    """A workload from `sentence_id, n`: `query_id, query_text, query_length, length_bucket, primary_category, categories, mutation_type, source_sentence_id, source_start`.

    Substrings of lengths 1 to 6, whole words, pieces inside words, pieces across words, both ends of sentences, the
    three one-edit mutations, the grams at the percentiles of frequency, and words that occur nowhere. Equal queries are merged, with all their categories.
    """
    rows = sentences.where(F.length("n") > 0)
    places = search.words(rows)
    distinct_words = places.groupBy("word").agg(F.min(F.struct("sentence_id", "start_pos")).alias("at")).select("word", "at.*")
    w, n = F.col("word"), F.col("n")
    parts = []
    for size in range(1, 7):
        start = (number(F.concat_ws(":", F.lit(str(seed)), F.lit(str(size)), F.col("sentence_id").cast("string"))) % (F.length("n") - size + 1)).cast("int")
        made = rows.where(F.length("n") >= size).withColumn("start", start).withColumn("q", F.substring("n", F.col("start") + 1, F.lit(size))).where(F.trim("q") == F.col("q"))
        parts.append(_few(made, F.col("sentence_id"), per_category, seed + size).select(*_row(F.col("q"), EXACT, None, start=F.col("start"))))
    for category, words_, q in (
        (WHOLE, distinct_words.where(F.length("word") >= 2), w),
        (INSIDE, distinct_words.where(F.length("word") >= 7), F.substring("word", 2, F.least(F.lit(8), F.length("word") - 2))),
    ):
        parts.append(_few(words_, w, per_category, seed + 10).select(*_row(q, category, None, start=F.col("start_pos") + (0 if category == WHOLE else 1))))
    first_gap = F.instr("n", " ")
    spaced = rows.where(first_gap > 0)
    begin = F.greatest(F.lit(1), first_gap - 4)
    parts.append(_few(spaced, F.col("sentence_id"), per_category, seed + 20).select(*_row(F.trim(F.substring("n", begin, first_gap + 5 - begin + 1)), CROSS, None, start=begin - 1)))
    long = rows.where(F.length("n") >= 6)
    parts.append(_few(long, F.col("sentence_id"), per_category, seed + 21).select(*_row(F.trim(F.left(n, F.lit(12))), START, None)))
    parts.append(_few(long, F.col("sentence_id"), per_category, seed + 22).select(*_row(F.trim(F.right(n, F.lit(12))), END, None, start=F.greatest(F.lit(0), F.length("n") - 12))))
    mutable = _few(distinct_words.where(F.length("word") >= 6), w, per_category, seed + 30)
    at = (1 + number(w) % (F.length("word") - 2)).cast("int")
    mutated = mutable.select("sentence_id", "start_pos", F.inline(tx.mutations(w, at)))
    parts.append(mutated.select(F.col("text").alias("q"), F.lit(NEAR).alias("category"), F.col("mutation").alias("mutation_type"), F.col("sentence_id").alias("source_sentence_id"), F.col("start_pos").alias("source_start")))
    absent = _few(distinct_words, w, per_category, seed + 40).withColumn("q", F.concat("word", F.lit("zz"), F.left(F.md5(w.cast("binary")), F.lit(3)))).join(distinct_words.select(F.col("word").alias("q")), "q", "left_anti")
    probes = frequency_probes(rows).where(F.trim("gram") == F.col("gram"))
    parts.append(probes.select(F.col("gram").alias("q"), F.concat(F.lit("frequency_"), F.col("frequency_band")).alias("category"), F.lit(None).cast("string").alias("mutation_type"), F.lit(None).cast("long").alias("source_sentence_id"), F.lit(None).cast("int").alias("source_start")))
    parts.append(absent.select(*_row(F.lower("q"), NONE, DERIVED, start=F.col("start_pos"))))
    drafts = parts[0]
    for p in parts[1:]:
        drafts = drafts.unionByName(p)
    merged = drafts.where(F.col("q") != "").groupBy("q").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.min(F.struct("category", "mutation_type", "source_sentence_id", "source_start")).alias("x"))
    return merged.select(
        F.concat(F.lit("w"), F.left(F.md5("q"), F.lit(10))).alias("query_id"), F.col("q").alias("query_text"), F.length("q").alias("query_length"), tx.length_bucket(F.length("q")).alias("length_bucket"),
        F.col("x.category").alias("primary_category"), "categories", "x.mutation_type", "x.source_sentence_id", "x.source_start",
    )


def frequency_probes(sentences: DataFrame, size: int = 3, percents: tuple[int, ...] = (50, 75, 90, 95, 99)) -> DataFrame:
    """`frequency_band, gram, frequency`: the gram at each nearest-rank percentile of corpus frequency, the least gram among equals, and the rarest."""
    per = search.seed_frequency(sentences, [size])
    marks = per.agg(*[F.expr(f"percentile_disc({p / 100}) within group (order by frequency)").cast("long").alias(f"p{p}") for p in percents], F.min("frequency").alias("rare"))
    bands = marks.unpivot([], [*[f"p{p}" for p in percents], "rare"], "frequency_band", "frequency")
    return per.join(F.broadcast(bands), "frequency").groupBy("frequency_band", "frequency").agg(F.min("gram").alias("gram"))


def execution_subset(queries: DataFrame, least_length: int = 6) -> DataFrame:
    """Per category the first query (by id) of at least `least_length` characters: `category, query_id`."""
    rows = queries.where(F.col("query_length") >= least_length).select("query_id", F.explode("categories").alias("category"))
    return rows.groupBy("category").agg(F.min("query_id").alias("query_id"))


#: Words of the made-up corpora.
VOCABULARY = ("harbor", "lantern", "meadow", "orchard", "pebble", "ribbon", "saddle", "thicket")


def synthetic_corpus(spark: SparkSession, kind: str, n: int = 300) -> DataFrame:
    """`sentence_id, n`: a made-up corpus of `n` sentences: synthetic, repetitive, high_frequency or cross_word."""
    ids = spark.range(n).withColumnRenamed("id", "sentence_id")
    place = lambda k: F.floor((F.col("sentence_id") + 1) * (k + 2) * 6007 / 13) % 8 + 1
    pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in VOCABULARY]), place(k).cast("int"))
    forms = {
        "synthetic": F.concat_ws(" ", *[pick(k) for k in range(10)]),
        "repetitive": F.when(F.col("sentence_id") % 2 == 0, F.repeat(F.lit("oo"), 45)).otherwise(F.trim(F.repeat(F.lit("so it "), 15))),
        "high_frequency": F.concat(F.lit("one usual remark about item "), (F.col("sentence_id") % 10).cast("string")),
        "cross_word": F.concat(F.lit("sliding corner "), F.col("sentence_id").cast("string"), F.lit(" wing cover")),
    }
    if kind not in forms:
        raise ValueError(f"kind is one of {sorted(forms)}")
    return ids.select("sentence_id", forms[kind].alias("n"))
