"""Evaluation of strategies: corpus and index statistics, latency summaries, correctness, speedups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import search

#: Medians within this share of the fastest tie with it.
TIE = 0.02
PERCENTILES = (50, 75, 90, 95, 99)
#: Rows of one side of a comparison up to which their hashes are broadcast.
BROADCAST_KEYS = 2_000_000


def disc(column: str, p: float, kind: str = "double") -> Column:
    """Nearest-rank percentile of a column: the value at rank ceil(n * p / 100), as the type `kind`; never interpolated."""
    return F.expr(f"percentile_disc({p / 100}) within group (order by {column})").cast(kind)


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def corpus_stats(sentences: DataFrame) -> DataFrame:
    """One row: files, sentences, characters, words, unique words, and the distribution of sentence lengths. `sentences` has source_path and n."""
    rows = sentences.where(F.col("n").isNotNull())
    lengths = rows.select("source_path", F.length("n").alias("len"), F.size(F.filter(F.split("n", " "), lambda w: w != "")).alias("words"))
    whole = lengths.agg(
        F.countDistinct("source_path").alias("files"), F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum("len"), F.lit(0)).alias("characters"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.min("len").alias("length_min"), F.avg("len").alias("length_mean"), F.median("len").alias("length_median"), *[disc("len", p, "int").alias(f"length_p{p}") for p in PERCENTILES[1:]], F.max("len").alias("length_max"),
    )
    unique = rows.select(F.explode(F.split("n", " ")).alias("w")).where("w <> ''").select("w").distinct().agg(F.count(F.lit(1)).alias("unique_words"))
    return beside(whole, unique)


def index_stats(sentences: DataFrame, sizes: list[int]) -> DataFrame:
    """`gram_size, distinct_grams, occurrences`, per size and, with a null size, in total."""
    per = search.seed_frequency(sentences, sizes)
    return per.rollup("gram_size").agg(F.count(F.lit(1)).alias("distinct_grams"), F.sum("frequency").alias("occurrences"))


def structure_metrics(sentences: DataFrame, sizes: list[int]) -> DataFrame:
    """Per gram size: longest, median, p95 and p99 posting list."""
    per = search.seed_frequency(sentences, sizes)
    return per.groupBy("gram_size").agg(F.max("frequency").alias("max_postings"), F.median("frequency").alias("median_postings"), disc("frequency", 95, "long").alias("p95_postings"), disc("frequency", 99, "long").alias("p99_postings"))


def trie_nodes(sentences: DataFrame) -> DataFrame:
    """One row: nodes, edges and terminals of the trie of all words; nodes are the distinct prefixes and the root."""
    vocabulary = search.words(sentences).select("word").distinct()
    prefixes = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.left(F.col("word"), i))).alias("p")).distinct()
    return beside(prefixes.agg((F.count(F.lit(1)) + 1).alias("nodes"), F.count(F.lit(1)).alias("edges")), vocabulary.agg(F.count(F.lit(1)).alias("terminals")))


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """`by + n, mean, median, stdev, min, p95, max` of `value`; stdev is 0 for one sample, p95 null below 5."""
    return samples.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"),
        F.min(value).alias("min"), F.when(F.count(F.lit(1)) >= 5, disc(value, 95)).alias("p95"), F.max(value).alias("max"),
    )


def win_rates(medians: DataFrame) -> DataFrame:
    """Per algorithm of `query_id, algorithm_id, median`: queries, outright wins, ties, and wins with ties split evenly."""
    fastest = W.partitionBy("query_id")
    marked = medians.withColumn("best", F.min("median").over(fastest)).withColumn("w", (F.col("median") <= F.col("best") * (1 + TIE)).cast("int")).withColumn("n_w", F.sum("w").over(fastest))
    return marked.groupBy("algorithm_id").agg(
        F.count(F.lit(1)).alias("queries"), F.sum(F.when((F.col("w") == 1) & (F.col("n_w") == 1), 1).otherwise(0)).alias("wins"), F.sum(F.when((F.col("w") == 1) & (F.col("n_w") > 1), 1).otherwise(0)).alias("ties"),
        F.sum(F.when(F.col("w") == 1, 1.0 / F.col("n_w")).otherwise(0.0)).alias("split_wins"),
    )


def speedups(medians: DataFrame, baseline: str) -> DataFrame:
    """Per other algorithm: median, mean, p75, p90, best and worst of baseline / own median."""
    base = medians.where(F.col("algorithm_id") == baseline).select("query_id", F.col("median").alias("b"))
    ratio = medians.where(F.col("algorithm_id") != baseline).join(base, "query_id").withColumn("r", F.col("b") / F.greatest(F.lit(1.0), F.col("median")))
    return ratio.groupBy("algorithm_id").agg(F.median("r").alias("median"), F.avg("r").alias("mean"), disc("r", 75).alias("p75"), disc("r", 90).alias("p90"), F.max("r").alias("best"), F.min("r").alias("worst"))


def break_even(medians: DataFrame, builds: DataFrame, baseline: str) -> DataFrame:
    """`algorithm_id, queries`: after how many queries the longer build has paid; null if it never does. `builds` is `algorithm_id, build`."""
    base = medians.where(F.col("algorithm_id") == baseline).select("query_id", F.col("median").alias("b"))
    saving = medians.where(F.col("algorithm_id") != baseline).join(base, "query_id").groupBy("algorithm_id").agg(F.avg(F.col("b") - F.col("median")).alias("s"))
    own = builds.where(F.col("algorithm_id") == baseline).select(F.col("build").alias("base_build"))
    return saving.join(builds, "algorithm_id").withColumn("__one", F.lit(1)).join(F.broadcast(own.withColumn("__one", F.lit(1))), "__one").select("algorithm_id", F.when(F.col("s") > 0, F.ceil(F.greatest(F.lit(0.0), F.col("build") - F.col("base_build")) / F.col("s"))).cast("long").alias("queries"))


def compare_results(oracle: DataFrame, actual: DataFrame, columns: list[str], few: bool = False) -> DataFrame:
    """Per query_id: false negatives, false positives and the common part of two multisets of matches.

    If `actual` has up to BROADCAST_KEYS rows, the hashes of its rows are broadcast, and rows of the oracle that equal none
    of them are counted where they are found; only the others meet in an exchange, whole, so equal hashes decide nothing.
    `few`: the oracle's rows are known to be few, and all are exchanged.
    """
    tag = lambda df, side: df.select(*columns, F.lit(side).alias("s"))
    both = tag(oracle, 1).unionByName(tag(actual, 0))
    if not few and actual.count() <= BROADCAST_KEYS:
        hashes = actual.select(F.xxhash64(*columns).alias("h")).distinct().withColumn("known", F.lit(True))
        met = tag(oracle, 1).withColumn("h", F.xxhash64(*columns)).join(F.broadcast(hashes), "h", "left").drop("h").withColumn("known", F.coalesce("known", F.lit(False)))
        rest = [c for c in columns if c != "query_id"]
        met = met.select("query_id", "s", "known", *[F.when(F.col("known"), F.col(c)).alias(c) for c in rest])
        both = met.unionByName(tag(actual, 0).withColumn("known", F.lit(True)))
        columns = [*columns, "known"]
    per = both.groupBy(*columns).agg(F.sum("s").alias("o"), F.sum(1 - F.col("s")).alias("a"))
    return per.groupBy("query_id").agg(F.sum(F.greatest(F.lit(0), F.col("o") - F.col("a"))).alias("false_negatives"), F.sum(F.greatest(F.lit(0), F.col("a") - F.col("o"))).alias("false_positives"), F.sum(F.least("o", "a")).alias("common"))


def match_signature(matches: DataFrame, columns: list[str]) -> DataFrame:
    """Per query_id `n, sums`: the number of its rows, and the sums of the four halves of two 64-bit hashes of each; an order-independent mark of a multiset."""
    hashes = [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]
    halves = [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.sum, halves)).alias("sums"))


def missing_pairs(rows: DataFrame, queries: DataFrame, algorithms: list[str]) -> DataFrame:
    """`query_id, algorithm_id` that an evaluation should have and hasn't."""
    wanted = queries.select("query_id", F.explode(F.array(*[F.lit(a) for a in algorithms])).alias("algorithm_id"))
    return wanted.join(rows.select("query_id", "algorithm_id").distinct(), ["query_id", "algorithm_id"], "left_anti")


def unexpected_pairs(rows: DataFrame, queries: DataFrame, algorithms: list[str]) -> DataFrame:
    """`query_id, algorithm_id` that an evaluation has and shouldn't have: of other queries or strategies."""
    known = queries.select("query_id").distinct().withColumn("k", F.lit(True))
    pairs = rows.select("query_id", "algorithm_id").distinct().join(known, "query_id", "left")
    return pairs.where(F.col("k").isNull() | ~F.col("algorithm_id").isin(algorithms)).select("query_id", "algorithm_id")


def signature(matches: DataFrame, columns: list[str]) -> DataFrame:
    """Per query_id an order-independent signature of a multiset: count, and sums of two 32-bit halves of an md5; null differs from the empty string."""
    keyed = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    digest = F.md5(F.concat_ws("\u0001", *keyed).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(half(1)).alias("sum_1"), F.sum(half(9)).alias("sum_2"))


def naive_work(queries: DataFrame, sentences: DataFrame) -> DataFrame:
    """Per query the slices an exhaustive scan verifies, in closed form from the histogram of sentence lengths."""
    lengths = sentences.where(F.col("n").isNotNull()).groupBy(F.length("n").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    m = queries.where(F.length("q") > 0).select("query_id", F.length("q").alias("m"), F.explode(F.array(F.length("q") - 1, F.length("q"), F.length("q") + 1)).alias("l")).where("l > 0")
    per = m.select("l").distinct().join(lengths, F.col("len") >= F.col("l")).groupBy("l").agg(F.sum((F.col("len") - F.col("l") + 1) * F.col("c")).alias("slices"))
    return m.join(per, "l", "left").groupBy("query_id").agg(F.coalesce(F.sum("slices"), F.lit(0)).cast("long").alias("verifier_calls"))


def work_summary(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """`by + metric, mean, median, p95, max` of each metric column."""
    long = rows.select(*by, *[F.col(m).cast("long").alias(m) for m in metrics]).unpivot(by, metrics, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), disc("value", 95, "long").alias("p95"), F.max("value").alias("max"))


def by_length(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """`length_bucket, queries, with_results, results` of `query_id, q` and `query_id, results`; buckets without a query have zeros."""
    spark = queries.sparkSession
    names = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(tx.LENGTH_BUCKETS)], "o int, length_bucket string")
    rows = queries.select("query_id", tx.length_bucket(F.length("q")).alias("length_bucket")).join(counts, "query_id", "left")
    per = rows.groupBy("length_bucket").agg(F.count(F.lit(1)).alias("queries"), F.count("results").alias("with_results"), F.coalesce(F.sum("results"), F.lit(0)).alias("results"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return F.broadcast(names).join(per, "length_bucket", "left").select("length_bucket", zero("queries"), zero("with_results"), zero("results"))


def by_category(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """`category, queries, results`, a query counted under each of its categories once."""
    rows = queries.select("query_id", F.explode(F.array_distinct("categories")).alias("category")).join(counts, "query_id", "left")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("results"), F.lit(0)).cast("long").alias("results"))


def extremes(rows: DataFrame, by: str, value: str, n: int, worst: bool = True) -> DataFrame:
    """The n queries with the highest (or lowest) value per group, ties by query_id."""
    order = W.partitionBy(by).orderBy(F.col(value).desc() if worst else F.col(value).asc(), "query_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
