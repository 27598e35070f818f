"""Workloads of real text: every class of query that an evaluation must hold, drawn by hash, over the whole corpus.

Both workloads are unions of small draws. Every draw is the top of an order by a hash with a seed (`workload.draw`), so
the same corpus gives the same queries on every cluster; frequencies are counted over all sentences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.operators.workload import SEED, draw

LENGTHS = (1, 2, 3, 4, 5, 6)
# Characters to build strings from that occur nowhere, tried in this order.
UNUSUAL = "qzxjkvwy0123456789"
# The tags that a real workload must hold.
REQUIRED_TAGS = (
    "short_exact", "medium_exact", "long_exact", "inside_word", "cross_word", "replacement", "insertion", "deletion", "repeated",
    "common_qgram", "medium_qgram", "rare_qgram", "no_match", "near_boundary", "multiple_matches", "high_frequency",
)
#: What a query that matches nothing begins with; `z` is added until it stands nowhere.
NOWHERE = "zzzzz nowhere near"
COLUMNS = ["q", "tags", "mutation", "source_sentence_id", "expected_start"]


def _rows(df: DataFrame, q: Column, tags: str, mutation: str = "exact", start: Column | None = None) -> DataFrame:
    """Rows of `df` (`sentence_id, start_pos`) as queries; `tags` are names with a blank between."""
    at = F.col("start_pos") + (0 if start is None else start)
    return df.select(
        q.alias("q"), F.array(*map(F.lit, tags.split())).alias("tags"), F.lit(mutation).alias("mutation"),
        F.col("sentence_id").alias("source_sentence_id"), at.cast("int").alias("expected_start"),
    )


def _first(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """The n rows that come first in the draw `salt`."""
    return df.withColumn("__d", draw(F.concat(F.lit(f"{salt}:"), F.col(key)), SEED)).orderBy("__d", key).limit(n).drop("__d")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Equal queries as one, with all their tags; what the first draft (by mutation, sentence, place) says about its source."""
    drafts = reduce(DataFrame.unionByName, parts).where(F.length(F.trim("q")) > 0)
    source = F.struct("mutation", "source_sentence_id", "expected_start")
    merged = drafts.select("q", F.explode("tags").alias("tag"), source.alias("s")).groupBy("q").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.min("s").alias("s"))
    return merged.select("q", F.array_join("tags", "|").alias("tags"), "s.*")


def distinct_words(sentences: DataFrame) -> DataFrame:
    """`word, n, sentence_id, start_pos`: each word with its count and its first place."""
    return search.words(sentences).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sentence_id", "start_pos")).alias("at")).select("word", "n", "at.*")


def short_workload(sentences: DataFrame, per_length: int = 40) -> DataFrame:
    """`length, q, tags, mutation, source_sentence_id, expected_start`: the same mix of classes for each length from 1 to 6.

    Commonest and rarest grams, pieces of words, pieces across words, the three one-edit mutations, and a string that
    stands nowhere, if there is one. An empty corpus gives only strings that stand nowhere.
    """
    if per_length < 6:
        raise ValueError("per_length is 6 or more: every class needs a query")
    words = distinct_words(sentences)
    out = []
    for size in LENGTHS:
        grams = search.postings(sentences, [size]).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sentence_id", "position")).alias("at"))
        grams = grams.select("gram", "n", "at.sentence_id", F.col("at.position").alias("start_pos"))
        crosses = F.substring("gram", 2, size).contains(" ")
        parts = []
        for tag, order in (("common_seed", [F.col("n").desc(), "gram"]), ("rare_seed", [F.col("n"), F.col("gram").desc()])):
            top = grams.orderBy(*order).limit(3)
            parts += [_rows(top.where(crosses), F.col("gram"), f"{tag} exact cross_word"), _rows(top.where(~crosses), F.col("gram"), f"{tag} exact inside_word")]
        middle = F.floor((F.length("word") - size) / 2).cast("int")
        inside = _first(words.where(F.length("word") >= size), "word", per_length // 3, f"inside{size}")
        parts.append(_rows(inside, F.substring("word", middle + 1, F.lit(size)), "exact inside_word", start=middle))
        parts.append(_rows(_first(grams.where(crosses), "gram", max(2, per_length // 6), f"cross{size}"), F.col("gram"), "exact cross_word"))
        mutable = _first(words.where(F.length("word") > size), "word", per_length // 6, f"mutate{size}")
        head = F.left("word", F.lit(size - 1))
        other = F.when(F.left("word", F.lit(1)) == "q", "w").otherwise("q")
        parts.append(_rows(mutable, F.concat(other, F.substring("word", 2, size - 1)), "replacement inside_word", "replacement"))
        if size > 1:
            parts.append(_rows(mutable, F.concat(head, F.substring("word", size + 1, 1)), "insertion inside_word", "missing_character"))
        parts.append(_rows(mutable, F.concat(head, F.lit("q")), "deletion inside_word", "extra_character"))
        tried = [c * size for c in UNUSUAL] + [((a + b) * size)[:size] for a in UNUSUAL for b in UNUSUAL]
        spark = sentences.sparkSession
        candidates = spark.createDataFrame(list({t: i for i, t in reversed(list(enumerate(tried)))}.items()), "gram string, i int")
        absent = candidates.join(grams.select("gram"), "gram", "left_anti").orderBy("i").limit(1)
        nowhere = absent.select("gram", F.lit(None).cast("long").alias("sentence_id"), F.lit(None).cast("int").alias("start_pos"))
        parts.append(_rows(nowhere, F.col("gram"), "no_match", "near_miss"))
        out.append(_merged(parts).select(F.lit(size).alias("length"), *COLUMNS))
    return reduce(DataFrame.unionByName, out)


def real_workload(sentences: DataFrame, fill: int = 32) -> DataFrame:
    """`q, tags, mutation, source_sentence_id, expected_start`: at least one query of every required tag, and `fill` words more.

    One query may have several tags. Tags whose text the corpus lacks (a word of seven characters, say) stay away.
    """
    words = distinct_words(sentences)
    rows = sentences.where(F.length("n") > 0).select("sentence_id", "n", F.lit(0).alias("start_pos"), F.col("sentence_id").cast("string").alias("id"))
    longer = lambda n: words.where(F.length("word") >= n)
    w = F.col("word")
    parts = [_rows(_first(longer(n), "word", 1, f"short{n}"), F.left(w, F.lit(n)), "short_exact inside_word") for n in range(1, 6)]
    parts.append(_rows(_first(words.where(F.length("word").between(6, 15)), "word", 1, "medium"), w, "medium_exact inside_word"))
    parts.append(_rows(_first(rows.where(F.length("n") >= 16), "id", 1, "long"), F.trim(F.left("n", F.lit(24))), "long_exact"))
    parts.append(_rows(_first(longer(8), "word", 1, "inside"), F.substring("word", 3, 5), "inside_word", start=F.lit(2)))
    gap = F.instr("n", " ")
    begin = F.greatest(F.lit(1), gap - 3)
    parts.append(_rows(_first(rows.where(gap > 0), "id", 1, "cross"), F.substring(F.col("n"), begin, gap + 4 - begin), "cross_word", start=begin - 1))
    mutable = _first(longer(7), "word", 1, "mutate")
    third = F.when(F.substring("word", 3, 1) == "x", "z").otherwise("x")
    parts.append(_rows(mutable, F.concat(F.left(w, F.lit(2)), third, F.substring("word", 4, 1 << 20)), "replacement inside_word", "replacement"))
    parts.append(_rows(mutable, F.concat(F.left(w, F.lit(3)), F.substring("word", 5, 1 << 20)), "insertion inside_word", "missing_character"))
    parts.append(_rows(mutable, F.concat(F.left(w, F.lit(3)), F.lit("x"), F.substring("word", 4, 1 << 20)), "deletion inside_word", "extra_character"))
    twice = F.size(F.array_distinct(F.split("word", ""))) < F.length("word")
    parts.append(_rows(_first(words.where(twice), "word", 1, "repeated"), w, "repeated inside_word"))
    of_words = longer(6).select("word", "n", F.inline(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.struct(F.substring(w, i, F.lit(3)).alias("gram")))))
    grams = of_words.groupBy("gram").agg(F.sum("n").alias("n"))
    ends = grams.agg(F.max(F.struct("n", "gram")).alias("common_qgram"), F.min(F.struct("n", "gram")).alias("rare_qgram"), F.expr("percentile_disc(0.5) within group (order by n)").alias("m")).first()
    chosen = {k: ends[k]["gram"] for k in ("common_qgram", "rare_qgram") if ends[k]}
    if ends["m"] is not None:
        chosen["medium_qgram"] = grams.where(F.col("n") == ends["m"]).agg(F.min("gram")).first()[0]
    for tag, gram in chosen.items():
        parts.append(_rows(_first(longer(6).where(w.contains(gram)), "word", 1, tag), w, f"{tag} inside_word"))
    held = rows.where(F.col("n").contains(NOWHERE)).select(F.explode(F.regexp_extract_all("n", F.lit(f"{NOWHERE}(z*)"), 1)).alias("z"))
    nowhere = held.agg(F.concat(F.lit(NOWHERE), F.repeat(F.lit("z"), F.coalesce(F.max(F.length("z")) + 1, F.lit(0)))).alias("word"))
    parts.append(_rows(nowhere.select("word", F.lit(None).cast("long").alias("sentence_id"), F.lit(None).cast("int").alias("start_pos")), w, "no_match", "near_miss"))
    edge = _first(rows.where(F.length("n") >= 8), "id", 1, "edge")
    parts.append(_rows(edge, F.trim(F.left("n", F.lit(8))), "near_boundary"))
    parts.append(_rows(edge, F.trim(F.right("n", F.lit(8))), "near_boundary", start=F.length("n") - 8))
    parts.append(_rows(longer(6).orderBy(F.col("n").desc(), F.col("word").desc()).limit(1), w, "multiple_matches high_frequency inside_word"))
    filler = _first(longer(2), "word", fill, "fill")
    parts += [_rows(filler.where(F.length("word") <= 15), w, "medium_exact inside_word"), _rows(filler.where(F.length("word") > 15), w, "long_exact inside_word")]
    return _merged(parts).select(*COLUMNS)


def by_source(df: DataFrame, source: str, row_id: str) -> DataFrame:
    """The first row of every source, in the order of ids: a small workload then spans the sources."""
    first = W.partitionBy(source).orderBy(row_id)
    return df.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
