"""The search index as Parquet tables with a checked description, and report files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import search

VERSION = 3
#: Sentences a folder of the stored table, which is divided by ranges of ids.
PART_ROWS = 1 << 18
#: How posting lists are written: ids and positions as differences.
LISTS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.page.size": 64 << 10, "parquet.block.size": 16 << 20, "parquet.enable.dictionary": False}


def fingerprint(spark: SparkSession, path: str) -> str:
    """md5 of name, size and modification time of a source file, in whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return hashlib.md5(f"{where.getName()}:{status.getLen()}:{status.getModificationTime() // 1000}".encode()).hexdigest()


def check_sentences(sentences: DataFrame) -> DataFrame:
    """`sentences`, or ValueError if ids are missing or not unique: a second sentence of one id would be searched under a wrong text."""
    bad = sentences.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("sentence_id").isNull() | (F.col("n") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"sentence_id {bad[0]['sentence_id']} stands {bad[0]['n']} times")
    return sentences


def save_index(sentences: DataFrame, path: str, sizes: list[int], source_fingerprint: str = "") -> None:
    """Writes sentences, postings and seed frequencies; the description last, so a broken run leaves no valid index.

    A start is stored once, under as many characters as the largest gram has: its smaller grams are what that begins
    with. Each task writes the postings of its own sentences, in runs sorted by these characters, so nothing is exchanged
    for them, a hot gram is the work of all tasks, and a reader of few grams skips the other row groups and pages.
    Frequencies are added up from the lengths of the lists. Ids must be unique.
    """
    if not sizes or min(sizes) < 1:
        raise ValueError("gram sizes are positive")
    sizes = sorted(set(sizes))
    spark = sentences.sparkSession
    check_sentences(sentences)
    ids = sentences.agg(F.min("sentence_id").alias("low"), F.max("sentence_id").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, high, parts = ids["low"] or 0, ids["high"] or 0, max(1, -(-ids["n"] // PART_ROWS))
    part = F.floor((F.col("sentence_id").cast("decimal(38,0)") - low) * parts / (high - low + 1)).cast("long")
    placed = sentences.withColumn("part", part).repartitionByRange("sentence_id").sortWithinPartitions("part", "sentence_id")
    placed.write.mode("overwrite").partitionBy("part").parquet(f"{path}/sentences")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/sentences").select("sentence_id", F.col("normalized_text").alias("n"))
    made = search.posting_lists(stored, sizes)
    made.write.mode("overwrite").options(**LISTS).parquet(f"{path}/postings")
    lists = spark.read.schema(made.schema).parquet(f"{path}/postings").select("tail", "n")
    counted = search.grams_of(lists, sizes).groupBy("gram_size", "gram").agg(F.sum("n").alias("frequency")).repartitionByRange("gram_size", "gram").sortWithinPartitions("gram_size", "gram")
    characters = stored.agg(F.coalesce(F.sum(F.length("n")), F.lit(0)).alias("n")).first()["n"]
    counted.write.mode("overwrite").option("parquet.page.size", 64 << 10).partitionBy("gram_size").parquet(f"{path}/frequencies")
    meta = json.dumps({"version": VERSION, "sizes": sizes, "fingerprint": source_fingerprint, "layout": [low, high, parts], "characters": characters})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def _description(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(f"{path}/description").first()["value"])
    except Exception:  # noqa: BLE001 - any unreadable description means there is no index
        return {}


def index_is_valid(spark: SparkSession, path: str, sizes: list[int], source_fingerprint: str = "") -> bool:
    """True if an index of this version, these gram sizes and this source lies at `path`."""
    meta = _description(spark, path)
    return {k: meta.get(k) for k in ("version", "sizes", "fingerprint")} == {"version": VERSION, "sizes": sorted(sizes), "fingerprint": source_fingerprint}


def load_index(spark: SparkSession, path: str, sizes: list[int], source_fingerprint: str = "") -> dict:
    """sentences, postings and frequencies of a valid index, its posting lists, layout and size; ValueError otherwise, also for sizes that aren't indexed."""
    if not index_is_valid(spark, path, sizes, source_fingerprint):
        raise ValueError(f"no index of version {VERSION} with gram sizes {sizes} and this fingerprint at {path}")
    lists, sentences, frequencies = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "sentences", "frequencies"))
    meta = _description(spark, path)
    return {"sentences": sentences, "frequencies": frequencies, "lists": lists, "postings": search.listed_postings(lists, meta["sizes"]), "layout": tuple(meta["layout"]), "characters": meta["characters"]}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_query_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header; arrays are joined by |, structs and maps become JSON."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(name)
        columns.append((F.concat_ws("|", c) if kind == "array<string>" else F.to_json(c) if kind.startswith(("struct", "map", "array")) else c).alias(name))
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(df: DataFrame) -> str:
    """A report table of all rows of `df`, which should be a summary: the driver formats them one at a time."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join(map(cell, r))} |" for r in df.toLocalIterator())])


def pending(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries of a resumed evaluation that have no result yet."""
    return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")
