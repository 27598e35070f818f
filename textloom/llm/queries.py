"""Queries p1_ to p8_: each takes a session and a data folder and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import canonical, encoding, frequency, leakage, packing, topn, truncation
from textloom.session import table


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    sentences, candidates, queries = (table(spark, folder, t) for t in ("prepared_sentences", "seed_candidates", "queries"))
    one = lambda c: F.array(F.col(c).cast("string"))
    return (
        frequency.marked_frequencies(sentences.select("word_positions"), F.col("word_positions.word"), "word")
        .unionByName(frequency.marked_frequencies(candidates.select("frequency"), one("frequency"), "frequency"))
        .unionByName(frequency.marked_frequencies(queries.select("qgram_frequency"), one("qgram_frequency"), "qgram_frequency"))
    )


def p1_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder).where(F.col("mark").isNotNull()).select("field_name", "term_value")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = canonical.same_look_pairs(table(spark, folder, "prepared_sentences"), "sentence_id", "original_text")
    return pairs.select(F.col("id_a").alias("sentence_id_a"), F.col("id_b").alias("sentence_id_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a look-alike of another text, by class."""
    return canonical.same_look_classes(table(spark, folder, "prepared_sentences"), "sentence_id", "original_text")


def p2_consistent_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "prepared_sentences")
    return rows.select("sentence_id", canonical.canonical_column(F.col("original_text")).alias("consistent_text"), canonical.canonical_column(F.col("normalized_text")).alias("consistent_normalized"))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "text_files").select(F.lit("text_files").alias("table_name"), F.col("file_id").alias("record_id"), F.col("content").alias("text"))
    lines = table(spark, folder, "prepared_sentences").select(F.lit("prepared_sentences").alias("table_name"), F.col("sentence_id").alias("record_id"), F.col("original_text").alias("text"))
    return encoding.find_garbled(files.unionByName(lines), ["table_name", "record_id"], "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_repaired(spark, folder).select("table_name", "record_id")


def p5_top_records(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, folder, "completions"), "query_id", ["completed_sentence", "source_text", "line_no"], "score", 5)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_top_records(spark, folder).select("query_id", "source_text", "line_no")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), "doc_id", "text")


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the packed documents, and how often a rule of packing is broken."""
    packed = p6_packed(spark, folder)
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max("piece").alias("last"), F.sum("token_start").alias("starts"))
    k, c = F.col("pieces"), packing.CAPACITY
    broken = (F.col("last") != k - 1) | (F.col("starts") != c * k * (k - 1) / 2) | (k != F.ceil(F.col("n") / c))
    docs = per.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(broken.cast("long")), F.lit(0)).alias("documents_split_wrongly"))
    loads = packed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.countDistinct("slot").alias("d"), F.max("slot").alias("last"))
    bad = (F.col("n") > c) | (F.col("d") != F.col("k")) | (F.col("last") != F.col("k") - 1)
    sequences = loads.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("sequences_broken"), (F.sum("n") >= 0.98 * c * F.count(F.lit(1))).alias("filled"))
    return docs.withColumn("one", F.lit(1)).join(sequences.withColumn("one", F.lit(1)), "one").drop("one")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).where(F.col("run_words") >= 12).select("doc_id", "item_id")


def p8_truncated(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.find_truncated(table(spark, folder, "documents"), "doc_id", "text", "source")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_truncated(spark, folder).select("doc_id")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (p1_found, p1_frequencies, p2_found, p2_classes, p2_consistent_text, p4_found, p4_repaired, p5_found, p5_top_records, p6_packed, p6_invariants, p7_found, p7_leaks, p8_found, p8_truncated, p8_rates)
    }


def oracle_sql() -> dict[str, str]:
    from textloom.llm.oracle import SQL

    return SQL
