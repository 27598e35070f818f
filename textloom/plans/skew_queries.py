"""Problem 3: per-key results where a handful of keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import skew
from textloom.session import table


def p3_key_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of all keys of both fields."""
    occurrences = skew.key_counts(table(spark, folder, "seed_occurrences"), "sentence_id", row_id="occurrence_id")
    candidates = skew.key_counts(table(spark, folder, "seed_candidates"), "text", row_id="candidate_id")
    return occurrences.select(F.lit("SeedOccurrence.sentence_id").alias("field_name"), F.col("sentence_id").cast("string").alias("key_value"), "n_rows", "share").unionByName(
        candidates.select(F.lit("SeedCandidate.text").alias("field_name"), F.col("text").alias("key_value"), "n_rows", "share")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with at least 2 % of all rows of their table."""
    return p3_key_counts(spark, folder).where(F.col("key_value").isNotNull() & (F.col("share") >= 0.02)).select("field_name", "key_value")


def p3_verified_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Per sentence: its looked-up occurrences, and how many of them really stand at their position."""
    columns = ["sentence_id", "normalized_text"]
    sentences = table(spark, folder, "prepared_sentences").select(*columns).unionByName(table(spark, folder, "pinned_sentences").select(*columns))
    rows = table(spark, folder, "seed_occurrences").select("occurrence_id", "sentence_id", "seed_text", "seed_pos")
    plan = skew.plan_loads(rows, "sentence_id")
    joined = skew.fragment_replicate_join(rows, sentences, "sentence_id", plan, row_id="occurrence_id")
    stands = F.substring("normalized_text", F.col("seed_pos") + 1, F.length("seed_text")) == F.col("seed_text")
    partial = joined.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n_occurrences"), F.coalesce(F.sum(stands.cast("long")), F.lit(0)).alias("n_verified"))
    return partial


P3_COUNTS = """
select 'SeedOccurrence.sentence_id' as field_name, cast(sentence_id as varchar) as key_value, count(*) as n_rows, count(*) / (select count(*)::double from seed_occurrences) as share
from seed_occurrences group by sentence_id
union all
select 'SeedCandidate.text', text, count(*), count(*) / (select count(*)::double from seed_candidates) from seed_candidates group by text
"""

QUERIES = {f.__name__: f for f in (p3_found, p3_key_counts, p3_verified_occurrences)}

SQL = {
    "p3_key_counts": P3_COUNTS,
    "p3_found": f"select field_name, key_value from ({P3_COUNTS}) t where key_value is not null and share >= 0.02",
    "p3_verified_occurrences": """
with s as (select sentence_id, normalized_text from prepared_sentences union all select sentence_id, normalized_text from pinned_sentences)
select o.sentence_id, count(*) as n_occurrences,
  cast(coalesce(sum(case when substring(normalized_text, seed_pos + 1, length(seed_text)) = seed_text then 1 when normalized_text is null then null else 0 end), 0) as bigint) as n_verified
from seed_occurrences o join s on o.sentence_id = s.sentence_id group by o.sentence_id
""",
}
