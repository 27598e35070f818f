"""Artifacts of an evaluation run: JSON tables, the per-query CSV, a Markdown report; written so that a reader sees all of a run or nothing."""

from __future__ import annotations

import json
import platform
import uuid
from collections.abc import Callable

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import evaluate, trials
from textloom.sources import index_store

# The names of a run's artifacts.
JSON_TABLES = ("environment", "corpus_summary", "queries", "build_results", "correctness_results", "raw_timings", "internal_work_metrics", "summary", "errors")
CSV_TABLE, REPORT = "per_query_results.csv", "benchmark_report.md"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def replace_atomically(spark: SparkSession, write: Callable[[str], None], path: str) -> None:
    """Lets `write` fill a new folder beside `path`, then renames it there; what lay there before goes last. A broken run changes nothing."""
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write(fresh)
    fs, target = _fs(spark, path)
    there = fs.exists(target)
    if there and not fs.rename(target, _fs(spark, old)[1]):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(_fs(spark, fresh)[1], target):
        raise OSError(f"{fresh} can't be renamed to {path}")
    if there:
        fs.delete(_fs(spark, old)[1], True)


def environment(spark: SparkSession) -> dict[str, str]:
    """What a reader must know to compare times."""
    context = spark.sparkContext
    return {"python": platform.python_version(), "spark": pyspark.__version__, "machine": platform.platform(), "master": context.master, "cores": str(context.defaultParallelism), "started": str(context.startTime)}


def _text(spark: SparkSession, content: str, path: str) -> None:
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def analyze(phase: trials.Phase, queries: DataFrame, work: DataFrame, builds: DataFrame) -> dict[str, DataFrame]:
    """The summaries of a run, from its stored tables alone. `queries` has `query_id, q, categories`."""
    medians = trials.timing_summary(phase.timing).select("query_id", "algorithm_id", "median")
    counts = phase.correctness.where(F.col("algorithm_id") == trials.ALGORITHMS[0]).select("query_id", F.col("result_count").alias("results"))
    from textloom.functions import text as tx

    about = queries.select("query_id", tx.length_bucket(F.length("q")).alias("length_bucket"), "categories").join(counts, "query_id", "left").withColumn("result_bucket", tx.result_bucket(F.col("results")))
    timed = medians.join(about, "query_id")
    group = lambda by: evaluate.latency_summary(timed if by != "category" else timed.withColumn("category", F.explode("categories")), [by, "algorithm_id"], "median")
    return {
        "overall": evaluate.latency_summary(medians, ["algorithm_id"], "median"), "by_length": group("length_bucket"), "by_category": group("category"), "by_result_bucket": group("result_bucket"),
        "win_rates": evaluate.win_rates(medians), "speedups": evaluate.speedups(medians, trials.ALGORITHMS[0]),
        "break_even": evaluate.break_even(medians, builds.select("algorithm_id", F.col("build_ns").cast("double").alias("build")), trials.ALGORITHMS[0]),
        "work_rates": trials.work_rates(work), "worst_queries": evaluate.extremes(medians, "algorithm_id", "median", 25), "best_queries": evaluate.extremes(medians, "algorithm_id", "median", 20, worst=False),
        "scorecard": trials.scorecard(phase.correctness, phase.timing, queries, builds),
    }


def write_run(path: str, phase: trials.Phase, queries: DataFrame, sentences: DataFrame, work: DataFrame, builds: DataFrame, corpus: DataFrame) -> dict[str, DataFrame]:
    """Writes every artifact of a run under `path`, in one step, and returns the summaries."""
    spark = queries.sparkSession
    summary = analyze(phase, queries, work, builds)
    reasons = trials.validity_reasons(phase, queries, builds)

    def write(to: str) -> None:
        tables = {"corpus_summary": corpus, "queries": queries, "build_results": builds, "correctness_results": phase.correctness, "raw_timings": phase.timing, "internal_work_metrics": work, "errors": phase.errors}
        for name, df in tables.items():
            index_store.write_json(df, f"{to}/{name}.json")
        _text(spark, json.dumps(environment(spark)), f"{to}/environment.json")
        _text(spark, json.dumps({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in summary.items()} | {"incomplete_because": reasons}), f"{to}/summary.json")
        index_store.write_query_csv(trials.per_query_report(phase, queries, work), f"{to}/{CSV_TABLE}")
        verdict = "The run is complete." if not reasons else "The run is incomplete: " + "; ".join(reasons) + "."
        parts = [f"# Evaluation of search strategies\n\n{verdict}", *(f"## {name.replace('_', ' ')}\n\n{index_store.markdown_table(df)}" for name, df in summary.items())]
        _text(spark, "\n\n".join(parts), f"{to}/{REPORT}")

    replace_atomically(spark, write, path)
    return summary


def resume(queries: DataFrame, path: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of `run` for all queries, kept under `path`: queries that have results there are not run again.

    `run` maps `query_id, q` to rows with `query_id`, one at least for each query. New results replace the folder in
    one step together with the old ones, so a run that breaks off loses nothing.
    """
    spark = queries.sparkSession
    fs, where = _fs(spark, path)
    done = spark.read.parquet(path) if fs.exists(where) else None
    todo = index_store.pending(queries, done) if done is not None else queries
    if todo.limit(1).count():
        fresh = run(todo)
        both = fresh if done is None else done.unionByName(fresh)
        replace_atomically(spark, lambda to: both.write.parquet(to), path)
    return spark.read.parquet(path)
