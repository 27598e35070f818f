"""Evaluation runs: timed builds and searches, correctness against the exhaustive scan, work, studies and verdicts.

A search is a Spark plan over a table of queries, so a trial times a strategy over the whole table (`each=False`), or
every query by itself (`each=True`). Times, work and correctness are kept in tables of their own; summaries are
computed from those tables alone (`evaluate`). The driver loops over strategies and repetitions, never over rows.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import evaluate, ranking, search
from textloom.session import cut, scratch

#: The strategies of a full run, the oracle first.
ALGORITHMS = ("naive", "qgram", "hybrid", "bi_anchor")
# Queries, repetitions of searches and of builds of the modes.
MODES = {"quick": (125, 1, 1), "standard": (700, 3, 3), "deep": (2000, 7, 5)}
# The columns of the per-query report, in its order.
REPORT_COLUMNS = (
    "query_id", "query_text", "query_length", "category", "algorithm", "correctness_status", "result_count", "min_ms", "median_ms", "mean_ms", "max_ms", "p95_ms",
    "speedup_vs_naive", "fallback_used", "candidate_count", "verifier_calls", "posting_count", "tree_nodes_visited", "selected_seed_A", "selected_seed_B", "frequency_A", "frequency_B",
)
TIMING = "query_id string, algorithm_id string, repetitions_requested int, repetitions_completed int, raw_samples_ns array<long>, order_positions array<int>"
Strategy = Callable[[DataFrame, DataFrame], DataFrame]


def rotated(names: tuple[str, ...], offset: int) -> tuple[str, ...]:
    """The order of execution: each name comes first in its turn."""
    at = offset % len(names)
    return names[at:] + names[:at]


def _stored_bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def measure_builds(builds: dict[str, Callable[[str], None]], spark: SparkSession, repetitions: int = 1) -> DataFrame:
    """`algorithm_id, build_samples_ns, build_ns, retained_bytes`: each build writes its structure to a new shared folder, `repetitions` times."""
    if repetitions < 1:
        raise ValueError("repetitions is 1 or more")
    rows = []
    for name, build in builds.items():
        samples = []
        for _ in range(repetitions):
            path = scratch(spark)
            began = time.perf_counter_ns()
            build(path)
            samples.append(time.perf_counter_ns() - began)
        rows.append((name, samples, sorted(samples)[(len(samples) - 1) // 2], _stored_bytes(spark, path)))
    return spark.createDataFrame(rows, "algorithm_id string, build_samples_ns array<long>, build_ns long, retained_bytes long")


class Phase:
    """The tables of one search phase: `timing`, `correctness`, `errors`, and the `results` of each strategy, as plans that are run anew when asked."""

    def __init__(self, timing: DataFrame, correctness: DataFrame, errors: DataFrame, results: dict[str, DataFrame], repetitions: int) -> None:
        self.timing, self.correctness, self.errors, self.results, self.repetitions = timing, correctness, errors, results, repetitions


def run_search_phase(queries: DataFrame, sentences: DataFrame, strategies: dict[str, Strategy] | None = None, repetitions: int = 1, each: bool = False) -> Phase:
    """Runs every strategy over `query_id, q`, in rotated order, and compares its matches with those of the first one, the oracle.

    The first timed run of a strategy is also the one that is compared: it is reduced to a count and a signature per query,
    so that no match is stored. Queries whose signatures equal the oracle's have the same matches; those of the others are
    compared one by one. A failing strategy is left out from then on; its error is kept. With `each` the queries are timed
    one by one, else each gets an even part of the whole run.
    """
    spark = queries.sparkSession
    strategies = strategies or {name: ranking.STRATEGIES[name] for name in ALGORITHMS}
    names = tuple(strategies)
    queries = cut(queries.select("query_id", "q"))
    ids = [r["query_id"] for r in queries.select("query_id").collect()]  # the workload of an evaluation, at most a few thousand
    if not ids:
        raise ValueError("at least one query is required")
    warm = queries.orderBy(F.length("q").desc(), "query_id").limit(1)
    errors: list[tuple] = []
    failed: set[str] = set()

    def run(name: str, asked: DataFrame, phase: str, repetition: int, keep: bool = False):
        began = time.perf_counter_ns()
        try:
            found = strategies[name](asked, sentences).select(search.MATCH_COLUMNS)
            kept = (found, cut(evaluate.match_signature(found, search.MATCH_COLUMNS))) if keep else found.write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001 - a run must keep the failure and go on
            errors.append((phase, name, repetition, repr(error)[:2000], traceback.format_exc()[-4000:]))
            failed.add(name)
            return None, 0
        return kept, time.perf_counter_ns() - began

    for name in names:
        run(name, warm, "warmup", 0)
    failed.clear()
    results: dict[str, tuple[DataFrame, DataFrame]] = {}
    samples: dict[tuple, list[int]] = {(i, n): [] for i in ids for n in names}
    positions: dict[tuple, list[int]] = {k: [] for k in samples}
    for repetition in range(repetitions):
        for position, name in enumerate(rotated(names, repetition)):
            if name in failed:
                continue
            if name not in results:
                results[name], took = run(name, queries, "search", repetition, True)
            elif not each:
                _, took = run(name, queries, "search", repetition)
            if name in failed:
                results.pop(name, None)
                continue
            for i, query_id in enumerate(ids):
                if each:
                    _, took = run(name, queries.where(F.col("query_id") == query_id), "search", repetition)
                samples[query_id, name].append(took if each else took // len(ids))
                positions[query_id, name].append((position + i) % len(names) if each else position)
    timing = spark.createDataFrame([(str(i), n, repetitions, len(s), s, positions[i, n]) for (i, n), s in samples.items()], TIMING)
    correctness = _correctness(spark, queries, names, results)
    failures = spark.createDataFrame(errors, "phase string, algorithm_id string, repetition int, exception string, trace string")
    return Phase(timing, correctness, failures, {name: found for name, (found, _) in results.items()}, repetitions)


def _correctness(spark: SparkSession, queries: DataFrame, names: tuple[str, ...], results: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """`query_id, algorithm_id, result_count, correct, status, false_negatives, false_positives` of every query and strategy."""
    oracle = results.get(names[0])
    parts = []
    for name in names:
        pair = queries.select("query_id", F.lit(name).alias("algorithm_id"))
        if name not in results or oracle is None:
            missing = F.lit(None).cast("long")
            parts.append(pair.select("*", missing.alias("result_count"), F.lit(False).alias("correct"), F.lit("error_or_missing_result").alias("status"), missing.alias("false_negatives"), missing.alias("false_positives")))
            continue
        counts = results[name][1].select("query_id", "n")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        if name == names[0]:
            rows = pair.join(counts, "query_id", "left").withColumn("fn", F.lit(0).cast("long")).withColumn("fp", F.lit(0).cast("long"))
            status = F.lit("oracle")
        else:
            differences = _differences(oracle, results[name])
            rows = pair.join(counts, "query_id", "left").join(differences, "query_id", "left").withColumn("fn", zero(F.col("false_negatives"))).withColumn("fp", zero(F.col("false_positives")))
            status = F.when(F.col("fn") + F.col("fp") == 0, "raw_results_match").otherwise("raw_result_mismatch")
        correct = (F.col("fn") + F.col("fp") == 0).alias("correct")
        parts.append(rows.select("query_id", "algorithm_id", zero(F.col("n")).alias("result_count"), correct, status.alias("status"), F.col("fn").alias("false_negatives"), F.col("fp").alias("false_positives")))
    return reduce(DataFrame.unionByName, parts)


def _differences(oracle: tuple[DataFrame, DataFrame], actual: tuple[DataFrame, DataFrame]) -> DataFrame:
    """`compare_results` of the queries whose signatures differ; a copy, as the correctness of a run is read many times."""
    at = lambda rows, side: rows.select("query_id", F.struct("n", "sums").alias(side))
    both = at(oracle[1], "o").join(at(actual[1], "a"), "query_id", "full_outer")
    other = cut(both.where(~F.col("o").eqNullSafe(F.col("a"))).select("query_id"))
    if not other.limit(1).count():
        return other.select("query_id", *[F.lit(0).cast("long").alias(c) for c in ("false_negatives", "false_positives", "common")])
    of = lambda rows: rows.join(F.broadcast(other), "query_id", "left_semi")
    return cut(evaluate.compare_results(of(oracle[0]), of(actual[0]), search.MATCH_COLUMNS))


def work(queries: DataFrame, sentences: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), q: int = 3) -> DataFrame:
    """What each strategy must do for each query: `query_id, algorithm_id, fallback, candidate_count, verifier_calls, posting_count`, and the anchors.

    `fallback` says that the strategy scans all starts. The hybrid's candidates are words, the others' are starts.
    """
    queries = cut(queries.where(F.length("q") > 0).select("query_id", "q"))
    seeds = cut(search.query_seeds(queries, sentences, sorted({*sizes, 1, 2, q})))
    naive = evaluate.naive_work(queries, sentences)
    plan = cut(search.anchor_plan(search.anchor_pairs(seeds.where(F.col("gram_size").isin(list(sizes))))))
    starts = search.count_starts(plan, sentences, search.Asked(queries))
    frequency = seeds.select("query_id", F.col("query_start").alias("s"), "gram_size", F.col("frequency").alias("f"))
    of = lambda side: frequency.select("query_id", "gram_size", F.col("s").alias(f"{side}_start"), F.col("f").alias(f"frequency_{side}"))
    anchors = plan.join(of("first"), ["query_id", "gram_size", "first_start"]).join(of("second"), ["query_id", "gram_size", "second_start"])
    none = F.lit(None).cast("long")
    text = F.lit(None).cast("string")
    base = queries.join(naive, "query_id")
    anchored = base.join(anchors.drop("q"), "query_id", "left").join(starts, "query_id", "left")
    missing = F.col("cost").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    bi_anchor = anchored.select(
        "query_id", F.lit("bi_anchor").alias("algorithm_id"), missing.alias("fallback"), F.when(~missing, zero("candidate_count")).alias("candidate_count"),
        F.when(missing, F.col("verifier_calls")).otherwise(zero("calls")).alias("verifier_calls"), F.col("cost").alias("posting_count"),
        F.col("first_gram").alias("seed_a"), F.col("second_gram").alias("seed_b"), F.col("frequency_first").alias("frequency_a"), F.col("frequency_second").alias("frequency_b"),
    )
    m = F.length("q")
    scanned = seeds.where((F.col("gram_size") == search.choose_q(m, q)) & (m >= 2 * search.choose_q(m, q))).groupBy("query_id").agg(F.sum("frequency").alias("posting_count"))
    unplanned = m < 2 * search.choose_q(m, q)
    rest = [text.alias("seed_a"), text.alias("seed_b"), none.alias("frequency_a"), none.alias("frequency_b")]
    qgram = base.join(scanned, "query_id", "left").select(
        "query_id", F.lit("qgram").alias("algorithm_id"), unplanned.alias("fallback"), none.alias("candidate_count"), F.when(unplanned, F.col("verifier_calls")).alias("verifier_calls"), F.col("posting_count").cast("long").alias("posting_count"), *rest
    )
    words = search.hybrid_candidates(queries, sentences, q).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    hybrid = base.join(words, "query_id", "left").select(
        "query_id", F.lit("hybrid").alias("algorithm_id"), F.lit(False).alias("fallback"), zero("candidate_count").alias("candidate_count"), none.alias("verifier_calls"), none.alias("posting_count"), *rest
    )
    exhaustive = base.select("query_id", F.lit("naive").alias("algorithm_id"), F.lit(False).alias("fallback"), none.alias("candidate_count"), "verifier_calls", none.alias("posting_count"), *rest)
    return exhaustive.unionByName(qgram).unionByName(hybrid).unionByName(bi_anchor)


def work_rates(work_rows: DataFrame) -> DataFrame:
    """`algorithm_id, queries, fallback_rate, mean_seed_frequency, saved`: of all queries; `saved` is the share of exhaustive verifications left out."""
    base = work_rows.where(F.col("algorithm_id") == ALGORITHMS[0]).select("query_id", F.col("verifier_calls").alias("all"))
    rows = work_rows.join(base, "query_id")
    seeds = (F.col("frequency_a") + F.col("frequency_b")) / 2
    known = F.col("verifier_calls").isNotNull()
    saved = 1 - F.sum(F.when(known, F.col("verifier_calls"))) / F.sum(F.when(known, F.col("all")))
    return rows.groupBy("algorithm_id").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("fallback").cast("int")).alias("fallback_rate"), F.avg(seeds).alias("mean_seed_frequency"), saved.alias("saved"))


def timing_summary(timing: DataFrame) -> DataFrame:
    """`query_id, algorithm_id, min, median, mean, max, p95` of the raw samples, in ns; p95 is null below five samples."""
    long = timing.select("query_id", "algorithm_id", F.explode(F.col("raw_samples_ns").cast("array<double>")).alias("sample"))
    return evaluate.latency_summary(long, ["query_id", "algorithm_id"], "sample")


def per_query_report(phase: Phase, queries: DataFrame, work_rows: DataFrame) -> DataFrame:
    """The 22 columns of the per-query report, one row a query and strategy. `queries` has `query_id, query_text, q, primary_category`."""
    ms = lambda c: (F.col(c) / 1e6)
    summary = timing_summary(phase.timing)
    base = summary.where(F.col("algorithm_id") == ALGORITHMS[0]).select("query_id", F.col("median").alias("base"))
    about = queries.select("query_id", "query_text", F.length("q").alias("query_length"), F.col("primary_category").alias("category"))
    rows = phase.correctness.join(about, "query_id").join(summary, ["query_id", "algorithm_id"], "left").join(base, "query_id", "left").join(work_rows, ["query_id", "algorithm_id"], "left")
    return rows.select(
        "query_id", "query_text", "query_length", "category", F.col("algorithm_id").alias("algorithm"), F.col("status").alias("correctness_status"), "result_count",
        ms("min").alias("min_ms"), ms("median").alias("median_ms"), ms("mean").alias("mean_ms"), ms("max").alias("max_ms"), ms("p95").alias("p95_ms"),
        (F.coalesce("base", F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("median"))).alias("speedup_vs_naive"), F.col("fallback").alias("fallback_used"), "candidate_count", "verifier_calls", "posting_count",
        F.lit(None).cast("long").alias("tree_nodes_visited"), F.col("seed_a").alias("selected_seed_A"), F.col("seed_b").alias("selected_seed_B"), F.col("frequency_a").alias("frequency_A"), F.col("frequency_b").alias("frequency_B"),
    )


def validity_reasons(phase: Phase, queries: DataFrame, builds: DataFrame | None = None, algorithms: tuple[str, ...] = ALGORITHMS, corpus_fraction: float = 1.0) -> list[str]:
    """Why a run doesn't count as complete; an empty list if it does."""
    reasons = []
    if corpus_fraction != 1.0:
        reasons.append("the corpus was not processed as a whole")
    lengths = {r["m"] for r in queries.select(F.length("q").alias("m")).distinct().collect()}
    reasons += [f"no query has length {m}" for m in range(1, 7) if m not in lengths]
    for name, rows in (("timing", phase.timing.where(F.col("repetitions_completed") > 0)), ("correctness", phase.correctness)):
        if evaluate.missing_pairs(rows, queries, list(algorithms)).limit(1).count():
            reasons.append(f"{name} lacks pairs of a query and a strategy")
    if phase.timing.where(F.col("repetitions_completed") != F.col("repetitions_requested")).limit(1).count():
        reasons.append("some timing repetitions are incomplete")
    if phase.errors.limit(1).count():
        reasons.append("some executions failed")
    wrong = phase.correctness.where(~F.col("correct")).select("algorithm_id").distinct().orderBy("algorithm_id").collect()
    reasons += [f"{r['algorithm_id']} differs from the oracle" for r in wrong]
    built = {r["algorithm_id"]: r["build_samples_ns"] for r in builds.collect()} if builds is not None else {}
    reasons += [f"the build of {a} was not timed" for a in algorithms if not built.get(a)]
    return reasons


def mismatch_classes(correctness: DataFrame, queries: DataFrame, q: int = 3) -> DataFrame:
    """`query_id, algorithm_id, mismatch` of the wrong pairs. `queries` has `query_id, q, categories`."""
    has = lambda tag: F.coalesce(F.array_contains("categories", tag), F.lit(False))
    fn, fp = F.col("false_negatives") > 0, F.col("false_positives") > 0
    kind = (
        F.when(F.length("q") < q, "short query").when(has("cross_word"), "across words").when(has("repeated_characters") | has("repeated"), "repeated characters")
        .when(fn & ~fp, "missed candidates").when(fp & ~fn, "other reading of the edit").otherwise("other")
    )
    wrong = correctness.where(~F.col("correct")).join(queries.select("query_id", "q", "categories"), "query_id")
    return wrong.select("query_id", "algorithm_id", kind.alias("mismatch"))


def scorecard(correctness: DataFrame, timing: DataFrame, queries: DataFrame, builds: DataFrame | None = None) -> DataFrame:
    """One row a strategy: correctness, build, latency, speedup over the oracle, and the categories in which it does best and worst."""
    medians = timing_summary(timing).select("query_id", "algorithm_id", "median")
    right = correctness.groupBy("algorithm_id").agg(F.min("correct").alias("correct"), F.sum("false_negatives").alias("false_negatives"), F.sum("false_positives").alias("false_positives"))
    latency = medians.groupBy("algorithm_id").agg(F.median("median").alias("median_ns"), evaluate.disc("median", 95).alias("p95_ns"), evaluate.disc("median", 99).alias("p99_ns"))
    base = medians.where(F.col("algorithm_id") == ALGORITHMS[0]).select("query_id", F.col("median").alias("b"))
    ratio = medians.join(base, "query_id").withColumn("r", F.col("b") / F.greatest(F.lit(1.0), F.col("median")))
    speed = ratio.groupBy("algorithm_id").agg(F.median("r").alias("median_speedup"), F.min("r").alias("worst_speedup"))
    per = ratio.join(queries.select("query_id", F.explode("categories").alias("category")), "query_id").groupBy("algorithm_id", "category").agg(F.median("r").alias("r"))
    best = per.groupBy("algorithm_id").agg(F.max_by("category", F.struct("r", "category")).alias("best_category"), F.min_by("category", F.struct("r", "category")).alias("worst_category"))
    out = right.join(latency, "algorithm_id", "left").join(speed, "algorithm_id", "left").join(best, "algorithm_id", "left")
    return out if builds is None else out.join(builds.select("algorithm_id", "build_ns", "retained_bytes"), "algorithm_id", "left")


def recommendations(card: DataFrame) -> dict[str, str | None]:
    """What a scorecard advises: the fastest of the right strategies, the smallest, the cheapest to build, and those to leave out."""
    rows = card.collect()  # one row a strategy
    right = [r for r in rows if r["correct"]]
    least = lambda column: min((r for r in right if column in r and r[column] is not None), key=lambda r: (r[column], r["algorithm_id"]), default=None)
    name = lambda r: r["algorithm_id"] if r else None
    return {
        "fastest": name(least("median_ns")), "smallest": name(least("retained_bytes")), "cheapest_build": name(least("build_ns")),
        "not_equal_to_the_oracle": ", ".join(sorted(r["algorithm_id"] for r in rows if not r["correct"])) or None,
    }


def length_study(queries: DataFrame, sentences: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), expansion_guard: int | None = None, longest: int = 6) -> DataFrame:
    """Queries of 1 to `longest` characters under each forced gram size and under the adaptive choice.

    `query_id, length, runtime, selected_q, predicted_expansion, status, result_count, latency_ns`. A plan that predicts
    more occurrences than `expansion_guard` is `guarded`: not run, but its prediction is reported. A query that a
    runtime can't anchor is `naive_fallback`, and isn't reported as that runtime's latency. Latency is the run's over
    its queries.
    """
    spark = queries.sparkSession
    rows = cut(queries.where((F.length("q") > 0) & (F.length("q") <= longest)).select("query_id", "q"))
    pairs = cut(search.anchor_pairs(search.query_seeds(rows, sentences, sorted(sizes))))
    parts = []
    for runtime, own in [*((f"q{s}", (s,)) for s in sorted(sizes)), ("adaptive", tuple(sorted(sizes)))]:
        plan = search.anchor_plan(pairs.where(F.col("gram_size").isin(list(own)))).select("query_id", F.col("gram_size").alias("selected_q"), F.col("cost").alias("predicted_expansion"))
        guarded = F.col("predicted_expansion") > expansion_guard if expansion_guard is not None else F.lit(False)
        status = F.when(F.col("selected_q").isNull(), "naive_fallback").when(guarded, "guarded").otherwise("executed")
        planned = cut(rows.join(plan, "query_id", "left").withColumn("status", status))
        run = planned.where("status = 'executed'").select("query_id", "q")
        n = run.count()
        began = time.perf_counter_ns()
        found = cut(search.search_bi_anchor(run, sentences, own)) if n else None
        took = (time.perf_counter_ns() - began) // max(1, n)
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")) if n else spark.createDataFrame([], "query_id string, c long")
        executed = F.col("status") == "executed"
        parts.append(
            planned.join(counts, "query_id", "left").select(
                "query_id", F.length("q").alias("length"), F.lit(runtime).alias("runtime"), "selected_q", "predicted_expansion", "status",
                F.when(executed, F.coalesce("c", F.lit(0))).alias("result_count"), F.when(executed, F.lit(took)).cast("long").alias("latency_ns"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def length_summary(study: DataFrame) -> DataFrame:
    """`length, runtime, queries, executed, guarded, fallback_rate, median_expansion, median_ns` of a length study."""
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    return study.groupBy("length", "runtime").agg(
        F.count(F.lit(1)).alias("queries"), count("executed").alias("executed"), count("guarded").alias("guarded"), (count("naive_fallback") / F.count(F.lit(1))).alias("fallback_rate"),
        F.median("predicted_expansion").alias("median_expansion"), F.median("latency_ns").alias("median_ns"),
    )


def index_configurations(sentences: DataFrame, configurations: tuple[tuple[int, ...], ...] = ((3,), (2, 3), (1, 2, 3))) -> DataFrame:
    """`configuration, gram_size`, and the sizes of the dictionary-encoded index: words, seeds inside words and their references, boundary seeds and occurrences.

    The words and each gram size are counted once, whatever the number of configurations.
    """
    sizes = sorted({s for c in configurations for s in c})
    vocabulary = search.words(sentences).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    whole = vocabulary.agg(F.count(F.lit(1)).alias("unique_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("word_occurrences"))
    inside = reduce(DataFrame.unionByName, [vocabulary.select(F.lit(s).alias("gram_size"), F.explode(F.expr(f"transform(sequence(1, greatest(1, length(word) - {s - 1})), i -> substring(word, i, {s}))")).alias("gram")).where(F.length("gram") == s) for s in sizes])
    within = inside.groupBy("gram_size", "gram").agg(F.count(F.lit(1)).alias("n")).groupBy("gram_size").agg(F.count(F.lit(1)).alias("intra_word_seed_keys"), F.sum("n").alias("intra_word_seed_references"))
    crossing = search.postings(sentences, sizes).where(F.col("gram").contains(" ")).groupBy("gram_size", "gram").agg(F.count(F.lit(1)).alias("n"))
    boundary = crossing.groupBy("gram_size").agg(F.count(F.lit(1)).alias("boundary_seed_keys"), F.sum("n").alias("boundary_occurrences"))
    named = sentences.sparkSession.createDataFrame([(",".join(map(str, sorted(c))), s) for c in configurations for s in sorted(c)], "configuration string, gram_size int")
    joined = evaluate.beside(F.broadcast(named).join(within, "gram_size", "left").join(boundary, "gram_size", "left"), whole)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("configuration", "gram_size", "unique_words", "word_occurrences", *map(zero, ("intra_word_seed_keys", "intra_word_seed_references", "boundary_seed_keys", "boundary_occurrences")))


def parameter_study(queries: DataFrame, sentences: DataFrame, values: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """`q, algorithm_id, results, false_negatives, false_positives, run_ns` of the indexed strategies for each gram size, against the exhaustive scan."""
    oracle = cut(search.search_naive(queries, sentences))
    rows = []
    for q in values:
        for name, found in (("qgram", search.search_qgram), ("hybrid", search.search_hybrid), ("bi_anchor", lambda a, b, q: search.search_bi_anchor(a, b, (q,)))):
            began = time.perf_counter_ns()
            got = cut(found(queries, sentences, q))
            took = time.perf_counter_ns() - began
            d = evaluate.compare_results(oracle, got.select(search.MATCH_COLUMNS), search.MATCH_COLUMNS).agg(F.sum("false_negatives").alias("n"), F.sum("false_positives").alias("p")).first()
            rows.append((q, name, got.count(), d["n"] or 0, d["p"] or 0, took))
    return queries.sparkSession.createDataFrame(rows, "q int, algorithm_id string, results long, false_negatives long, false_positives long, run_ns long")


def scaling_study(queries: DataFrame, sentences: DataFrame, percents: tuple[int, ...] = (10, 25, 50, 75, 100), algorithms: tuple[str, ...] = ("naive", "bi_anchor")) -> DataFrame:
    """`percent, sentences, algorithm_id, results, run_ns`: the first share of the corpus by id, ceil(n * percent / 100) sentences, searched by each strategy."""
    from textloom.operators.workload import prefix_slice

    rows = []
    for percent in percents:
        part = cut(prefix_slice(sentences, "sentence_id", percent))
        n = part.count()
        for name in algorithms:
            began = time.perf_counter_ns()
            results = ranking.STRATEGIES[name](queries, part).count()
            rows.append((percent, n, name, results, time.perf_counter_ns() - began))
    return queries.sparkSession.createDataFrame(rows, "percent int, sentences long, algorithm_id string, results long, run_ns long")


def deep_studies(queries: DataFrame, sentences: DataFrame, repetitions: int = 3) -> dict[str, DataFrame]:
    """Profile, growth with the corpus, gram sizes, and how far repeated runs agree."""
    spark = queries.sparkSession
    plans = {name: (lambda f=f: f(queries, sentences)) for name, f in ranking.STRATEGIES.items()}
    repeated = run_search_phase(queries, sentences, {name: ranking.STRATEGIES[name] for name in ALGORITHMS}, repetitions)
    spread = repeated.timing.select("algorithm_id", F.explode(F.col("raw_samples_ns").cast("array<double>")).alias("sample"))
    return {
        "profile": profile(plans, spark), "scaling": scaling_study(queries, sentences), "parameter": parameter_study(queries, sentences),
        "repeatability": evaluate.latency_summary(spread, ["algorithm_id"], "sample").withColumn("variation", F.col("stdev") / F.col("mean")),
    }


def profile(scenarios: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """`scenario, phase, ns`: where the time of a plan goes: building it, planning it (Catalyst), running it."""
    rows = []
    for name, make in scenarios.items():
        marks = [time.perf_counter_ns()]
        df = make()
        marks.append(time.perf_counter_ns())
        df._jdf.queryExecution().executedPlan()
        marks.append(time.perf_counter_ns())
        df.write.format("noop").mode("overwrite").save()
        marks.append(time.perf_counter_ns())
        rows += [(name, phase, b - a) for phase, a, b in zip(("build", "plan", "run"), marks, marks[1:])]
    return spark.createDataFrame(rows, "scenario string, phase string, ns long")


def listing(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """`n, line`: raw candidates as readable text, numbered in a stable order; the form of a console listing, at any size."""
    from textloom.operators.numbering import row_numbers

    rows = ranking.scored(candidates).join(records.select("sentence_id", "original_text", "source_path", "line_no"), "sentence_id")
    order = ["query_id", "sentence_id", "match_start", "edit_type", "edit_index"]
    numbered = row_numbers(rows, order, "n")
    line = F.format_string(
        "[%d] sentence=%d start=%d edit=%s edit_index=%s correct=%d score=%d | %s (%s, line %d)", F.col("n") + 1, "sentence_id", "match_start", "edit_type",
        F.coalesce(F.col("edit_index").cast("string"), F.lit("-")), "correct_characters", "score", F.coalesce("original_text", F.lit("")), F.coalesce("source_path", F.lit("")), "line_no",
    )
    return numbered.select((F.col("n") + 1).alias("n"), line.alias("line"))
