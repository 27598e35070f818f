from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluate, ranking, sampled, search, trials
from textloom.sources import index_store, reports

TEXTS = ["the quiet ledger stores a meadow", "programming in python is orderly", "hello wonderful little world of ledgers", "a banana bandana repeats", "internationalization is long"]
QUERIES = [("q1", "a", "short"), ("q2", "le", "short"), ("q3", "led", "short"), ("q4", "ledg", "cross_word"), ("q5", "a ban", "cross_word"), ("q6", "ledger", "exact"), ("q7", "repeets", "near_miss"), ("q8", "qqqqqq", "no_match")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "sentence_id long, n string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, q, q, c, [c]) for i, q, c in QUERIES], "query_id string, query_text string, q string, primary_category string, categories array<string>").cache()


@pytest.fixture(scope="module")
def phase(queries, corpus):
    return trials.run_search_phase(queries, corpus, repetitions=2)


def test_rotation():
    assert [trials.rotated(("a", "b", "c"), i)[0] for i in range(4)] == ["a", "b", "c", "a"]
    assert trials.rotated(("a", "b", "c"), 1) == ("b", "c", "a")


def test_a_phase_keeps_times_and_correctness_apart(phase):
    rows = phase.timing.collect()
    assert len(rows) == len(QUERIES) * 4 and all(r["repetitions_completed"] == 2 == len(r["raw_samples_ns"]) for r in rows)
    assert {tuple(r["order_positions"]) for r in rows if r["algorithm_id"] == "naive"} == {(0, 3)}
    got = {(r["query_id"], r["algorithm_id"]): r for r in phase.correctness.collect()}
    assert {r["status"] for (_, a), r in got.items() if a == "naive"} == {"oracle"}
    assert {r["status"] for (_, a), r in got.items() if a in ("qgram", "bi_anchor")} == {"raw_results_match"}
    assert got["q5", "hybrid"]["status"] == "raw_result_mismatch" and got["q5", "hybrid"]["false_negatives"] > 0
    assert phase.errors.count() == 0


def test_each_query_timed_alone(queries, corpus):
    two = {k: ranking.STRATEGIES[k] for k in ("naive", "bi_anchor")}
    got = trials.run_search_phase(queries.limit(2), corpus, two, repetitions=1, each=True)
    assert {r["repetitions_completed"] for r in got.timing.collect()} == {1} and got.correctness.where("correct").count() == 4


def test_a_failing_strategy_is_kept_as_an_error(queries, corpus):
    def broken(q, s):
        raise RuntimeError("no index")

    got = trials.run_search_phase(queries, corpus, {"naive": search.search_naive, "broken": broken})
    assert {(r["phase"], r["algorithm_id"]) for r in got.errors.collect()} == {("warmup", "broken"), ("search", "broken")}
    assert {r["status"] for r in got.correctness.where("algorithm_id = 'broken'").collect()} == {"error_or_missing_result"}
    reasons = trials.validity_reasons(got, queries, algorithms=("naive", "broken"))
    assert "some executions failed" in reasons and "broken differs from the oracle" in reasons
    with pytest.raises(ValueError, match="at least one"):
        trials.run_search_phase(queries.limit(0), corpus)


def test_validity_and_classes(phase, queries, spark):
    builds = trials.measure_builds({a: lambda path: spark.range(3).write.parquet(path) for a in trials.ALGORITHMS}, spark, 2)
    assert all(len(r["build_samples_ns"]) == 2 and r["retained_bytes"] > 0 for r in builds.collect())
    reasons = trials.validity_reasons(phase, queries, builds)
    assert reasons == ["hybrid differs from the oracle"]
    assert "the corpus was not processed as a whole" in trials.validity_reasons(phase, queries.where("q <> 'a'"), builds, corpus_fraction=0.5)
    assert "no query has length 1" in trials.validity_reasons(phase, queries.where("q <> 'a'"), builds)
    classes = {r["query_id"]: r["mismatch"] for r in trials.mismatch_classes(phase.correctness, queries).collect()}
    assert classes["q1"] == classes["q2"] == "short query" and classes["q5"] == "across words" and "q8" not in classes
    card = {r["algorithm_id"]: r for r in trials.scorecard(phase.correctness, phase.timing, queries, builds).collect()}
    assert card["naive"]["correct"] and not card["hybrid"]["correct"] and card["naive"]["median_speedup"] == 1.0
    advice = trials.recommendations(trials.scorecard(phase.correctness, phase.timing, queries, builds))
    assert advice["not_equal_to_the_oracle"] == "hybrid" and advice["fastest"] in ("naive", "qgram", "bi_anchor") and advice["smallest"]


def test_report_has_its_22_columns(phase, queries, corpus, tmp_path, spark):
    report = trials.per_query_report(phase, queries, trials.work(queries, corpus))
    assert tuple(report.columns) == trials.REPORT_COLUMNS and len(report.columns) == 22 and report.count() == len(QUERIES) * 4
    rows = {(r["query_id"], r["algorithm"]): r for r in report.collect()}
    assert rows["q1", "bi_anchor"]["fallback_used"] and rows["q6", "bi_anchor"]["selected_seed_A"] and rows["q6", "naive"]["speedup_vs_naive"] == 1.0
    index_store.write_query_csv(report, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == list(trials.REPORT_COLUMNS)


def test_work_equals_the_definition(queries, corpus):
    got = {(r["query_id"], r["algorithm_id"]): r for r in trials.work(queries, corpus).collect()}
    for i, q, _ in QUERIES:
        want = sum(max(0, len(t) - size + 1) for t in TEXTS for size in (len(q) - 1, len(q), len(q) + 1) if size)
        assert got[i, "naive"]["verifier_calls"] == want
        if not got[i, "bi_anchor"]["fallback"]:
            assert got[i, "bi_anchor"]["verifier_calls"] <= want and got[i, "bi_anchor"]["posting_count"] == got[i, "bi_anchor"]["frequency_a"] + got[i, "bi_anchor"]["frequency_b"]


def test_length_study_guards_and_reports(queries, corpus):
    rows = {(r["query_id"], r["runtime"]): r for r in trials.length_study(queries, corpus, expansion_guard=8).collect()}
    assert rows["q1", "adaptive"]["status"] == "naive_fallback" and rows["q3", "q2"]["status"] == "naive_fallback"
    guarded = [r for r in rows.values() if r["status"] == "guarded"]
    assert guarded and all(r["predicted_expansion"] > 8 and r["result_count"] is None and r["latency_ns"] is None for r in guarded)
    assert rows["q6", "q3"]["status"] == "executed" and rows["q6", "q3"]["latency_ns"] > 0
    free = trials.length_study(queries, corpus)
    assert free.where("status = 'guarded'").count() == 0
    summary = {(r["length"], r["runtime"]): r for r in trials.length_summary(free).collect()}
    assert summary[1, "q1"]["fallback_rate"] == 1.0 and summary[6, "adaptive"]["executed"] == 2


def test_studies(queries, corpus, spark):
    some = queries.where("length(q) >= 6")
    parameter = {(r["q"], r["algorithm_id"]): r for r in trials.parameter_study(some, corpus, (2, 3)).collect()}
    assert all(r["false_negatives"] == r["false_positives"] == 0 for (q, a), r in parameter.items() if a != "hybrid") and len(parameter) == 6
    scaling = trials.scaling_study(some, corpus, (50, 100)).collect()
    assert {(r["percent"], r["sentences"]) for r in scaling} == {(50, 3), (100, 5)}
    assert all(len({r["results"] for r in scaling if r["percent"] == p}) == 1 for p in (50, 100))
    sizes = {(r["configuration"], r["gram_size"]): r for r in trials.index_configurations(corpus).collect()}
    per = {r["gram_size"]: r["occurrences"] for r in evaluate.index_stats(corpus, [3]).collect()}
    flat = sum(max(0, len(t) - 2) for t in TEXTS)
    crossing = sum(" " in t[i : i + 3] for t in TEXTS for i in range(len(t) - 2))
    assert sizes["1,2,3", 3]["boundary_occurrences"] == crossing and per[3] == flat and sizes["3", 3] != sizes["2,3", 2]
    assert {r["phase"] for r in trials.profile({"x": lambda: corpus.groupBy("n").count()}, spark).collect()} == {"build", "plan", "run"}


def test_listing(queries, corpus, spark):
    records = corpus.select("sentence_id", F.upper("n").alias("original_text"), F.lit("f.txt").alias("source_path"), F.lit(1).alias("line_no"))
    found = search.search_naive(queries.where("query_id = 'q6'"), corpus)
    lines = [r["line"] for r in trials.listing(found, records).orderBy("n").collect()]
    assert len(lines) == found.count() and lines[0].startswith("[1] sentence=0 start=") and "THE QUIET LEDGER" in lines[0] and "(f.txt, line 1)" in lines[0]


def test_short_workload(corpus, spark):
    rows = sampled.short_workload(corpus, 12).collect()
    assert {r["length"] for r in rows} == set(sampled.LENGTHS) and all(len(r["q"]) == r["length"] for r in rows)
    assert len({(r["length"], r["q"]) for r in rows}) == len(rows)
    tags = {(r["length"], t) for r in rows for t in r["tags"].split("|")}
    for size in range(2, 7):
        assert {(size, t) for t in ("common_seed", "rare_seed", "inside_word", "cross_word", "replacement", "insertion", "deletion", "no_match")} <= tags
    for r in rows:
        if r["mutation"] == "exact":
            assert TEXTS[r["source_sentence_id"]][r["expected_start"] :].startswith(r["q"])
        if "no_match" in r["tags"].split("|"):
            assert not any(r["q"] in t for t in TEXTS)
    assert rows == sampled.short_workload(corpus, 12).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, sampled.short_workload(corpus, 12).collect()))
    with pytest.raises(ValueError):
        sampled.short_workload(corpus, 1)
    assert all("no_match" in r["tags"] for r in sampled.short_workload(corpus.limit(0), 12).collect())


def test_real_workload_has_every_required_tag(corpus):
    rows = sampled.real_workload(corpus, 8).collect()
    assert set(sampled.REQUIRED_TAGS) <= {t for r in rows for t in r["tags"].split("|")}
    assert len({r["q"] for r in rows}) == len(rows) and all(r["q"] == r["q"].strip() for r in rows)
    for r in rows:
        if r["mutation"] == "exact":
            assert r["q"] in TEXTS[r["source_sentence_id"]]


def test_a_run_is_written_whole_and_resumed(phase, queries, corpus, spark, tmp_path):
    builds = trials.measure_builds({a: lambda path: spark.range(3).write.parquet(path) for a in trials.ALGORITHMS}, spark)
    work = trials.work(queries, corpus)
    stats = evaluate.corpus_stats(corpus.withColumn("source_path", F.lit("f")))
    path = f"file://{tmp_path}/run"
    for _ in range(2):  # the second run replaces the first
        summary = reports.write_run(path, phase, queries, corpus, work, builds, stats)
    there = {p.name for p in (tmp_path / "run").iterdir()}
    assert there == {*(f"{t}.json" for t in reports.JSON_TABLES), reports.CSV_TABLE, reports.REPORT} and [p.name for p in tmp_path.iterdir()] == ["run"]
    kept = json.loads(spark.read.text(f"{path}/summary.json").first()[0])
    assert set(kept) == {*summary, "incomplete_because"} and kept["incomplete_because"] == ["hybrid differs from the oracle"]
    assert "# Evaluation" in "\n".join(r[0] for r in spark.read.text(f"{path}/{reports.REPORT}").collect())
    rates = {r["algorithm_id"]: r for r in trials.work_rates(work).collect()}
    assert rates["naive"]["saved"] == 0 and 0 < rates["bi_anchor"]["fallback_rate"] < 1 and rates["bi_anchor"]["saved"] > 0

    asked: list[int] = []

    def run(todo):
        asked.append(todo.count())
        return todo.select("query_id", F.length("q").alias("n"))

    store = f"file://{tmp_path}/done"
    assert reports.resume(queries.limit(3), store, run).count() == 3
    assert reports.resume(queries, store, run).count() == len(QUERIES) and asked == [3, len(QUERIES) - 3]
    assert reports.resume(queries, store, run).count() == len(QUERIES) and len(asked) == 2

    def broken(to):
        spark.range(1).write.parquet(to)
        raise OSError("disk full")

    with pytest.raises(OSError):
        reports.replace_atomically(spark, broken, store)
    assert spark.read.parquet(store).count() == len(QUERIES)


def test_structures_are_checked_and_pairs_complete(queries, corpus):
    with pytest.raises(TypeError, match="sentences lack"):
        search.search_naive(queries, corpus.drop("n"))
    with pytest.raises(TypeError, match="queries lack"):
        search.search_bi_anchor(queries.drop("q"), corpus)
    rows = queries.select("query_id", F.lit("naive").alias("algorithm_id"))
    assert evaluate.unexpected_pairs(rows, queries, ["naive"]).count() == 0
    assert evaluate.unexpected_pairs(rows, queries.where("q <> 'a'"), ["naive"]).count() == 1 and evaluate.unexpected_pairs(rows, queries, ["other"]).count() == len(QUERIES)


def test_module_level_completer(corpus, spark):
    ranking._ENGINE.clear()
    with pytest.raises(RuntimeError):
        ranking.best_completions("ledger")
    sentences = corpus.select("sentence_id", F.col("n").alias("original_text"), F.col("n").alias("normalized_text"), F.lit("f").alias("source_path"), F.lit(1).alias("line_no"))
    ranking.init_completions(ranking.SearchEngine().build(sentences))
    assert [r["completed_sentence"] for r in ranking.best_completions("Ledger,", 2)] == [TEXTS[2], TEXTS[0]] and ranking.best_completions("!!") == []


def test_a_table_function_agrees_with_the_plan(queries, corpus, spark):
    """The verifier as a Python UDTF, row by row: only a cross-check of the plan."""

    class OneEdit:
        def eval(self, q: str, t: str):
            def compare_all(q, rest):
                m = len(q)
                t = rest[:m]
                if len(t) == m:
                    off = [i for i in range(m) if q[i] != t[i]]
                    if not off:
                        yield "exact", None, m
                    elif len(off) == 1:
                        yield "replacement", off[0], m - 1
                if len(rest) > m:
                    yield from (("insertion", i, m) for i in range(m + 1) if rest[:i] + rest[i + 1 : m + 1] == q)
                if m > 1 and len(rest) >= m - 1:
                    yield from (("deletion", i, m - 1) for i in range(m) if q[:i] + q[i + 1 :] == rest[: m - 1])

            for start in range(len(t)):
                for kind, index, correct in compare_all(q, t[start:]):
                    yield start, kind, index, correct

    spark.udtf.register("one_edit", F.udtf(OneEdit, returnType="match_start int, edit_type string, edit_index int, correct_characters int"))
    queries.createOrReplaceTempView("uq")
    corpus.createOrReplaceTempView("uc")
    got = {tuple(r) for r in spark.sql("select query_id, sentence_id, m.* from uq, uc, lateral one_edit(q, n) m where length(q) > 2").collect()}
    want = {tuple(r) for r in search.search_naive(queries.where("length(q) > 2"), corpus).select(search.MATCH_COLUMNS).collect()}
    assert got == want and got



def test_a_phase_stores_no_matches(queries, corpus, spark, monkeypatch):
    stored = []
    kept = trials.cut
    monkeypatch.setattr(trials, "cut", lambda df: stored.append(df.columns) or kept(df))
    got = trials.run_search_phase(queries, corpus)
    assert got.correctness.count() == 4 * len(QUERIES) and not any("match_start" in c for c in stored)
    for name, rows in got.results.items():
        want = {r["query_id"]: r for r in evaluate.compare_results(got.results["naive"], rows, search.MATCH_COLUMNS).collect()}
        for r in got.correctness.where(F.col("algorithm_id") == name).collect():
            w = want.get(r["query_id"])
            assert (r["false_negatives"], r["false_positives"]) == ((w["false_negatives"], w["false_positives"]) if w else (0, 0))


@pytest.mark.parametrize("keys", [0, 100])
def test_comparison_of_multisets(spark, monkeypatch, keys):
    monkeypatch.setattr(evaluate, "BROADCAST_KEYS", keys)
    a = spark.createDataFrame([("x", 1, None), ("x", 1, None), ("x", 2, 5), ("y", 3, 1), ("w", 1, 1)], "query_id string, v int, z int")
    b = spark.createDataFrame([("x", 1, None), ("x", 2, 6), ("z", 3, 1), ("y", 3, 1), ("y", 3, 1)], "query_id string, v int, z int")
    got = {tuple(r) for r in evaluate.compare_results(a, b, ["query_id", "v", "z"]).collect()}
    assert got == {("x", 2, 1, 1), ("y", 0, 1, 1), ("w", 1, 0, 0), ("z", 0, 1, 0)}
