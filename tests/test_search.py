from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from reference_definition import compare, search as definition

from textloom.operators import ranking, search

# The sentences and queries of the golden workload.
CORPUS = ["alpha beta gamma", "programming in python", "aaaaaa repeated repeated", "abababa pattern", "prefix suffix", "ends here", "hello world hello world", "bat dog", "x", "zz"]
QUERIES = ["", "a", "al", "alp", "alph", "alpha", "alpha ", "programming", "prograxming", "programing", "programmking", "gramm", "ming in", " beta", "gamma", "gammx", "aaaa", "aa", "aaaaaaa", "ababab", "ababa", "hello world",
           "world hello", "hello", "ello wor", "cat", "qqqqqqqq", "prefix", "suffix", "refix s", "ends her", "ends herre", "gamma programming", "x", "zz", "beta gamma", "repeated repeated"]
STRATEGIES = ["naive", "qgram", "bi_anchor"]


def tables(spark, queries, corpus):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, q string")
    s = spark.createDataFrame(list(enumerate(corpus)), "sentence_id long, n string")
    return q, s


def rows(df):
    got = [tuple(r) for r in df.select(search.MATCH_COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_golden_workload(spark, strategy):
    q, s = tables(spark, QUERIES, CORPUS)
    assert rows(ranking.STRATEGIES[strategy](q, s)) == definition(list(enumerate(QUERIES)), list(enumerate(CORPUS)))


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_random_texts(spark, strategy):
    pick = random.Random(7141)
    text = lambda n: "".join(pick.choice("ab ") for _ in range(pick.randint(0, n)))
    corpus, queries = [text(12) for _ in range(60)] + [None], [text(8) for _ in range(60)]
    q, s = tables(spark, queries, corpus)
    assert rows(ranking.STRATEGIES[strategy](q, s)) == definition(list(enumerate(queries)), [(i, n) for i, n in enumerate(corpus) if n])


def test_long_texts_are_windowed(spark):
    pick = random.Random(3)
    corpus = ["".join(pick.choice("abcdé ") for _ in range(900)), "b" * 300]
    queries = ["abcd", "dcb a", "bbbbbbb"]
    q, s = tables(spark, queries, corpus)
    want = definition(list(enumerate(queries)), list(enumerate(corpus)))
    assert rows(search.search_naive(q, s)) == want == rows(search.search_bi_anchor(q, s))


def test_many_queries_go_in_blocks(spark, monkeypatch):
    q, s = tables(spark, QUERIES, CORPUS)
    want = rows(search.search_naive(q, s))
    monkeypatch.setattr(search, "BROADCAST_CHARS", 400)
    assert search.Asked(q).blocks > 2
    for strategy in STRATEGIES:
        assert rows(ranking.STRATEGIES[strategy](q, s)) == want


def test_empty_tables(spark):
    q, s = tables(spark, ["abc", "abcdef"], CORPUS)
    for strategy in ranking.STRATEGIES.values():
        assert strategy(q.limit(0), s).count() == 0
        assert strategy(q, s.limit(0)).count() == 0


def test_plan_prefers_cheap_and_then_large(spark):
    q, s = tables(spark, ["hello world"], CORPUS)
    plan = search.anchor_plan(search.anchor_pairs(search.query_seeds(q, s, [1, 2, 3]))).first()
    assert plan["gram_size"] == 3 and plan["first_start"] + 3 <= plan["second_start"]
    q, s = tables(spark, ["zzz"], ["a"])
    assert search.anchor_plan(search.anchor_pairs(search.query_seeds(q, s, [1]))).first()["cost"] == 0


def test_seed_index_of_three_sentences(spark):
    _, s = tables(spark, [], ["banana split", "banana bread", "hello world"])
    got = {r["gram"]: r["frequency"] for r in search.seed_index(s, [1, 2, 3]).collect()}
    assert (got["a"], got["an"], got["ana"]) == (7, 4, 4)
    counted = {(r["gram_size"], r["gram"]): r["frequency"] for r in search.seed_frequency(s, [1, 2, 3]).collect()}
    indexed = {(r["gram_size"], r["gram"]): r["frequency"] for r in search.seed_index(s, [1, 2, 3]).collect()}
    assert counted == indexed
    places = search.seed_occurrences(spark.createDataFrame([(3, "lo "), (3, "o w"), (3, " wo"), (3, "ana")], "gram_size int, gram string"), s)
    assert {(r["gram"], r["sentence_id"], r["position"]) for r in places.collect()} == {("lo ", 2, 3), ("o w", 2, 4), (" wo", 2, 5), ("ana", 0, 1), ("ana", 0, 3), ("ana", 1, 1), ("ana", 1, 3)}


def test_hybrid_sees_word_starts_only(spark):
    queries = ["hello", "ello", "programing", "pythom", "cat", "o w"]
    q, s = tables(spark, queries, CORPUS)
    got = rows(search.search_hybrid(q, s))
    want = set()
    for i, query in enumerate(queries):
        for j, n in enumerate(CORPUS):
            at = 0
            for w in n.split(" "):
                m = len(query)
                near = (len(w) <= 4 and abs(len(w) - m) <= 1) if m <= 4 else (len(w) > 4 and any(query[k : k + 3] in w for k in range(m - 2)))
                for size in (m - 1, m, m + 1):
                    if near and 0 < size <= len(w):
                        want |= {(i, j, at, *x) for x in compare(query, w[:size])[:1]}
                at += len(w) + 1
    assert got == want
    assert search.search_hybrid(q, s, cap=1).groupBy("query_id").count().agg(F.max("count")).first()[0] == 1


def test_stored_index(spark, tmp_path):
    from textloom.sources import index_store

    q, s = tables(spark, QUERIES, CORPUS)
    table = s.select("sentence_id", F.col("n").alias("original_text"), F.col("n").alias("normalized_text"), F.lit("a").alias("source_path"), F.col("sentence_id").cast("int").alias("line_no"))
    index_store.save_index(table, str(tmp_path / "index"), [1, 2, 3])
    index = index_store.load_index(spark, str(tmp_path / "index"), [1, 2, 3])
    assert rows(ranking.SearchEngine.from_index(index, [1, 2, 3]).raw_candidates(q)) == rows(search.search_naive(q, s))


def test_stored_starts_stand_once_and_are_written_without_an_exchange(spark, tmp_path):
    from textloom.sources import index_store

    q, s = tables(spark, QUERIES, CORPUS + ["abcdé " * 90, "\U0001f600\U0001f601\U0001f600 x"])
    table = s.select("sentence_id", F.col("n").alias("original_text"), F.col("n").alias("normalized_text"), F.lit("a").alias("source_path"), F.col("sentence_id").cast("int").alias("line_no"))
    assert "hashpartitioning" not in (plan := search.posting_lists(s, [1, 2, 3])._jdf.queryExecution().executedPlan().toString()) and "rangepartitioning" not in plan
    for sizes in ([1, 2, 3], [2, 5]):
        path = str(tmp_path / f"index{len(sizes)}")
        index_store.save_index(table, path, sizes)
        index = index_store.load_index(spark, path, sizes)
        ends = s.select(F.sum(F.greatest(F.length("n") - (min(sizes) - 1), F.lit(0)))).first()[0]
        assert index["lists"].agg(F.sum("n")).first()[0] == ends
        want = {tuple(r) for r in search.postings(s, sizes).collect()}
        got = [tuple(r) for r in index["postings"].collect()]
        assert len(got) == len(set(got)) and set(got) == want
        some = {(size, gram) for size, gram, *_ in want if gram[0] in "ab\U0001f600"}
        assert {tuple(r) for r in search._postings_of(index, some, sizes).collect()} == {r for r in want if r[:2] in some}


@pytest.mark.parametrize("few", [0, 500])
def test_a_stored_index_with_many_postings_is_matched_without_an_exchange(spark, tmp_path, monkeypatch, few):
    from textloom.sources import index_store

    q, s = tables(spark, QUERIES, CORPUS)
    table = s.select("sentence_id", F.col("n").alias("original_text"), F.col("n").alias("normalized_text"), F.lit("a").alias("source_path"), F.col("sentence_id").cast("int").alias("line_no"))
    index_store.save_index(table, str(tmp_path / "index"), [1, 2, 3])
    index = index_store.load_index(spark, str(tmp_path / "index"), [1, 2, 3])
    want = rows(search.search_naive(q, s))
    monkeypatch.setattr(search, "FEW_QUERIES", few)
    for starts, characters in ((0, 1), (0, 10**9), (10**9, 1)):
        monkeypatch.setattr(search, "FEW_STARTS", starts)
        got = ranking.SearchEngine.from_index(index | {"characters": characters}, [1, 2, 3]).raw_candidates(q)
        assert rows(got) == want
        if characters == 1 and not (few and starts):
            assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_stored_runs_are_sorted():
    import pyarrow as pa

    from textloom.operators import scan

    pick = random.Random(23)
    texts = ["".join(pick.choice("ab😀é ") for _ in range(pick.randint(1, 9))) for _ in range(60)]
    ids = pick.sample(range(1000), 60)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 20]), pa.array([0] * 20, pa.int32()), pa.array(texts[i : i + 20]), pa.array([len(t) for t in texts[i : i + 20]], pa.int32())], ["sentence_id", "at", "text", "starts"]) for i in (0, 20, 40)]
    for longest, least in ((3, 1), (2, 2), (40, 3)):
        (run,) = scan.runs(longest, least, iter(batches))
        got = [(r["tail"], i, p) for r in run.to_pylist() for i, p in zip(r["sentence_ids"], r["positions"], strict=True)]
        assert got == sorted((t[p : p + longest], i, p) for i, t in zip(ids, texts) for p in range(len(t)) if len(t) - p >= least)
        assert run["tail"].to_pylist() == sorted(set(run["tail"].to_pylist())) and run["n"].to_pylist() == [len(x) for x in run["positions"].to_pylist()]


def test_votes(spark):
    q, s = tables(spark, ["hello world", "zz"], CORPUS)
    votes = search.gram_votes(q, s)
    assert [(r["query_id"], r["sentence_id"], r["votes"]) for r in votes.collect()] == [(0, 6, 9)]
    assert search.select_by_votes(votes).count() == 1


def test_engine(spark):
    engine = ranking.SearchEngine()
    with pytest.raises(RuntimeError):
        engine.raw_candidates(None)
    with pytest.raises(TypeError):
        engine.build(spark.range(1))
    rows_ = [(0, "To be, or not to be", "to be or not to be", "a.txt", 1), (1, "Abstract", "abstract", "a.txt", 15), (2, "Abstract", "abstract", "a.txt", 402), (3, "Abstract", "abstract", "b.txt", 15), (4, "Zabstract", "zabstract", "b.txt", 1)]
    engine.build(spark.createDataFrame(rows_, "sentence_id long, original_text string, normalized_text string, source_path string, line_no int"))
    asked = spark.createDataFrame([("a", "to be or NOT!"), ("b", "abstract"), ("c", "!!!"), ("d", None)], "query_id string, prefix string")
    seen = []
    got = [tuple(r) for r in engine.complete(asked, on_candidates=seen.append).orderBy("query_id", "rank").collect()]
    assert got[0] == ("a", "To be, or not to be", "a.txt", 1, 24, 1)
    assert [r[1:4] for r in got[1:]] == [("Abstract", "a.txt", 15), ("Abstract", "a.txt", 402), ("Abstract", "b.txt", 15), ("Zabstract", "b.txt", 1)]
    assert len(seen) == 1
    with pytest.raises(ValueError):
        engine.complete(asked, k=0)


def test_hebrew_scores(spark):
    sentence = "להיות או לא להיות, זאת השאלה"
    engine = ranking.SearchEngine("naive").build(spark.createDataFrame([(0, sentence, "להיות או לא להיות זאת השאלה", "a", 1)], "sentence_id long, original_text string, normalized_text string, source_path string, line_no int"))
    asked = spark.createDataFrame([("1", "להיות או לא"), ("2", "להיות או לו"), ("3", "להיןת או לא"), ("4", "להייות או לא"), ("5", "להות או לא")], "query_id string, prefix string")
    assert [r["score"] for r in engine.complete(asked).orderBy("query_id").collect()] == [22, 19, 18, 18, 14]


def test_few_queries_are_matched_without_an_exchange(spark):
    q, s = tables(spark, QUERIES, CORPUS)
    for strategy in STRATEGIES:
        plan = ranking.STRATEGIES[strategy](q, s)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "MapInArrow" in plan


def test_every_split_finds_each_match_once():
    import pyarrow as pa

    from textloom.operators import scan

    pick = random.Random(5)
    for letters in ("a", "ab", "abcdé "):
        text = lambda least, n: "".join(pick.choice(letters) for _ in range(pick.randint(least, n)))  # noqa: B023, E731
        corpus, queries = [text(1, 14) for _ in range(30)], [text(1, 9) for _ in range(30)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([0] * 30, pa.int32()), pa.array(corpus), pa.array([len(c) for c in corpus], pa.int32())], ["sentence_id", "at", "text", "starts"])
        for make in (scan.halves, lambda q: scan.ends(q, len(q) // 2) if len(q) > 1 else scan.halves(q), lambda q: scan.anchors(q, 1, len(q) // 3, len(q) - 1) if len(q) > 2 else scan.halves(q)):
            for indexed in (False, True):
                got = [tuple(r.values()) for b in scan.listed(scan.Matcher([make(q) for q in queries], indexed), pa.array(range(30)), iter([batch])) for r in b.to_pylist()]
                assert len(got) == len(set(got)) and set(got) == definition(list(enumerate(queries)), list(enumerate(corpus)))


def test_matches_are_handed_on_in_lists(spark, monkeypatch):
    import pyarrow as pa

    from textloom.operators import scan

    q, s = tables(spark, QUERIES, CORPUS)
    splits = search.halved(search.Asked(q))
    assert splits.matcher.indexed and "match_starts" in search.search_naive(q, s)._jdf.queryExecution().executedPlan().toString()
    assert ("a", None) in {(r["q"], r["sentence_id"]) for r in search.search_naive(q, s.union(spark.createDataFrame([(None, "a")], s.schema))).join(q, "query_id").collect()}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(CORPUS))), pa.array([0] * len(CORPUS), pa.int32()), pa.array(CORPUS), pa.array([len(c) for c in CORPUS], pa.int32())], ["sentence_id", "at", "text", "starts"])
    want = definition(list(enumerate(QUERIES)), list(enumerate(CORPUS)))
    for most in (100_000, 3):
        monkeypatch.setattr(scan, "ROWS", most)
        lists = [r for b in scan.grouped(splits.matcher, splits.ids, iter([batch])) for r in b.to_pylist()]
        assert len(lists) < len(want) and max(len(r["match_starts"]) for r in lists) <= most
        got = [(r["query_id"], i, p, r["edit_type"], r["edit_index"], r["correct_characters"]) for r in lists for i, p in zip(r["sentence_ids"], r["match_starts"], strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


LONG = ["aaaaaa " * 60, "alpha beta " * 80, "alpha", None, ""]


def test_kinds_are_counted_without_their_matches(spark):
    pick = random.Random(11)
    corpus = CORPUS + LONG + ["".join(pick.choice("ab ") for _ in range(12)) for _ in range(40)]
    q, s = tables(spark, QUERIES, corpus)
    s = s.unionByName(s.limit(3)).unionByName(spark.createDataFrame([(None, "alpha beta")], s.schema)).repartition(3)
    want = search.search_naive(q, s).groupBy("query_id", "edit_type").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("sentence_id").alias("n_sentences"))
    got = search.count_kinds(q, s)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema.simpleString() == want.schema.simpleString()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(matches" in plan and "match_start" not in plan


def test_starts_are_counted_without_being_listed(spark):
    pick = random.Random(13)
    q, s = tables(spark, QUERIES + ["abab ", "aab"], CORPUS + LONG + ["".join(pick.choice("ab ") for _ in range(12)) for _ in range(40)])
    asked = search.Asked(q)
    plan = search.anchor_plan(search.anchor_pairs(search.query_seeds(q, s, [1, 2, 3])))
    slices = search.context_slices(search.candidate_contexts(plan, s, [1, 2, 3]), s).cache()
    want = {r["query_id"]: (r["a"], r["b"]) for r in slices.groupBy("query_id").agg(F.countDistinct("sentence_id", "match_start").alias("a"), F.count(F.lit(1)).alias("b")).collect()}
    got = search.count_starts(plan, s, asked)
    assert {r["query_id"]: (r["candidate_count"], r["calls"]) for r in got.collect()} == want
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_best_records_are_found_in_place(spark):
    pick = random.Random(17)
    texts = [t for t in CORPUS + LONG if t] + ["".join(pick.choice("ab ") for _ in range(12)) for _ in range(30)]
    made = [(i, None if i % 9 == 4 else t.upper(), t, pick.choice(["f", None]), pick.randint(1, 2)) for i, t in enumerate(texts * 4)] + [(None, "ALPHA", "alpha", "f", 1), (900, "X", None, "f", 1)]
    pick.shuffle(made)
    s = spark.createDataFrame(made, "sentence_id long, original_text string, normalized_text string, source_path string, line_no int").repartition(3)
    q, _ = tables(spark, QUERIES, CORPUS)
    n = s.withColumn("n", F.col("normalized_text"))
    want = ranking.best_per_record(search.search_naive(q, n), s)
    got = ranking.best_in_place(q, n)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and "match_start" not in got._jdf.queryExecution().executedPlan().toString()
    for k in (1, 5):
        assert sorted(map(str, ranking.top_k(ranking.best_in_place(q, n, k), k).collect())) == sorted(map(str, ranking.top_k(want, k).collect()))
    assert ranking.best_in_place(q, n.unionByName(n.limit(3))) is None and ranking.best_in_place(q.limit(3), n) is None


def test_hybrid_joins_only_words_within_the_cap(spark):
    q, s = tables(spark, ["a", "alpha", "hello", "bat", "hello"], CORPUS * 3 + ["alpha alphx aalpha hello hellp help"] * 3)
    kinds = {"exact": 0, "replacement": 1, "insertion": 2, "deletion": 3}
    texts = {r["sentence_id"]: r["n"] for r in s.collect()}
    whole = search.search_hybrid(q, s, cap=10**6).collect()
    for cap in (1, 2, 5, 7):
        want = set()
        for i in {r["query_id"] for r in whole}:
            own = [r for r in whole if r["query_id"] == i]
            own.sort(key=lambda r: (kinds[r["edit_type"]], texts[r["sentence_id"]][r["match_start"] :].split(" ")[0], r["sentence_id"], r["match_start"]))
            want |= set(map(tuple, own[:cap]))
        got = search.search_hybrid(q, s, cap=cap)
        assert set(map(tuple, got.collect())) == want
        assert "n_word" in got._jdf.queryExecution().executedPlan().toString()


def test_matches_at_given_places(spark):
    q, s = tables(spark, QUERIES, CORPUS + [t for t in LONG if t])
    whole = search.search_naive(q, s)
    some = whole.where("match_start % 3 = 0")
    assert rows(search.matches_at(some.unionByName(some), q, s)) == rows(some)
