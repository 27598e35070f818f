"""Corpus and index statistics, evaluation summaries, workloads and samples; with their SQL.

The observations that an evaluation would measure are stood in for by what the tables hold: a run of a query
(`seed_candidates.run_no`) is an algorithm, the frequencies it considered are its work, in place of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import evaluate, search, workload
from textloom.plans.search_queries import asked, sentences
from textloom.plans.search_sql import ASKED, CORPUS, FOUND, GRAMS, PAIRS, SEARCH, SEEDS, SQL as SEARCH_SQL, VOCABULARY, WORDS
from textloom.session import table

SIZES = [1, 2, 3]
PER_CATEGORY = 50


def corpus_stats(spark, folder):
    rows = table(spark, folder, "prepared_sentences").select("source_path", F.col("normalized_text").alias("n"))
    return evaluate.corpus_stats(rows)


def index_stats(spark, folder):
    return evaluate.index_stats(sentences(spark, folder), SIZES)


def structure_metrics(spark, folder):
    return evaluate.structure_metrics(sentences(spark, folder), SIZES)


def trie_nodes(spark, folder):
    return evaluate.trie_nodes(sentences(spark, folder))


def nearest_rank(spark, folder):
    """Percentiles of the scores of every query, never interpolated."""
    rows = table(spark, folder, "completions").where(F.col("query_id").isNotNull())
    return rows.groupBy("query_id").agg(*[evaluate.disc("score", p, "int").alias(f"p{p}") for p in evaluate.PERCENTILES])


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "seed_candidates").where(F.col("frequency") >= 0)
    return rows.select("query_id", F.concat(F.lit("run"), F.col("run_no").cast("string")).alias("algorithm_id"), F.col("frequency").cast("double").alias("sample"))


def _medians(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(spark, folder).groupBy("query_id", "algorithm_id").agg(F.median("sample").alias("median"))


def latency_summary(spark, folder):
    return evaluate.latency_summary(_samples(spark, folder), ["algorithm_id"], "sample")


def win_rates(spark, folder):
    return evaluate.win_rates(_medians(spark, folder))


def speedup(spark, folder):
    return evaluate.speedups(_medians(spark, folder), "run1")


def break_even(spark, folder):
    medians = _medians(spark, folder)
    builds = medians.groupBy("algorithm_id").agg(F.sum("median").alias("build"))
    return evaluate.break_even(medians, builds, "run1")


def word_counts(spark, folder):
    return search.words(sentences(spark, folder)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def gram_counts(spark, folder):
    return search.seed_frequency(sentences(spark, folder), [3]).select("gram", "frequency")


def tag_counts(spark, folder):
    return table(spark, folder, "queries").select(F.explode("categories").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _results(spark, folder):
    return table(spark, folder, "completions").where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))


def _distinct_queries(spark, folder):
    return table(spark, folder, "queries").select("query_id", F.col("normalized_query").alias("q"), "categories").dropDuplicates(["query_id"])


def by_length(spark, folder):
    return evaluate.by_length(_distinct_queries(spark, folder), _results(spark, folder))


def by_category(spark, folder):
    return evaluate.by_category(_distinct_queries(spark, folder), _results(spark, folder))


def signature(spark, folder):
    """Signatures of the logged completions of each query."""
    rows = table(spark, folder, "completions").where(F.col("query_id").isNotNull())
    return evaluate.signature(rows, ["completed_sentence", "source_text", "line_no", "score"])


def multiset_diff(spark, folder):
    """The hybrid against the exhaustive strategies: false negatives, false positives, common matches per query.

    All matches are only counted; those at the places of the hybrid's capped results are compared with these, row by row.
    """
    s, q = sentences(spark, folder), asked(spark, folder)
    found = search.search_hybrid(q, s)
    near = evaluate.compare_results(search.matches_at(found, q, s), found, search.MATCH_COLUMNS, True)
    all_ = search.count_kinds(q, s).groupBy("query_id").agg(F.sum("matches").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return all_.join(near, "query_id", "full_outer").select("query_id", (zero("n") - zero("common")).alias("false_negatives"), zero("false_positives").alias("false_positives"), zero("common").alias("common"))


def missing_pairs(spark, folder):
    """Queries of the workload without a first or second run."""
    rows = _samples(spark, folder)
    return evaluate.missing_pairs(rows, _distinct_queries(spark, folder), ["run1", "run2"])


def merged_queries(spark, folder):
    """Equal query texts as one, with all their categories."""
    rows = table(spark, folder, "queries").select("normalized_query", F.explode("categories").alias("c"))
    return rows.groupBy("normalized_query").agg(F.array_join(F.array_sort(F.collect_set("c")), "|").alias("categories"))


def naive_work(spark, folder):
    return evaluate.naive_work(asked(spark, folder), sentences(spark, folder))


def work_reduction(spark, folder):
    """Per query the share of exhaustive verifications that the anchors save, in aligned starts."""
    s, q = sentences(spark, folder), asked(spark, folder)
    plan = search.anchor_plan(search.anchor_pairs(search.query_seeds(q, s, SIZES)))
    total = evaluate.naive_work(q, s)
    return plan.join(total, "query_id").select("query_id", "cost", "verifier_calls", (1 - F.col("cost") * 9 / F.col("verifier_calls")).alias("reduction"))


def work_summary(spark, folder):
    rows = table(spark, folder, "seed_candidates").select("run_no", F.col("frequency").cast("long").alias("frequency"), (F.col("query_end") - F.col("query_start")).cast("long").alias("width"))
    return evaluate.work_summary(rows, ["run_no"], ["frequency", "width"])


def worst_queries(spark, folder):
    """The 25 costliest queries of each run."""
    return evaluate.extremes(_medians(spark, folder), "algorithm_id", "median", 25)


def best_queries(spark, folder):
    return evaluate.extremes(_medians(spark, folder), "algorithm_id", "median", 20, worst=False)


def _rows(spark, folder):
    return table(spark, folder, "prepared_sentences").select("sentence_id", "source_path")


def stratified_order(spark, folder):
    return workload.stratified_order(_rows(spark, folder), "source_path", "sentence_id").select("sentence_id", "turn", "source_draw")


def stratified_slice(spark, folder):
    """A tenth of the corpus, sources taking turns: a sampling operator."""
    return workload.stratified_slice(_rows(spark, folder), "source_path", "sentence_id", 0.1)


def prefix_slice(spark, folder):
    """The first quarter of the corpus: a sampling operator."""
    return workload.prefix_slice(_rows(spark, folder), "sentence_id", 25)


def even_slice(spark, folder):
    """A hundred sentences at even distances: a sampling operator."""
    return workload.even_slice(_rows(spark, folder), "sentence_id", 100)


def frequency_probes(spark, folder):
    return workload.frequency_probes(sentences(spark, folder))


def execution_subset(spark, folder):
    return workload.execution_subset(table(spark, folder, "queries"))


def generated_workload(spark, folder):
    return workload.generate(sentences(spark, folder), PER_CATEGORY).withColumn("categories", F.array_join("categories", "|"))


def synthetic_corpora(spark, folder):
    """Made-up corpora searched for one phrase each: matches per corpus."""
    out = None
    for kind, phrase in (("synthetic", "harbor"), ("repetitive", "oooo"), ("high_frequency", "remark"), ("cross_word", "ing cov")):
        q = spark.createDataFrame([(kind, phrase)], "query_id string, q string")
        part = search.search_bi_anchor(q, workload.synthetic_corpus(spark, kind)).groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        corpus_stats, index_stats, structure_metrics, trie_nodes, nearest_rank, latency_summary, win_rates, speedup, break_even, word_counts, gram_counts, tag_counts, by_length, by_category, signature, multiset_diff,
        missing_pairs, merged_queries, naive_work, work_reduction, work_summary, worst_queries, best_queries, stratified_order, stratified_slice, prefix_slice, even_slice, frequency_probes, execution_subset,
        generated_workload, synthetic_corpora,
    )
}

_SAMPLES = "x as (select query_id, 'run' || run_no as algorithm_id, frequency::double as sample from seed_candidates where frequency >= 0)"
_MEDIANS = f"{_SAMPLES}, m as (select query_id, algorithm_id, median(sample) as median from x group by all)"
_DISC = "percentile_disc({p}) within group (order by {c})"
_FREQ = "f as (select gram_size, gram, count(*) as frequency from g group by all)"
_LADDER_NAMES = "(values ('1'), ('2'), ('3'), ('4'), ('5'), ('6'), ('7-8'), ('9-12'), ('13-20'), ('21+')) b(length_bucket)"
_RATIO = "r as (select o.algorithm_id, b.median / greatest(1.0, o.median) as r, b.median - o.median as saving from m o join m b on b.query_id = o.query_id and b.algorithm_id = 'run1' where o.algorithm_id <> 'run1')"
_DRAW = f"md5('{workload.SEED}:' || {{0}})"
_STRATA = f"t as (select sentence_id, source_path, cast(row_number() over (partition by source_path order by {_DRAW.format('sentence_id')}, sentence_id) as int) as turn, {_DRAW.format('source_path')} as source_draw from prepared_sentences)"


def _disc(c: str, p: float) -> str:
    return _DISC.format(p=p / 100, c=c)


_VOCABULARY = str(list(workload.VOCABULARY))
_SYNTHETIC = "with i as (select unnest(generate_series(0, 299)) as id), " + SEARCH.replace(
    CORPUS,
    f"""s as (
  select id as sentence_id, array_to_string([{_VOCABULARY}[(id + 1) * (k + 2) * 6007 // 13 % 8 + 1] for k in generate_series(0, 9)], ' ') as n, 'synthetic' as kind from i
  union all select id, case when id % 2 = 0 then repeat('oo', 45) else trim(repeat('so it ', 15)) end, 'repetitive' from i
  union all select id, 'one usual remark about item ' || id % 10, 'high_frequency' from i
  union all select id, 'sliding corner ' || id || ' wing cover', 'cross_word' from i)""",
).replace(ASKED, "q as (select *, cast(length(q) as int) as m from (values ('synthetic', 'harbor'), ('repetitive', 'oooo'), ('high_frequency', 'remark'), ('cross_word', 'ing cov')) v(query_id, q))").replace("from s join q on ", "from s join q on kind = query_id and (").replace(
    "contains(n, substring(q, m // 2 + 1))),", "contains(n, substring(q, m // 2 + 1)))),"
) + " select query_id, count(*) as matches from e group by query_id"

_SEED = workload.SEED


def _few(source: str, where: str, key: str, seed: int) -> str:
    return f"(select * from {source} where {where} order by md5('{seed}:' || {key}), {key} limit {PER_CATEGORY}) t"


def _number(key: str) -> str:
    return f"cast('0x' || left(md5({key}), 8) as bigint)"


def _generated() -> str:
    """Drafts of each category, merged by text."""
    row = "select {q} as q, '{category}' as category, {mutation} as mutation_type, sentence_id, cast({start} as int) as start from {source}"
    make = lambda source, q, category, start, mutation="null::varchar": row.format(q=q, category=category, mutation=mutation, start=start, source=source)
    parts = []
    for size in range(1, 7):
        cut = f"(select sentence_id, start, substring(n, start + 1, {size}) as q from (select *, {_number(f"'{_SEED}:{size}:' || sentence_id")} % (length(n) - {size} + 1) as start from s where length(n) >= {size}) a)"
        parts.append(make(_few(cut, "trim(q) = q", "cast(sentence_id as varchar)", _SEED + size), "q", "exact", "start"))
    parts.append(make(_few("d", "length(word) >= 2", "word", _SEED + 10), "word", "whole_word", "start_pos"))
    parts.append(make(_few("d", "length(word) >= 7", "word", _SEED + 10), "substring(word, 2, least(8, length(word) - 2))", "inside_word", "start_pos + 1"))
    begin = "greatest(1, strpos(n, ' ') - 4)"
    parts.append(make(_few("s", "strpos(n, ' ') > 0", "cast(sentence_id as varchar)", _SEED + 20), f"trim(substring(n, {begin}, strpos(n, ' ') + 6 - {begin}))", "cross_word", f"{begin} - 1"))
    parts.append(make(_few("s", "length(n) >= 6", "cast(sentence_id as varchar)", _SEED + 21), "trim(left(n, 12))", "boundary_near_start", "0"))
    parts.append(make(_few("s", "length(n) >= 6", "cast(sentence_id as varchar)", _SEED + 22), "trim(right(n, 12))", "boundary_near_end", "greatest(0, length(n) - 12)"))
    mutable = f"(select *, 1 + {_number('word')} % (length(word) - 2) as i from {_few('d', 'length(word) >= 6', 'word', _SEED + 30)}) t"
    for kind, q in (("replacement", "left(word, i) || case when substring(word, i + 1, 1) = 'x' then 'z' else 'x' end || substring(word, i + 2)"), ("missing_character", "left(word, i) || substring(word, i + 2)"), ("extra_character", "left(word, i) || 'x' || substring(word, i + 1)")):
        parts.append(make(mutable, q, "near_miss", "start_pos", f"'{kind}'"))
    parts.append("select gram, 'frequency_' || frequency_band, null, null, null from p where trim(gram) = gram")
    absent = f"(select *, word || 'zz' || left(md5(word), 3) as q from {_few('d', 'true', 'word', _SEED + 40)}) t where q not in (select word from d)"
    parts.append(make(absent, "lower(q)", "no_match", "start_pos", "'real_derived_no_match'"))
    bands = " union all ".join(f"select 'p{p}' as frequency_band, {_disc('frequency', p)} as frequency from h" for p in (50, 75, 90, 95, 99))
    ladder = "case when length(q) <= 6 then cast(length(q) as varchar) when length(q) <= 8 then '7-8' when length(q) <= 12 then '9-12' when length(q) <= 20 then '13-20' else '21+' end"
    return f"""with {CORPUS}, {WORDS}, d as (select word, min(sentence_id) as sentence_id, arg_min(start_pos, (sentence_id, start_pos)) as start_pos from w where word <> '' group by word),
h as (select substring(n, i + 1, 3) as gram, count(*) as frequency from s, unnest(generate_series(0, length(n) - 3)) u(i) where length(n) >= 3 group by 1),
b as ({bands} union all select 'rare', min(frequency) from h), p as (select frequency_band, min(gram) as gram from b join h on h.frequency = b.frequency group by 1),
x as ({" union all ".join(parts)}),
y as (select *, (category, coalesce(mutation_type, ''), coalesce(sentence_id, -1), coalesce(start, -1)) as o from x where q <> '')
select 'w' || left(md5(q), 10) as query_id, q as query_text, cast(length(q) as int) as query_length, {ladder} as length_bucket, min(category) as primary_category, string_agg(distinct category, '|' order by category) as categories,
  case when bool_or(true) then list_extract(list(mutation_type order by o), 1) end as mutation_type, list_extract(list(sentence_id order by o), 1) as source_sentence_id, list_extract(list(start order by o), 1) as source_start
from y group by q"""


SQL = {
    "generated_workload": _generated(),
    "corpus_stats": f"""with s as (select source_path, normalized_text as n, length(normalized_text) as len from prepared_sentences where normalized_text is not null),
w as (select unnest(string_split(n, ' ')) as word from s)
select count(distinct source_path) as files, count(*) as sentences, cast(sum(len) as bigint) as characters, (select count(*) from w where word <> '') as words, (select count(distinct word) from w where word <> '') as unique_words,
cast(min(len) as int) as length_min, avg(len) as length_mean, median(len) as length_median, {", ".join(f"cast({_disc('len', p)} as int) as length_p{p}" for p in evaluate.PERCENTILES[1:])}, cast(max(len) as int) as length_max from s""",
    "index_stats": f"with {CORPUS}, {GRAMS}, {_FREQ} select gram_size, count(*) as distinct_grams, cast(sum(frequency) as bigint) as occurrences from f group by rollup (gram_size)",
    "structure_metrics": f"with {CORPUS}, {GRAMS}, {_FREQ} select gram_size, max(frequency) as max_postings, median(frequency) as median_postings, {_disc('frequency', 95)} as p95_postings, {_disc('frequency', 99)} as p99_postings from f group by gram_size",
    "trie_nodes": f"with {CORPUS}, {WORDS}, {VOCABULARY}, p as (select distinct left(word, i) as p from v, unnest(generate_series(1, length(word))) u(i)) select count(*) + 1 as nodes, count(*) as edges, (select count(*) from v) as terminals from p",
    "nearest_rank": f"select query_id, {', '.join(f'{_disc("score", p)} as p{p}' for p in evaluate.PERCENTILES)} from completions where query_id is not null group by query_id",
    "latency_summary": f"with {_SAMPLES} select algorithm_id, count(*) as n, avg(sample) as mean, median(sample) as median, coalesce(stddev_samp(sample), 0) as stdev, min(sample) as min, case when count(*) >= 5 then {_disc('sample', 95)} end as p95, max(sample) as max from x group by algorithm_id",
    "win_rates": f"""with {_MEDIANS}, w as (select *, case when median <= min(median) over (partition by query_id) * 1.02 then 1 else 0 end as w from m), k as (select *, sum(w) over (partition by query_id) as n_w from w)
select algorithm_id, count(*) as queries, cast(sum(case when w = 1 and n_w = 1 then 1 else 0 end) as bigint) as wins, cast(sum(case when w = 1 and n_w > 1 then 1 else 0 end) as bigint) as ties, sum(case when w = 1 then 1.0::double / n_w else 0 end) as split_wins from k group by algorithm_id""",
    "speedup": f"with {_MEDIANS}, {_RATIO} select algorithm_id, median(r) as median, avg(r) as mean, {_disc('r', 75)} as p75, {_disc('r', 90)} as p90, max(r) as best, min(r) as worst from r group by algorithm_id",
    "break_even": f"""with {_MEDIANS}, {_RATIO}, b as (select algorithm_id, sum(median) as build from m group by all), a as (select algorithm_id, avg(saving) as s from r group by all)
select a.algorithm_id, case when s > 0 then cast(ceil(greatest(0.0, build - (select build from b where algorithm_id = 'run1')) / s) as bigint) end as queries from a join b on a.algorithm_id = b.algorithm_id""",
    "word_counts": f"with {CORPUS}, {WORDS} select word, count(*) as n from w where word <> '' group by word",
    "gram_counts": f"with {CORPUS}, {GRAMS} select gram, count(*) as frequency from g where gram_size = 3 group by gram",
    "tag_counts": "select tag, count(*) as n from (select unnest(categories) as tag from queries) t group by tag",
    "by_length": f"""with d as (select distinct query_id, normalized_query from queries), c as (select query_id, count(*) as results from completions where query_id is not null group by 1),
r as (select length(normalized_query) as l, results from d left join c on c.query_id = d.query_id),
k as (select case when l <= 6 then cast(l as varchar) when l <= 8 then '7-8' when l <= 12 then '9-12' when l <= 20 then '13-20' else '21+' end as length_bucket, count(*) as queries, count(results) as with_results, sum(results) as results from r group by 1)
select b.length_bucket, cast(coalesce(queries, 0) as bigint) as queries, cast(coalesce(with_results, 0) as bigint) as with_results, cast(coalesce(results, 0) as bigint) as results from {_LADDER_NAMES} left join k on k.length_bucket = b.length_bucket""",
    "by_category": """with d as (select distinct query_id, unnest(categories) as category from queries), c as (select query_id, count(*) as results from completions where query_id is not null group by 1)
select category, count(*) as queries, cast(coalesce(sum(results), 0) as bigint) as results from d left join c on c.query_id = d.query_id group by category""",
    "signature": """with d as (
  select query_id, md5(completed_sentence || chr(1) || source_text || chr(1) || line_no || chr(1) || coalesce(cast(score as varchar), chr(0))) as h from completions where query_id is not null)
select query_id, count(*) as n, cast(sum(cast('0x' || substring(h, 1, 8) as bigint)) as bigint) as sum_1, cast(sum(cast('0x' || substring(h, 9, 8) as bigint)) as bigint) as sum_2 from d group by query_id""",
    "multiset_diff": f"""with o as (with {SEARCH} {FOUND}), a as ({SEARCH_SQL['search_hybrid']}),
t as (select *, 1 as o, 0 as a from o union all select *, 0, 1 from a),
k as (select query_id, sum(o) as o, sum(a) as a from t group by query_id, sentence_id, match_start, edit_type, edit_index, correct_characters)
select query_id, cast(sum(greatest(0, o - a)) as bigint) as false_negatives, cast(sum(greatest(0, a - o)) as bigint) as false_positives, cast(sum(least(o, a)) as bigint) as common from k group by query_id""",
    "work_reduction": f"""with {CORPUS}, {ASKED}, {GRAMS}, {SEEDS}, {PAIRS},
l as (select query_id, m + d as l from q, (select unnest([-1, 0, 1]) as d) v where m + d > 0),
n as (select query_id, cast(sum(greatest(0, length(n) - l + 1)) as bigint) as verifier_calls from l join s on true group by query_id)
select plan.query_id, cost, verifier_calls, 1 - cost * 9 / verifier_calls::double as reduction from plan join n on n.query_id = plan.query_id""",
    "synthetic_corpora": _SYNTHETIC,
    "missing_pairs": f"with {_SAMPLES}, d as (select distinct query_id from queries), a as (select unnest(['run1', 'run2']) as algorithm_id) select query_id, algorithm_id from (select d.query_id, a.algorithm_id from d join a on true) p where not exists (select 1 from x where x.query_id = p.query_id and x.algorithm_id = p.algorithm_id)",
    "merged_queries": "select normalized_query, string_agg(distinct c, '|' order by c) as categories from (select normalized_query, unnest(categories) as c from queries) t group by 1",
    "naive_work": f"with {CORPUS}, {ASKED}, l as (select query_id, m + d as l from q, (select unnest([-1, 0, 1]) as d) v where m + d > 0) select query_id, cast(sum(greatest(0, length(n) - l + 1)) as bigint) as verifier_calls from l join s on true group by query_id",
    "work_summary": f"""with x as (select run_no, 'frequency' as metric, frequency as value from seed_candidates union all select run_no, 'width', query_end - query_start from seed_candidates)
select run_no, metric, avg(value) as mean, median(value) as median, {_disc('value', 95)} as p95, max(value) as max from x group by all""",
    "worst_queries": f"with {_MEDIANS} select * from (select *, cast(row_number() over (partition by algorithm_id order by median desc, query_id) as int) as rank from m) t where rank <= 25",
    "best_queries": f"with {_MEDIANS} select * from (select *, cast(row_number() over (partition by algorithm_id order by median, query_id) as int) as rank from m) t where rank <= 20",
    "stratified_order": f"with {_STRATA} select sentence_id, turn, source_draw from t",
    "stratified_slice": f"with {_STRATA} select sentence_id, source_path from t order by turn, source_draw, sentence_id limit (select cast(ceil(count(*) * 0.1) as bigint) from t)",
    "prefix_slice": "select sentence_id, source_path from prepared_sentences order by sentence_id limit (select cast(ceil(count(*) * 0.25) as bigint) from prepared_sentences)",
    "even_slice": """with r as (select sentence_id, source_path, row_number() over (order by sentence_id) - 1 as p, count(*) over () as n from prepared_sentences)
select sentence_id, source_path from r where p in (select cast(round_even(i * (n - 1) / 99.0, 0) as bigint) from (select max(n) as n from r) z, unnest(generate_series(0, 99)) u(i))""",
    "frequency_probes": f"""with {CORPUS}, {GRAMS}, {_FREQ}, h as (select gram, frequency from f where gram_size = 3),
b as ({" union all ".join(f"select 'p{p}' as frequency_band, {_disc('frequency', p)} as frequency from h" for p in (50, 75, 90, 95, 99))} union all select 'rare', min(frequency) from h)
select frequency_band, b.frequency, min(gram) as gram from b join h on h.frequency = b.frequency group by all""",
    "execution_subset": "select category, min(query_id) as query_id from (select query_id, unnest(categories) as category from queries where query_length >= 6) t group by category",
}
