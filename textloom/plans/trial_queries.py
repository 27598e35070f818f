"""Workloads of real text and evaluation runs over the prepared sentences; with their SQL. Times are measured, but not part of these results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import sampled, trials, workload
from textloom.plans.search_queries import ASKED_EVERY, asked, sentences
from textloom.plans.search_sql import ASKED, CORPUS, FOUND, GRAMS, PAIRS, SEARCH, SEEDS, SQL as SEARCH_SQL, VOCABULARY, WORDS
from textloom.session import table

#: Occurrences that a plan may predict before the length study leaves it out; the bound of published runs.
GUARD = 500_000
PER_LENGTH, FILL = 40, 32


def _about(spark: SparkSession, folder: str) -> DataFrame:
    """The asked queries with their text and categories."""
    columns = ["query_id", "query_text", F.col("normalized_query").alias("q"), "primary_category", "categories"]
    saved, generated = (table(spark, folder, t).select(*columns) for t in ("saved_queries", "queries"))
    number = F.regexp_extract("query_id", r"(\d+)$", 1).try_cast("long")
    rows = saved.unionByName(generated.where(number % ASKED_EVERY == 0).dropDuplicates(["query_id"]))
    return rows.where(F.length("q") > 0)


def _searched(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).where(F.length("q") > 0)


def short_workload(spark, folder):
    return sampled.short_workload(sentences(spark, folder), PER_LENGTH)


def real_workload(spark, folder):
    return sampled.real_workload(sentences(spark, folder), FILL)


def first_by_source(spark, folder):
    rows = table(spark, folder, "prepared_sentences").where(F.col("normalized_text").isNotNull()).select("sentence_id", "source_path")
    return sampled.by_source(rows, "source_path", "sentence_id")


def trial_correctness(spark, folder):
    """All four strategies over the asked queries, each compared with the exhaustive scan."""
    return trials.run_search_phase(_searched(spark, folder), sentences(spark, folder)).correctness


def trial_by_result_bucket(spark, folder):
    """Queries and wrong answers of each strategy by how many results a query has."""
    rows = trial_correctness(spark, folder)
    return rows.groupBy("algorithm_id", tx.short_result_bucket(F.col("result_count")).alias("result_bucket")).agg(F.count(F.lit(1)).alias("queries"), F.sum((~F.col("correct")).cast("long")).alias("wrong"))


def trial_work(spark, folder):
    return trials.work(_searched(spark, folder), sentences(spark, folder))


def work_rates(spark, folder):
    return trials.work_rates(trial_work(spark, folder))


def per_query_report(spark, folder):
    """The per-query report without its seven columns of time."""
    q, s = _about(spark, folder), sentences(spark, folder)
    phase = trials.run_search_phase(q.select("query_id", "q"), s)
    return trials.per_query_report(phase, q, trials.work(q, s)).drop("min_ms", "median_ms", "mean_ms", "max_ms", "p95_ms", "speedup_vs_naive", "tree_nodes_visited")


def mismatch_classes(spark, folder):
    return trials.mismatch_classes(trial_correctness(spark, folder), _about(spark, folder))


def trial_scorecard(spark, folder):
    """What of the scorecard isn't time."""
    phase = trials.run_search_phase(_searched(spark, folder), sentences(spark, folder))
    return trials.scorecard(phase.correctness, phase.timing, _about(spark, folder)).select("algorithm_id", "correct", "false_negatives", "false_positives")


def length_study(spark, folder):
    return trials.length_study(_searched(spark, folder), sentences(spark, folder), expansion_guard=GUARD).drop("latency_ns")


def index_configurations(spark, folder):
    return trials.index_configurations(sentences(spark, folder))


def _subset(spark: SparkSession, folder: str) -> DataFrame:
    """The study's queries: the first of each category with six or more characters (`workload.execution_subset`), of all asked ones."""
    about = _about(spark, folder).withColumn("query_length", F.length("q"))
    return about.join(workload.execution_subset(about).select("query_id").distinct(), "query_id", "left_semi").select("query_id", "q")


def parameter_study(spark, folder):
    return trials.parameter_study(_subset(spark, folder), sentences(spark, folder)).drop("run_ns")


def scaling_study(spark, folder):
    return trials.scaling_study(_subset(spark, folder), sentences(spark, folder)).drop("run_ns")


QUERIES = {
    f.__name__: f
    for f in (
        short_workload, real_workload, first_by_source, trial_correctness, trial_by_result_bucket, trial_work, work_rates, per_query_report, mismatch_classes, trial_scorecard, length_study, index_configurations,
        parameter_study, scaling_study,
    )
}

_WORD_TABLE = "d as (select word, count(*) as n, min(sentence_id) as sentence_id, arg_min(start_pos, (sentence_id, start_pos)) as start_pos from w where word <> '' group by word)"
_DRAW = f"md5('{workload.SEED}:' || {{0}})"


def _pick(source: str, where: str, salt: str, n: int, key: str = "word") -> str:
    return f"(select * from {source} where {where} order by {_DRAW.format(f'{chr(39)}{salt}:{chr(39)} || {key}')}, {key} limit {n})"


def _draft(source: str, q: str, tags: str, mutation: str = "exact", start: str = "start_pos") -> str:
    tag_list = ", ".join(f"'{t}'" for t in tags.split())
    return f"select {q} as q, [{tag_list}] as tags, '{mutation}' as mutation, sentence_id as source_sentence_id, cast({start} as int) as expected_start from {source}"


def _merge(drafts: list[str], key: str = "") -> str:
    union = " union all ".join(drafts)
    return f"""select {key}q, string_agg(distinct tag, '|' order by tag) as tags, min(mutation) as mutation,
  arg_min(source_sentence_id, s) as source_sentence_id, arg_min(expected_start, s) as expected_start
from (select *, unnest(tags) as tag, (mutation, coalesce(source_sentence_id, -1), coalesce(expected_start, -1)) as s from ({union}) u where trim(q) <> '') v group by q"""


def _short(size: int) -> str:
    g = f"g{size}"
    crosses, inner = "contains(substring(word, 2), ' ')", f"cast((length(word) - {size}) // 2 as int)"
    drafts = []
    for tag, order in (("common_seed", "n desc, word"), ("rare_seed", "n, word desc")):
        top = f"(select * from {g} order by {order} limit 3)"
        drafts += [_draft(f"{top} t where {crosses}", "word", f"{tag} exact cross_word"), _draft(f"{top} t where not {crosses}", "word", f"{tag} exact inside_word")]
    drafts.append(_draft(_pick("d", f"length(word) >= {size}", f"inside{size}", PER_LENGTH // 3) + " t", f"substring(word, {inner} + 1, {size})", "exact inside_word", start=f"start_pos + {inner}"))
    drafts.append(_draft(_pick(g, crosses, f"cross{size}", max(2, PER_LENGTH // 6)) + " t", "word", "exact cross_word"))
    mutable = _pick("d", f"length(word) > {size}", f"mutate{size}", PER_LENGTH // 6) + " t"
    drafts.append(_draft(mutable, f"case when left(word, 1) = 'q' then 'w' else 'q' end || substring(word, 2, {size - 1})", "replacement inside_word", "replacement"))
    if size > 1:
        drafts.append(_draft(mutable, f"left(word, {size - 1}) || substring(word, {size + 1}, 1)", "insertion inside_word", "missing_character"))
    drafts.append(_draft(mutable, f"left(word, {size - 1}) || 'q'", "deletion inside_word", "extra_character"))
    letters = sampled.UNUSUAL
    tried = list(dict.fromkeys([c * size for c in letters] + [((a + b) * size)[:size] for a in letters for b in letters]))
    values = ", ".join(f"('{t}', {i})" for i, t in enumerate(tried))
    nowhere = f"(select t as word, null::bigint as sentence_id, null::int as start_pos from (values {values}) c(t, i) where t not in (select word from {g}) order by i limit 1) t"
    drafts.append(_draft(nowhere, "word", "no_match", "near_miss"))
    return f"select {size} as length, * from ({_merge(drafts)}) m"


_SHORT = f"""with {CORPUS}, {WORDS}, {_WORD_TABLE},
{", ".join(f"g{k} as (select substring(n, i + 1, {k}) as word, count(*) as n, min(sentence_id) as sentence_id, cast(arg_min(i, (sentence_id, i)) as int) as start_pos from s, unnest(generate_series(0, length(n) - {k})) u(i) where length(n) >= {k} group by 1)" for k in sampled.LENGTHS)}
{" union all ".join(map(_short, sampled.LENGTHS))}"""


def _real() -> str:
    rows = "(select *, cast(sentence_id as varchar) as id, 0 as start_pos from s)"
    longer = lambda n: f"length(word) >= {n}"
    drafts = [_draft(_pick("d", longer(n), f"short{n}", 1) + " t", f"left(word, {n})", "short_exact inside_word") for n in range(1, 6)]
    drafts.append(_draft(_pick("d", "length(word) between 6 and 15", "medium", 1) + " t", "word", "medium_exact inside_word"))
    drafts.append(_draft(_pick(rows, "length(n) >= 16", "long", 1, "id") + " t", "trim(left(n, 24))", "long_exact"))
    drafts.append(_draft(_pick("d", longer(8), "inside", 1) + " t", "substring(word, 3, 5)", "inside_word", start="start_pos + 2"))
    begin = "greatest(1, strpos(n, ' ') - 3)"
    drafts.append(_draft(_pick(rows, "strpos(n, ' ') > 0", "cross", 1, "id") + " t", f"substring(n, {begin}, strpos(n, ' ') + 4 - {begin})", "cross_word", start=f"{begin} - 1"))
    mutable = _pick("d", longer(7), "mutate", 1) + " t"
    drafts.append(_draft(mutable, "left(word, 2) || case when substring(word, 3, 1) = 'x' then 'z' else 'x' end || substring(word, 4)", "replacement inside_word", "replacement"))
    drafts.append(_draft(mutable, "left(word, 3) || substring(word, 5)", "insertion inside_word", "missing_character"))
    drafts.append(_draft(mutable, "left(word, 3) || 'x' || substring(word, 4)", "deletion inside_word", "extra_character"))
    drafts.append(_draft(_pick("d", "len(list_distinct(string_split(word, ''))) < length(word)", "repeated", 1) + " t", "word", "repeated inside_word"))
    chosen = {"common_qgram": "select gram from h order by n desc, gram desc limit 1", "rare_qgram": "select gram from h order by n, gram limit 1", "medium_qgram": "select min(gram) from h where n = (select percentile_disc(0.5) within group (order by n) from h)"}
    drafts += [_draft(_pick("d", f"length(word) >= 6 and contains(word, ({gram}))", tag, 1) + " t", "word", f"{tag} inside_word") for tag, gram in chosen.items()]
    nowhere = f"(select '{sampled.NOWHERE}' || repeat('z', coalesce(max(length(z)) + 1, 0)) as word, null::bigint as sentence_id, null::int as start_pos from (select unnest(regexp_extract_all(n, '{sampled.NOWHERE}(z*)', 1)) as z from s) y) t"
    drafts.append(_draft(nowhere, "word", "no_match", "near_miss"))
    edge = _pick(rows, "length(n) >= 8", "edge", 1, "id") + " t"
    drafts += [_draft(edge, "trim(left(n, 8))", "near_boundary"), _draft(edge, "trim(right(n, 8))", "near_boundary", start="length(n) - 8")]
    drafts.append(_draft("(select * from d where length(word) >= 6 order by n desc, word desc limit 1) t", "word", "multiple_matches high_frequency inside_word"))
    fill = _pick("d", longer(2), "fill", FILL)
    drafts += [_draft(f"{fill} t where length(word) <= 15", "word", "medium_exact inside_word"), _draft(f"{fill} t where length(word) > 15", "word", "long_exact inside_word")]
    grams = "h as (select substring(word, i, 3) as gram, cast(sum(n) as bigint) as n from d, unnest(generate_series(1, length(word) - 2)) u(i) where length(word) >= 6 group by 1)"
    return f"with {CORPUS}, {WORDS}, {_WORD_TABLE}, {grams} {_merge(drafts)}"


_COMPARED = f"""o as (with {SEARCH} {FOUND}), a as ({SEARCH_SQL['search_hybrid']}),
t as (select *, 1 as o, 0 as a from o union all select *, 0, 1 from a),
k as (select query_id, sum(o) as o, sum(a) as a from t group by query_id, sentence_id, match_start, edit_type, edit_index, correct_characters),
x as (select query_id, cast(sum(o) as bigint) as n_o, cast(sum(a) as bigint) as n_a, cast(sum(greatest(0, o - a)) as bigint) as fn, cast(sum(greatest(0, a - o)) as bigint) as fp from k group by query_id),
b as (select q.query_id, algorithm_id, coalesce(n_o, 0) as n_o, coalesce(n_a, 0) as n_a, case when algorithm_id = 'hybrid' then coalesce(fn, 0) else 0 end as fn, case when algorithm_id = 'hybrid' then coalesce(fp, 0) else 0 end as fp
  from q, (select unnest(['naive', 'qgram', 'hybrid', 'bi_anchor']) as algorithm_id) l left join x on x.query_id = q.query_id),
c as (select query_id, algorithm_id, cast(case when algorithm_id = 'hybrid' then n_a else n_o end as bigint) as result_count, fn + fp = 0 as correct,
  case when algorithm_id = 'naive' then 'oracle' when fn + fp = 0 then 'raw_results_match' else 'raw_result_mismatch' end as status, cast(fn as bigint) as false_negatives, cast(fp as bigint) as false_positives from b)"""
_CORRECT = f"with {ASKED}, {_COMPARED}"
_WORK = f"""
wk_l as (select query_id, m + y as l from q, (select unnest([-1, 0, 1]) as y) z where m + y > 0),
wk_n as (select query_id, cast(sum(greatest(0, length(n) - l + 1)) as bigint) as calls from wk_l, s group by query_id),
wk_a as (select query_id, gram_size, first_gram as gram, first_start as o from plan union all select query_id, gram_size, second_gram, second_start from plan),
wk_d as (select distinct a.query_id, m, sentence_id, position - a.o + x as match_start from wk_a a join q on q.query_id = a.query_id join g on g.gram_size = a.gram_size and g.gram = a.gram, (select unnest([-1, 0, 1]) as x) v),
wk_s as (select query_id, d.sentence_id, match_start, m + y as l from wk_d d join s on s.sentence_id = d.sentence_id, (select unnest([-1, 0, 1]) as y) z where m + y > 0 and match_start >= 0 and match_start + m + y <= length(n)),
wk_c as (select query_id, count(distinct (sentence_id, match_start)) as candidates, count(*) as calls from wk_s group by query_id),
wk_q as (select query_id, cast(sum(frequency) as bigint) as postings from seeds where m >= 2 * case when m <= 3 then 1 when m <= 5 then 2 else 3 end and gram_size = case when m <= 3 then 1 when m <= 5 then 2 else 3 end group by query_id),
wk_h as (select query_id, count(*) as candidates from cand group by query_id),
wk as (
  select q.query_id, 'naive' as algorithm_id, false as fallback, null::bigint as candidate_count, calls as verifier_calls, null::bigint as posting_count, null::varchar as seed_a, null::varchar as seed_b, null::bigint as frequency_a, null::bigint as frequency_b from q join wk_n using (query_id)
  union all
  select q.query_id, 'qgram', m < 2 * case when m <= 3 then 1 when m <= 5 then 2 else 3 end, null, case when m < 2 * case when m <= 3 then 1 when m <= 5 then 2 else 3 end then calls end, postings, null, null, null, null from q join wk_n using (query_id) left join wk_q using (query_id)
  union all
  select q.query_id, 'hybrid', false, coalesce(candidates, 0), null, null, null, null, null, null from q left join wk_h using (query_id)
  union all
  select q.query_id, 'bi_anchor', cost is null, case when cost is not null then coalesce(candidates, 0) end, case when cost is null then wk_n.calls else coalesce(wk_c.calls, 0) end, cost, first_gram, second_gram, fa.frequency, fb.frequency
  from q join wk_n using (query_id) left join plan p using (query_id) left join wk_c using (query_id)
    left join seeds fa on fa.query_id = p.query_id and fa.gram_size = p.gram_size and fa.query_start = first_start left join seeds fb on fb.query_id = p.query_id and fb.gram_size = p.gram_size and fb.query_start = second_start
)"""
_WORKED = f"with {CORPUS}, {ASKED}, {GRAMS}, {SEEDS}, {PAIRS}, {WORDS}, {VOCABULARY}, {{cand}}, {_WORK}"
_ABOUT = "ab as (select query_id, query_text, normalized_query as q, primary_category, categories from saved_queries union all select query_id, min(query_text), min(normalized_query), min(primary_category), min(categories) from queries where cast(regexp_extract(query_id, '[0-9]+$') as bigint) % 50 = 0 group by query_id)"


def _candidates() -> str:
    from textloom.plans.search_sql import CANDIDATES

    return CANDIDATES.strip()


_CARD = "select algorithm_id, bool_and(correct) as correct, cast(sum(false_negatives) as bigint) as false_negatives, cast(sum(false_positives) as bigint) as false_positives from c group by algorithm_id"
_SUBSET = f"{_ABOUT}, sub as (select min(query_id) as query_id from (select query_id, unnest(categories) as c from ab where length(q) >= 6) t group by c)"
_STUDIED = SEARCH.replace(ASKED, f"{_SUBSET}, q as (select query_id, q, cast(length(q) as int) as m from ab where query_id in (select query_id from sub))")

def _parameter(q: int) -> str:
    """The hybrid of gram size q against all matches; the other strategies equal these."""
    hybrid = SEARCH_SQL["search_hybrid"].replace(", 3) as gram", f", {q}) as gram").replace("length(word) - 3", f"length(word) - {q}").replace("m - 3", f"m - {q}")
    hybrid = hybrid.replace(ASKED, f"{_SUBSET}, q as (select query_id, q, cast(length(q) as int) as m from ab where query_id in (select query_id from sub))")
    return f"""select {q} as q, algorithm_id, cast(case when algorithm_id = 'hybrid' then n_a else n_o end as bigint) as results, cast(case when algorithm_id = 'hybrid' then fn else 0 end as bigint) as false_negatives,
  cast(case when algorithm_id = 'hybrid' then fp else 0 end as bigint) as false_positives
from (select sum(o) as n_o, sum(a) as n_a, sum(greatest(0, o - a)) as fn, sum(greatest(0, a - o)) as fp from (select sum(o) as o, sum(a) as a from (select *, 1 as o, 0 as a from o union all select *, 0, 1 from ({hybrid}) h) t
  group by query_id, sentence_id, match_start, edit_type, edit_index, correct_characters) k) x, (select unnest(['qgram', 'hybrid', 'bi_anchor']) as algorithm_id) l"""


SQL = {
    "parameter_study": f"with o as (with {_STUDIED} {FOUND}) " + " union all ".join(map(_parameter, (2, 3, 4))),
    "short_workload": _SHORT,
    "real_workload": _real(),
    "first_by_source": "select source_path, min(sentence_id) as sentence_id from prepared_sentences where normalized_text is not null group by source_path",
    "trial_correctness": f"{_CORRECT} select * from c",
    "trial_by_result_bucket": f"""{_CORRECT} select algorithm_id, case when result_count = 0 then '0' when result_count <= 5 then '1-5' when result_count <= 20 then '6-20' when result_count <= 100 then '21-100' else '100+' end as result_bucket,
count(*) as queries, cast(sum(case when correct then 0 else 1 end) as bigint) as wrong from c group by all""",
    "trial_work": f"{_WORKED.format(cand=_candidates())} select * from wk",
    "work_rates": f"""{_WORKED.format(cand=_candidates())} select a.algorithm_id, count(*) as queries, avg(case when a.fallback then 1 else 0 end) as fallback_rate, avg((a.frequency_a + a.frequency_b) / 2) as mean_seed_frequency,
1 - sum(a.verifier_calls) / cast(sum(case when a.verifier_calls is not null then b.verifier_calls end) as double) as saved from wk a join wk b on b.query_id = a.query_id and b.algorithm_id = 'naive' group by 1""",
    "mismatch_classes": f"""{_CORRECT}, {_ABOUT} select c.query_id, algorithm_id, case when length(ab.q) < 3 then 'short query' when list_contains(categories, 'cross_word') then 'across words'
when list_contains(categories, 'repeated_characters') or list_contains(categories, 'repeated') then 'repeated characters' when false_negatives > 0 and false_positives = 0 then 'missed candidates' when false_positives > 0 and false_negatives = 0 then 'other reading of the edit' else 'other' end as mismatch
from c join ab using (query_id) where not correct""",
    "trial_scorecard": f"{_CORRECT} {_CARD}",
    "length_study": f"""with {CORPUS}, {ASKED.replace("q <> ''", "q <> '' and length(q) <= 6")}, {GRAMS}, {SEEDS}, {PAIRS},
r as (select unnest(['q1', 'q2', 'q3', 'adaptive']) as runtime),
p as (select query_id, 'q' || gram_size as runtime, gram_size, cost from best_pair union all select query_id, 'adaptive', gram_size, cost from plan),
f as (with {SEARCH} select query_id, count(*) as n from e group by 1)
select q.query_id, m as length, r.runtime, gram_size as selected_q, cost as predicted_expansion, case when cost is null then 'naive_fallback' when cost > {GUARD} then 'guarded' else 'executed' end as status,
case when cost <= {GUARD} then coalesce(n, 0) end as result_count from q join r on true left join p on p.query_id = q.query_id and p.runtime = r.runtime left join f on f.query_id = q.query_id""",
    "index_configurations": f"""with {CORPUS}, {WORDS}, {GRAMS}, v as (select word, count(*) as n from w where word <> '' group by word),
i as (select gram_size, count(distinct gram) as ks, count(*) as refs from (select word, cast(k as int) as gram_size, substring(word, i + 1, k) as gram from v, (select unnest([1, 2, 3]) as k) z, unnest(generate_series(0, length(word) - k)) u(i) where length(word) >= k) x group by 1),
o as (select gram_size, count(distinct gram) as ks, count(*) as n from g where contains(gram, ' ') group by 1),
c as (select * from (values ('3', 3), ('2,3', 2), ('2,3', 3), ('1,2,3', 1), ('1,2,3', 2), ('1,2,3', 3)) t(configuration, gram_size))
select configuration, c.gram_size, (select count(*) from v) as unique_words, (select cast(sum(n) as bigint) from v) as word_occurrences, coalesce(i.ks, 0) as intra_word_seed_keys, coalesce(refs, 0) as intra_word_seed_references, coalesce(o.ks, 0) as boundary_seed_keys, coalesce(o.n, 0) as boundary_occurrences
from c left join i on i.gram_size = c.gram_size left join o on o.gram_size = c.gram_size""",
    "scaling_study": f"""with o as (with {_STUDIED} {FOUND}), n as (select sentence_id, row_number() over (order by sentence_id) as r, count(*) over () as n from prepared_sentences),
p as (select unnest([10, 25, 50, 75, 100]) as percent), k as (select percent, sentence_id from n, p where r <= ceil(n * percent / 100.0))
select percent, (select count(*) from k b where b.percent = k.percent) as sentences, algorithm_id, (select count(*) from o join k b on b.sentence_id = o.sentence_id where b.percent = k.percent) as results
from k, (select unnest(['naive', 'bi_anchor']) as algorithm_id) a group by percent, algorithm_id""",
}
