"""SQL of the search queries. Written for an engine with unnest, generate_series and lateral joins."""

from __future__ import annotations

CORPUS = "s as (select sentence_id, normalized_text as n from prepared_sentences where normalized_text is not null and normalized_text <> '')"
_ASKED = "select distinct query_id, {0} as q from saved_queries union select distinct query_id, {0} from queries where cast(regexp_extract(query_id, '[0-9]+$') as bigint) % 50 = 0"
ASKED = f"q as (select query_id, q, cast(length(q) as int) as m from ({_ASKED.format('normalized_query')}) a where q <> '')"
WORKLOAD = "q as (select distinct query_id, normalized_query as q, cast(length(normalized_query) as int) as m from queries where normalized_query <> '')"

#: Matches of (q, t) pairs in `c`, whose other columns are KEYS.
EDITS = """
e as (
  select {keys}, 'exact' as edit_type, cast(null as int) as edit_index, m as correct_characters from c where t = q
  union all
  select {keys}, 'replacement', cast(i as int), m - 1 from c, unnest(generate_series(0, m - 1)) u(i) where length(t) = m and t <> q and left(t, i) = left(q, i) and substring(t, i + 2) = substring(q, i + 2)
  union all
  select {keys}, 'insertion', cast(i as int), m from c, unnest(generate_series(0, m)) u(i) where length(t) = m + 1 and left(t, i) || substring(t, i + 2) = q
  union all
  select {keys}, 'deletion', cast(i as int), m - 1 from c, unnest(generate_series(0, m - 1)) u(i) where length(t) = m - 1 and t <> '' and left(q, i) || substring(q, i + 2) = t
)"""

SEARCH = f"""
{CORPUS}, {ASKED},
pair as (select query_id, q, m, m // 2 as h, sentence_id, n from s join q on m < 2 or contains(n, left(q, m // 2)) or contains(n, substring(q, m // 2 + 1))),
p as (select query_id, q, m, h, sentence_id, cast(i as int) as match_start, substring(n, i + 1, m + 1) as w from pair, unnest(generate_series(0, length(n) - 1)) u(i)),
f as (select * from p where m < 2 or left(w, h) = left(q, h) or substring(w, h + 1, m - h) = substring(q, h + 1) or substring(w, h + 2, m - h) = substring(q, h + 1) or (h > 0 and substring(w, h, m - h) = substring(q, h + 1))),
c as (select query_id, q, m, sentence_id, match_start, left(w, l) as t from f, (select unnest([-1, 0, 1]) as d) v, lateral (select m + d as l) x where l > 0 and length(w) >= l),
{EDITS.format(keys="query_id, sentence_id, match_start")}
"""

ENTRIES = f"""
w0 as (select distinct query_id, normalized_query as q, source_sentence_id, source_start from queries),
c as (
  select query_id, q, cast(length(q) as int) as m, substring(normalized_text, source_start + 1, l) as t
  from w0 join prepared_sentences on source_sentence_id = sentence_id, (select unnest([-1, 0, 1]) as d) v, lateral (select length(q) + d as l) x
  where l > 0 and length(q) > 0 and source_start + l <= length(normalized_text)
),
{EDITS.format(keys="query_id, t")}
"""

SCORE = "cast(2 * correct_characters + case edit_type when 'exact' then 0 when 'replacement' then least(edit_index, 4) - 5 else 2 * least(edit_index, 4) - 10 end as int)"

GRAMS = """
g as (
  select cast(k as int) as gram_size, substring(n, i + 1, k) as gram, sentence_id, cast(i as int) as position
  from s, (select unnest([1, 2, 3]) as k) v, unnest(generate_series(0, length(n) - k)) u(i) where length(n) >= k
)"""
WORDS = """
w as (select word, sentence_id, cast(sum(length(word) + 1) over (partition by sentence_id order by i rows unbounded preceding) - length(word) - 1 as int) as start_pos
  from (select sentence_id, unnest(string_split(n, ' ')) as word, generate_subscripts(string_split(n, ' '), 1) as i from s))"""
SEEDS = """
seeds as (
  select query_id, m, x.gram_size, x.gram, x.query_start, cast(coalesce(frequency, 0) as bigint) as frequency
  from (select query_id, m, cast(k as int) as gram_size, substring(q, i + 1, k) as gram, cast(i as int) as query_start from q, (select unnest([1, 2, 3]) as k) v, unnest(generate_series(0, m - k)) u(i) where m >= k) x
  left join (select gram_size, gram, count(*) as frequency from g group by all) f on f.gram_size = x.gram_size and f.gram = x.gram
)"""
PAIRS = """
pairs as (
  select a.query_id, a.gram_size, a.gram as first_gram, a.query_start as first_start, b.gram as second_gram, b.query_start as second_start, a.frequency + b.frequency as cost
  from seeds a join seeds b on a.query_id = b.query_id and a.gram_size = b.gram_size and a.query_start + a.gram_size <= b.query_start
),
best_pair as (select * from pairs qualify row_number() over (partition by query_id, gram_size order by cost, first_start, second_start) = 1),
plan as (select * from best_pair qualify row_number() over (partition by query_id order by cost, gram_size desc) = 1)"""
VOCABULARY = "v as (select distinct word from w where word <> '')"
CANDIDATES = """
cand as (
  select query_id, q, m, word from v join q on m <= 4 and length(word) <= 4 and abs(length(word) - m) <= 1
  union all
  select distinct query_id, q, m, word from
    (select word, substring(word, i + 1, 3) as gram from v, unnest(generate_series(0, length(word) - 3)) u(i) where length(word) > 4) a
    join (select query_id, q, m, substring(q, i + 1, 3) as gram from q, unnest(generate_series(0, m - 3)) u(i) where m > 4) b on a.gram = b.gram
)"""
FOUND = "select query_id, sentence_id, match_start, edit_type, edit_index, correct_characters from e"
BEST = f"""
best as (
  select query_id, original_text as completed_sentence, source_path as source_text, line_no, max({SCORE}) as score, min(e.sentence_id) as sentence_id
  from e join prepared_sentences p on p.sentence_id = e.sentence_id group by all
)"""


def _top(source: str) -> str:
    return f"""select query_id, completed_sentence, source_text, line_no, score, rank from (
  select *, cast(row_number() over (partition by query_id order by score desc, completed_sentence nulls first, sentence_id) as int) as rank from {source}) r where rank <= 5"""


SQL = {
    **{f"match_{k}": f"with {ENTRIES} select query_id, t, edit_type, edit_index, correct_characters from e where edit_type = '{k}'" for k in ("exact", "replacement", "insertion", "deletion")},
    "search_naive": f"with {SEARCH} {FOUND}",
    "search_qgram": f"with {SEARCH} {FOUND}",
    "search_bi_anchor": f"with {SEARCH} {FOUND}",
    "search_indexed": f"with {SEARCH} {FOUND}",
    "index_qgram": f"with {CORPUS}, {GRAMS} select gram_size, gram, count(*) as entries, count(distinct sentence_id) as n_sentences from g group by all",
    "query_seeds": f"with {CORPUS}, {WORKLOAD}, {GRAMS}, {SEEDS} select query_id, gram_size, gram, query_start, frequency from seeds",
    "anchor_pair": f"with {CORPUS}, {WORKLOAD}, {GRAMS}, {SEEDS}, {PAIRS} select query_id, gram_size, first_gram, first_start, second_gram, second_start, cost from best_pair",
    "anchor_plan": f"with {CORPUS}, {WORKLOAD}, {GRAMS}, {SEEDS}, {PAIRS} select query_id, gram_size, first_gram, first_start, second_gram, second_start, cost from plan",
    "contexts": f"""with {CORPUS}, {ASKED}, {GRAMS}, {SEEDS}, {PAIRS},
a as (select query_id, gram_size, first_gram as gram, first_start as o from plan union all select query_id, gram_size, second_gram, second_start from plan),
d as (select distinct a.query_id, m, sentence_id, position - a.o + x as match_start from a join q on q.query_id = a.query_id join g on g.gram_size = a.gram_size and g.gram = a.gram, (select unnest([-1, 0, 1]) as x) v)
select query_id, d.sentence_id, cast(match_start as int) as match_start, cast(m + y as int) as target_length from d join s on s.sentence_id = d.sentence_id, (select unnest([-1, 0, 1]) as y) z
where m + y > 0 and match_start >= 0 and match_start + m + y <= length(n)""",
    "word_table": f"with {CORPUS}, {WORDS} select word, count(*) as occurrences, count(distinct sentence_id) as n_sentences from w group by word",
    "seed_frequency": f"with {CORPUS}, {GRAMS} select gram_size, gram, count(*) as frequency from g group by all",
    "seed_index": f"with {CORPUS}, {GRAMS} select gram_size, gram, count(*) as frequency, contains(gram, ' ') as is_boundary from g group by all",
    "indexed_seeds": f"with {CORPUS}, {GRAMS} select distinct gram from g where gram_size = 3",
    "seed_occurrences": f"""with {CORPUS}, t as (select distinct cast(length(text) as int) as gram_size, text as gram from seed_candidates where length(text) > 0),
k as (select distinct gram_size from t), p as (select gram_size, substring(n, i + 1, gram_size) as gram, i from s, k, unnest(generate_series(0, length(n) - gram_size)) u(i) where length(n) >= gram_size)
select t.gram_size, t.gram, count(*) as occurrences, cast(sum(i) as bigint) as position_sum from p join t on t.gram = p.gram group by all""",
    "index_hybrid": f"with {CORPUS}, {WORDS}, {VOCABULARY} select substring(word, i + 1, 3) as gram, count(distinct word) as n_words from v, unnest(generate_series(0, length(word) - 3)) u(i) where length(word) > 4 group by all",
    "hybrid_candidates": f"with {CORPUS}, {ASKED}, {WORDS}, {VOCABULARY}, {CANDIDATES} select query_id, word from cand",
    "search_hybrid": f"""with {CORPUS}, {ASKED}, {WORDS}, {VOCABULARY}, {CANDIDATES},
c as (select query_id, q, m, word, left(word, l) as t from cand, (select unnest([-1, 0, 1]) as d) z, lateral (select m + d as l) x where l > 0 and length(word) >= l),
{EDITS.format(keys="query_id, word")},
f as (select query_id, word, edit_type, min(edit_index) as edit_index, min(correct_characters) as correct_characters from e group by all),
r as (select query_id, sentence_id, start_pos as match_start, edit_type, edit_index, correct_characters,
  row_number() over (partition by query_id order by case edit_type when 'exact' then 0 when 'replacement' then 1 when 'insertion' then 2 else 3 end, f.word, sentence_id, start_pos) as r from f join w on w.word = f.word)
select query_id, sentence_id, match_start, edit_type, edit_index, correct_characters from r where r <= 2000""",
    "qgram_votes": f"""with {CORPUS}, {ASKED}, {GRAMS},
y as (select query_id, substring(q, i + 1, 3) as gram, i from q, unnest(generate_series(0, m - 3)) u(i) where m >= 3)
select query_id, sentence_id, count(distinct i) as votes from y join g on gram_size = 3 and g.gram = y.gram and abs(position - i) <= 1 group by all""",
    "vote_select": f"""with {CORPUS}, {ASKED}, {GRAMS},
y as (select query_id, m, substring(q, i + 1, 3) as gram, i from q, unnest(generate_series(0, m - 3)) u(i) where m >= 3)
select query_id, sentence_id from (select query_id, m, sentence_id, count(distinct i) as votes from y join g on gram_size = 3 and g.gram = y.gram and abs(position - i) <= 1 group by all) x where m < 3 or votes >= greatest(1, m - 5)""",
    "score": f"with {ENTRIES} select query_id, t, edit_type, edit_index, {SCORE} as score from e",
    "best_per_record": f"with {SEARCH}, {BEST} select query_id, completed_sentence, source_text, line_no, score, sentence_id from best",
    "complete": f"with {SEARCH}, {BEST} {_top('best')}",
    "raw_candidates": f"with {SEARCH} select query_id, edit_type, count(*) as matches, count(distinct sentence_id) as n_sentences from e group by all",
    "search_pinned": "with " + SEARCH.replace("from prepared_sentences", "from pinned_sentences") + " " + FOUND,
    "top_k": f"""with best as (select query_id, completed_sentence, source_text, line_no, max(score) as score, min(completion_id) as sentence_id from completions where query_id is not null and score is not null group by all) {_top('best')}""",
}
