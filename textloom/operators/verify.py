"""The one-edit verifier: which corrections turn a slice of a sentence into a query.

A slice may have the query's length (exact, or one replacement), one character more (the query lacks it: insertion) or
one less (the query has it too many: deletion). Every valid slot or index gives a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "struct<edit_type:string,edit_index:int,correct_characters:int>"


def _match(kind: str, index: Column | None, correct: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("edit_type"), (F.lit(None) if index is None else index).cast("int").alias("edit_index"), correct.cast("int").alias("correct_characters")
    )


def _without(text: Column, i: Column) -> Column:
    return F.concat(F.left(text, i), F.substring(text, i + 2, F.length(text)))


def _all(kind: str, indexes: Column, correct: Column) -> Column:
    return F.transform(indexes, lambda i: _match(kind, i, correct))


def _none() -> Column:
    return F.array().cast(f"array<{MATCH}>")


def equal_length(q: Column, t: Column) -> Column:
    """Exact, else the one replacement, for a slice of the query's length."""
    m = F.length(q)
    swapped = F.filter(F.sequence(F.lit(0), m - 1), lambda i: (F.left(q, i) == F.left(t, i)) & (F.substring(q, i + 2, m) == F.substring(t, i + 2, m)))
    return F.when(q == t, F.array(_match("exact", None, m))).otherwise(_all("replacement", swapped, m - 1))


def one_longer(q: Column, t: Column) -> Column:
    """Every slot of an insertion, for a slice with one character more."""
    m = F.length(q)
    return _all("insertion", F.filter(F.sequence(F.lit(0), m), lambda i: _without(t, i) == q), m)


def one_shorter(q: Column, t: Column) -> Column:
    """Every index of a deletion, for a slice with one character less."""
    m = F.length(q)
    return _all("deletion", F.filter(F.sequence(F.lit(0), m - 1), lambda i: _without(q, i) == t), m - 1)


def compare(q: Column, t: Column) -> Column:
    """All matches of a query and one slice, `array<MATCH>`; empty for an empty query or slice and for other lengths."""
    m, n = F.length(q), F.length(t)
    return (
        F.when((m == 0) | (n == 0), _none())
        .when(n == m, equal_length(q, t))
        .when(n == m + 1, one_longer(q, t))
        .when(n == m - 1, one_shorter(q, t))
        .otherwise(_none())
    )


def may_match(q: Column, t: Column) -> Column:
    """A necessary condition on the slice `t` of up to length(q)+1 characters from a start: one edit leaves one half of the query whole.

    Plain string comparisons, so it runs inside generated code before the costlier `matches_at`.
    """
    m = F.length(q)
    half = F.floor(m / 2).cast("int")
    first, rest = F.left(q, half), F.substring(q, half + 1, m)
    long = m - half
    return (m < 2) | (F.left(t, half) == first) | (F.substring(t, half + 1, long) == rest) | (F.substring(t, half + 2, long) == rest) | ((half > 0) & (F.substring(t, F.greatest(half, F.lit(1)), long) == rest))


def matches_at(q: Column, t: Column) -> Column:
    """All matches of slices that start where `t` starts; `t` is what follows there, up to length(q)+1 characters."""
    m, n = F.length(q), F.length(t)
    return F.concat(
        F.when((m > 0) & (n >= m), equal_length(q, F.left(t, m))).otherwise(_none()),
        F.when((m > 0) & (n > m), one_longer(q, t)).otherwise(_none()),
        F.when((m > 1) & (n >= m - 1), one_shorter(q, F.left(t, m - 1))).otherwise(_none()),
    )


#: Necessary for a match at a start, `may_match` as one expression; and the four kinds of match in closed form, each with
#: the range of its slots. `p` is the common prefix of q and t, `d` the last index at which a deletion can be.
_MAY_MATCH = """
length(q) < 2 or left(t, int(length(q) / 2)) = left(q, int(length(q) / 2))
or substring(t, int(length(q) / 2) + 1, length(q) - int(length(q) / 2)) = substring(q, int(length(q) / 2) + 1)
or substring(t, int(length(q) / 2) + 2, length(q) - int(length(q) / 2)) = substring(q, int(length(q) / 2) + 1)
or substring(t, greatest(int(length(q) / 2), 1), length(q) - int(length(q) / 2)) = substring(q, int(length(q) / 2) + 1)"""
_KINDS = """
case when m > 0 and p >= m then struct('exact' as edit_type, 0 as low, 0 as high, m as correct_characters) end,
case when m > 0 and n >= m and p < m and substring(q, p + 2, m) = substring(t, p + 2, m - p - 1)
  then struct('replacement' as edit_type, p as low, p as high, m - 1 as correct_characters) end,
case when m > 0 and n > m and substring(t, p + 2, m + 1) = substring(q, p + 1, m)
  then struct('insertion' as edit_type, length(rtrim(substring(t, p + 1, 1), left(t, p + 1))) as low, p as high, m as correct_characters) end,
case when m > 1 and n >= m - 1 and substring(q, d + 2, m) = substring(t, d + 1, m - 1 - d)
  then struct('deletion' as edit_type, length(rtrim(substring(q, d + 1, 1), left(q, d + 1))) as low, d as high, m - 1 as correct_characters) end"""


def _common_prefix(rows: DataFrame, keep: list[str], longest: int) -> DataFrame:
    """Adds `p`, the length of the common prefix of q and t, found bit by bit, so that it stays in generated code.

    `longest` is at least the length of every query.
    """
    rows = rows.selectExpr(*keep, "q", "t", "0 as p")
    for bit in reversed(range(max(1, longest).bit_length())):
        to = f"p + {1 << bit}"
        more = f"{to} <= length(q) and {to} <= length(t) and left(q, {to}) = left(t, {to})"
        rows = rows.selectExpr(*keep, "q", "t", f"case when {more} then {to} else p end as p")
    return rows


def verified(starts: DataFrame, keep: list[str], longest: int) -> DataFrame:
    """`keep + match_start, edit_type, edit_index, correct_characters` from rows with `q, t, match_start`; `t` as in `matches_at`.

    The same rows as `matches_at` gives, in closed form. With p the common prefix, an edit can only be at p; a slot or
    index before p is as good exactly if the characters from there to p are equal, so the valid ones end at p and begin
    where the run of p's character begins.
    """
    keep = [f"`{c}`" for c in (*keep, "match_start")]
    rows = _common_prefix(starts.where(_MAY_MATCH), keep, longest)
    sized = rows.selectExpr(*keep, "q", "t", "p", "length(q) as m", "length(t) as n", "least(p, length(q) - 1) as d")
    each = sized.selectExpr(*keep, f"inline(array({_KINDS}))").where("edit_type is not null")
    slots = each.selectExpr(*keep, "edit_type", "explode(sequence(low, high)) as i", "correct_characters")
    return slots.selectExpr(*keep, "edit_type", "case when edit_type <> 'exact' then i end as edit_index", "correct_characters")
