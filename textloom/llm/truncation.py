"""Texts that lost their end at a field limit or in transfer.

Method named: a self-join by prefix, values that are strict prefixes of longer copies elsewhere (`prefix_of_longer`).
It proves a cut but finds one only where a longer copy exists, which few cut texts have. So a second operator,
`end_signs`, reads from the end of a text whether it stops inside a word or a sentence, and `find_truncated` joins both.

Signs of a cut, looked for in the last line: a mark for it; an ellipsis after words that are no stock remark;
a character lost halfway; no end of a sentence where the line is running text, or where a structured line (list,
signature, tags, table, code) is left open. No phrase is listed: a stock remark is a closing sentence that always trails
off. Of the different texts whose last sentence begins with its words, at least `REMARK_SHARE` have nothing but an
ellipsis behind them, and they are `REMARK_TEXTS` or more. Neither number depends on the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import skew
from textloom.session import cut, spread

#: Of the different texts whose last sentence begins with a remark's words, the share that trails off right behind them.
REMARK_SHARE = 0.5
#: Different texts that a stock remark ends at least: one or two say nothing about how a phrase usually goes on.
REMARK_TEXTS = 3
#: The fewest characters that two texts must share for one to count as a copy of the other; a parameter, 1 joins all.
SHORTEST = 16
#: Rows of (length, hash, prefix length) up to which the second step of the prefix join is broadcast; 24 bytes each.
BROADCAST_ROWS = 500_000

# Ways to say that text was cut.
MARKS = (
    r"(?i)(\[(cut|truncated|snip|snipped|\.\.\.|…|more)\]|\((cut|truncated|more|continued|cont\.)\)"
    r"|<(cut|truncated|snip)>|(\[|\()\+\d+ (chars|characters)(\]|\)))$"
)
# What may end a sentence, and what may close behind it.
SENTENCE_END = r"[.!?。！？؟۔׃‽]"
CLOSERS = r"[\"'”’»›“‘\)\]\}*_]*"

# Last lines that are whole without a full stop, and what stands above a signature.
STRUCTURED = (
    r"^[\*\-•–] +\S",  # an entry of a list
    r"^\|.*\|$",  # a row of a table
    r"^\(.*\)$",  # a remark in brackets
    r"^\[[^\[\]]*\]$",  # a page mark or the like
    r"^(\*{2,}.*\*{2,}|={2,}.*={2,}|-{2,}.*-{2,}|_{2,}.*_{2,}|#{2,}.*#{2,}|~{2,}.*~{2,})$",  # a rule, an end mark
    r"^[~—–] ?\S",  # a signature
    r"^\p{L}[\p{L} ]{0,30}: ?[^\s,.;]+(, ?[^\s,.;]+)+$",  # tags
    r"^(def|class|if|for|while)\b.*:$",  # code: the head of a block
    r"^(return|import|print)\b *([\w.()\[\]]+( ?[-+*/%,] ?[\w.()\[\]]+)*)?$",  # code: one expression
    r"^[\w.\[\]]+ ?[-+*/]?= ?\S",  # code: an assignment
    r"[;{}]$",
    r"^(https?://|www\.)\S+$",
)
ABOVE_SIGNATURE = r"^(-- ?|__+|—+)$"
SIGNATURE = r"^[~—–] ?\S"
NUMBER_ONLY = r"^\(?\d+[.)]$"
TRAILING = r"\s*(\.\.\.|…)" + CLOSERS + "$"
LEFT_OPEN = r"(,|;|:|\p{L}-|\(|«|“|„|¿|¡)$"
#: All that stands before the last sentence of a line, up to that sentence's first character.
BEFORE_LAST = r"^.*[.!?:…。！？؟][\s\"'”’»›)\]]+(\S)"


def _power_of_2(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), exponent)


def prefix_of_longer(df: DataFrame, row_id: str, text: str, shortest: int = SHORTEST) -> DataFrame:
    """`row_id` of the rows whose text, of `shortest` characters at least, begins a longer text of another row.

    Texts are compared by 64-bit hashes of prefixes, in two steps, so that nobody meets all members of a group. A text
    of n characters is filed under its prefix of p characters, the largest power of 2 up to n; under each such prefix
    the lengths that occur are kept, fewer than p of them. A longer text then hashes its prefixes of just these
    lengths. A heading that begins a third of all texts makes one hot prefix, so the first step is joined by fragments
    (`operators.skew`); the second sends lengths to the texts, by broadcast if they are few, never all texts to a task.
    Blanks at the end don't count. Equal texts are no longer copies of each other. Null texts have no row.
    """
    if shortest < 1:
        raise ValueError("shortest is 1 or more")
    stripped = F.rtrim(F.col(text), F.lit(" \t\r\n"))
    rows = spread(df.select(row_id, text)).select(F.col(row_id).alias("__id"), stripped.alias("__t"))
    sized = rows.withColumn("__n", F.length("__t")).where(F.col("__n") >= shortest).withColumn("__h", F.xxhash64("__t"))
    power = F.floor(F.log2(F.col("__n") + 0.5)).cast("int")
    head = lambda n: F.xxhash64(F.substring(F.col("__t"), F.lit(1), n))
    own = sized.select("__id", "__n", "__h", power.alias("__p"), head(_power_of_2(power)).alias("__b"))
    filed = own.groupBy(F.xxhash64("__p", "__b").alias("__k")).agg(F.collect_set("__n").alias("__ns"))
    first = int(shortest).bit_length() - 1
    powers = F.transform(F.sequence(F.lit(first), power), lambda p: F.xxhash64(p, head(_power_of_2(p))))
    heads = sized.select("__n", "__h", F.explode(powers).alias("__k"))
    met = skew.fragment_replicate_join(heads, filed, "__k", row_id="__h")
    shorter = F.filter("__ns", lambda n: n < F.col("__n"))
    asked = cut(met.select("__n", "__h", F.explode(shorter).alias("__len")).distinct())
    few = asked.count() <= BROADCAST_ROWS
    lengths = asked.groupBy("__n", "__h").agg(F.collect_set("__len").alias("__lens"))
    wanted = sized.select("__t", "__n", "__h").join(F.broadcast(lengths) if few else lengths, ["__n", "__h"])
    proofs = wanted.select(F.explode(F.transform("__lens", lambda n: F.struct(n.alias("__n"), head(n).alias("__h")))).alias("x"))
    return own.join(proofs.select("x.*").distinct(), ["__n", "__h"], "left_semi").select(F.col("__id").alias(row_id))


def ends(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`keep`, and `__line, __above`: the last line that isn't blank, and the one above it, blanks around them cut off."""
    tail = F.rtrim(F.col(text), F.lit(" \t\r\n\u00a0"))
    two = F.substring_index("__tail", "\n", -2)
    lines = df.select(*keep, tail.alias("__tail")).withColumn("__two", two)
    above = F.when(F.col("__two").contains("\n"), F.trim(F.substring_index("__two", "\n", 1))).otherwise(F.lit(""))
    return lines.select(*keep, F.trim(F.substring_index("__two", "\n", -1)).alias("__line"), above.alias("__above"))


def _last_sentence(line: Column) -> Column:
    """The words of the last sentence of a line, in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), BEFORE_LAST, "$1"), r"\s+", " "))


def _signed(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`keep, __h, __said, sign, __finished` of the texts whose end is not plainly that of a sentence.

    `__h` hashes the whole text; `__said` is the last sentence before an ellipsis; sign is null for structured ends.
    """
    rows = spread(df.select(*keep, F.col(text))).where(F.col(text).isNotNull()).withColumn("__h", F.xxhash64(text))
    last = ends(rows, [*keep, "__h"], text).where(F.col("__line") != "")
    # The commonest ends are settled by their last characters, before any pattern is tried.
    plain = F.right("__line", F.lit(1)).isin(".", "!", "?") & ~F.endswith("__line", F.lit("...")) & (F.length("__line") > 8)
    rest = last.where(~plain).withColumn("__end", F.right("__line", F.lit(48)))
    line, above, end = F.col("__line"), F.col("__above"), F.col("__end")
    finished = end.rlike(SENTENCE_END + CLOSERS + "$") & ~line.rlike(NUMBER_ONLY)
    structured = above.rlike(ABOVE_SIGNATURE)
    for pattern in STRUCTURED:
        structured = structured | (line if pattern.startswith("^") else end).rlike(pattern)
    left_open = end.rlike(LEFT_OPEN) & ~(above.rlike(ABOVE_SIGNATURE) | line.rlike(SIGNATURE))
    sign = (
        F.when(end.rlike(MARKS), F.lit("mark"))
        .when(end.endswith("\ufffd"), F.lit("lost_character"))
        .when(end.rlike(TRAILING), F.lit("ellipsis"))
        .when(~finished & (~structured | left_open), F.lit("open_end"))
    )
    said = F.when(end.rlike(TRAILING), _last_sentence(F.regexp_replace(line, TRAILING, "")))
    marked = rest.select(*keep, "__h", said.alias("__said"), sign.alias("sign"), finished.alias("__finished"))
    return marked.where(F.col("sign").isNotNull() | ~F.col("__finished"))


def _stock_remarks(df: DataFrame, text: str, trailing: DataFrame) -> DataFrame:
    """`__said` of the stock remarks among the last sentences of `trailing` (`__said, __h`), which trail off."""
    often = trailing.where(F.col("__said") != "").select("__said", "__h").distinct().groupBy("__said").agg(F.count(F.lit(1)).alias("__n"))
    often = cut(often.where(F.col("__n") >= REMARK_TEXTS))
    sizes = [r["w"] for r in often.select(F.size(F.split("__said", " ")).alias("w")).distinct().collect()]  # numbers of words, few
    if not sizes:
        return often.select("__said")
    rows = df.select(F.col(text)).where(F.col(text).isNotNull()).withColumn("__h", F.xxhash64(text))
    words = F.split(_last_sentence(F.regexp_replace("__line", TRAILING, "")), " ")
    said = ends(rows, ["__h"], text).where(F.col("__line") != "").select("__h", words.alias("__w"))
    begun = F.transform(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda n: n <= F.size("__w")), lambda n: F.array_join(F.slice("__w", 1, n), " "))
    all_ = said.select("__h", F.explode(begun).alias("__said")).join(often, "__said").distinct().groupBy("__said", "__n").agg(F.count(F.lit(1)).alias("__all"))
    return all_.where(F.col("__n") >= REMARK_SHARE * F.col("__all")).select("__said")


def _read_ends(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`keep, sign, __finished`: texts with a sign of a cut, and texts that are whole without a full stop (sign null)."""
    open_ = cut(_signed(df, keep, text))
    trailing = open_.where(F.col("sign") == "ellipsis")
    cut_short = trailing.join(_stock_remarks(df, text, trailing), "__said", "left_anti")
    columns = [*keep, "sign", "__finished"]
    others = open_.where(F.col("sign").isNull() | (F.col("sign") != "ellipsis"))
    return others.select(*columns).unionByName(cut_short.select(*columns))


def end_signs(df: DataFrame, row_id: str, text: str, source: str | None = None) -> DataFrame:
    """`row_id[, source], sign` of the rows whose end shows a cut: mark, lost_character, ellipsis or open_end.

    Null, empty and blank texts have no end to lose. The length of a text or of a line is no sign. Repeated rows come
    out as often as they stand. An empty table gives no rows.
    """
    keep = [c for c in (row_id, source) if c]
    return _read_ends(df, keep, text).where(F.col("sign").isNotNull()).select(*keep, "sign")


def find_truncated(df: DataFrame, row_id: str, text: str, source: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """`row_id[, source], sign, has_longer_copy` of the rows whose text lost its end.

    The prefix join leads: a text that is a strict prefix of a longer copy is cut, unless it ends as a sentence does
    (a shorter version of a document may well be whole). `sign` is that of `end_signs`, or longer_copy where the end
    shows nothing (an entry of a list, say) and only the copy proves the cut. Defined cases as for `end_signs`.
    """
    keep = [c for c in (row_id, source) if c]
    longer = prefix_of_longer(df, row_id, text, shortest).distinct().select(F.col(row_id).alias("__id"), F.lit(True).alias("__l"))
    both = _read_ends(df, keep, text).join(longer, F.col(row_id) == F.col("__id"), "left")
    found = both.where(F.col("sign").isNotNull() | F.col("__l"))
    return found.select(*keep, F.coalesce("sign", F.lit("longer_copy")).alias("sign"), F.coalesce("__l", F.lit(False)).alias("has_longer_copy"))


def truncation_rates(df: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """`source, n_rows, n_truncated, share` for every source, null included."""
    lost = find_truncated(df, row_id, text, source).groupBy(source).agg(F.count(F.lit(1)).alias("n_truncated"))
    rows = df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = rows.alias("r").join(lost.alias("c"), F.col(f"r.{source}").eqNullSafe(F.col(f"c.{source}")), "left")
    n = F.coalesce("n_truncated", F.lit(0))
    return joined.select(F.col(f"r.{source}").alias(source), "n_rows", n.alias("n_truncated"), (n / F.col("n_rows")).alias("share"))
