"""Normalization, words, grams, buckets and mutations as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What normalization deletes (any punctuation, and the ASCII symbols), and what counts as a blank.
PUNCTUATION = r"[\p{P}$+<=>^`|~]"
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Upper ends of the length and result-count buckets, and their names; each with the names of other reports.
LENGTH_BUCKETS = ((1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "5"), (6, "6"), (8, "7-8"), (12, "9-12"), (20, "13-20"), (None, "21+"))
RESULT_BUCKETS = ((0, "0"), (5, "1-5"), (20, "6-20"), (100, "21-100"), (1000, "101-1000"), (None, "1000+"))
SHORT_RESULT_BUCKETS = ((0, "0"), (5, "1-5"), (20, "6-20"), (100, "21-100"), (None, "100+"))
LENGTH_TAGS = ((2, "length_1_2"), (5, "length_3_5"), (8, "length_6_8"), (15, "length_9_15"), (None, "length_16_plus"))

# Fixed value: what makes a word one with repeats.
REPEATS = r"(.)\1|(.{2,}).*\2"

WORD_TYPE = "array<struct<word:string,start_pos:int,end_pos:int>>"


def normalize(text: Column) -> Column:
    """Lower case, punctuation deleted, runs of blanks made one space, ends stripped. Null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), BLANK + "+", " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Words that are summed up one by one within a block; begins of blocks come from the blocks' sums.
_BLOCK = 64


def word_positions(text: Column) -> Column:
    """The words of a text, between blanks, with their half-open ranges in code points; an empty array for an empty text.

    A begin is the sum of the lengths before it: of whole blocks, then of the words of its own block. So the work grows
    with the number of words, not with its square, and stays in built-in expressions.
    """
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    blocks = lambda x: F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int"))

    def place(parts: Column, lengths: Column, begins: Column) -> Column:
        def of_block(b: Column) -> Column:
            own = lambda j: begins[b] + total(F.slice(lengths, b * _BLOCK + 1, j))
            made = lambda w, start: F.struct(w.alias("word"), start.alias("start_pos"), (start + F.length(w)).alias("end_pos"))
            return F.transform(F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK)), lambda w, j: _let(own(j), lambda start: made(w, start)))

        return F.filter(F.flatten(F.transform(blocks(parts), of_block)), lambda x: x["word"] != "")

    def with_sums(parts: Column, lengths: Column) -> Column:
        sums = F.transform(blocks(lengths), lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
        begins = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
        return _let(sums, lambda s: _let(begins(s), lambda at: place(parts, lengths, at)))

    return _let(F.split(text, " "), lambda parts: _let(F.transform(parts, lambda w: F.length(w) + 1), lambda lengths: with_sums(parts, lengths)))


def grams(text: Column, size: int) -> Column:
    """`array<struct<gram, position>>`: the overlapping grams of `size` code points; empty if the text is shorter."""
    last = F.length(text) - size
    made = F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(F.substring(text, p + 1, F.lit(size)).alias("gram"), p.cast("int").alias("position")))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<struct<gram:string,position:int>>"))


def bucket(value: Column, ladder: tuple) -> Column:
    """The name of the first step of `ladder` that `value` doesn't exceed; null for null."""
    out = None
    for top, name in ladder[:-1]:
        out = F.when(value <= top, name) if out is None else out.when(value <= top, name)
    return out.when(value.isNotNull(), ladder[-1][1])


def length_bucket(length: Column) -> Column:
    return bucket(length, LENGTH_BUCKETS)


def result_bucket(count: Column) -> Column:
    return bucket(count, RESULT_BUCKETS)


def short_result_bucket(count: Column) -> Column:
    """The result buckets of a run summary, which ends at 100+."""
    return bucket(count, SHORT_RESULT_BUCKETS)


def length_tag(length: Column) -> Column:
    """The coarser length classes of a real-corpus workload."""
    return bucket(length, LENGTH_TAGS)


def has_repeats(word: Column) -> Column:
    """True of a word with a doubled character, or with a piece of two or more characters that comes again."""
    return word.rlike(REPEATS)


def mutations(word: Column, at: Column) -> Column:
    """`array<struct<mutation, text>>`: the word with the character at 0-based `at` replaced, left out, and one put before it."""
    head, tail, here = F.left(word, at), F.substring(word, at + 2, F.length(word)), F.substring(word, at + 1, F.lit(1))
    return F.array(
        F.struct(F.lit("replacement").alias("mutation"), F.concat(head, F.when(here == "x", "z").otherwise("x"), tail).alias("text")),
        F.struct(F.lit("missing_character").alias("mutation"), F.concat(head, tail).alias("text")),
        F.struct(F.lit("extra_character").alias("mutation"), F.concat(head, F.lit("x"), here, tail).alias("text")),
    )
