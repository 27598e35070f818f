"""Passages of held-out items inside a corpus.

Method: pigeonhole edit matching. A passage is `min_words` consecutive words of an item. Items are cut into pieces of p
words with (budget + 2) * p - 1 <= min_words, so every passage holds budget + 1 whole pieces, and a copy with at most
`budget` wrong, missing or extra words keeps one of them intact. Pieces are found exactly, all in one walk over a
document (Aho-Corasick); each hit is verified with Myers' bit-parallel distance, with words as the symbols.

Words are those of problem 2's comparison form in lower case, without punctuation. The corpus is read once and not
shuffled; the items are broadcast after a check of their size, beyond which they are handled in blocks.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.canonical import _MARKED, _MARKS, _form, mapping
from textloom.session import spread

#: Characters of item text that one block, and so one broadcast, holds at most (unless a single item is longer).
BLOCK_CHARS = 20_000_000


@lru_cache(maxsize=1)
def _word_table() -> dict[int, str | None]:
    """One character -> its comparison form in lower case; punctuation goes, blanks become a space."""
    table: dict[int, str | None] = {}
    for code in range(0x10000):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        out = mapping().get(code, c).lower()
        out = "".join(" " if x.isspace() else "" if unicodedata.category(x)[0] == "P" or x in "$+<=>^`|~" else x for x in mapping_of(out))
        if out != c:
            table[code] = out
    return table


def mapping_of(text: str) -> str:
    return text if text.isascii() else text.translate(mapping())


_HAS_MARK, _CLUSTER = re.compile(f"[{_MARKS}]"), re.compile(_MARKED, re.S)
_OTHER = re.compile(r"[^\x00-\x7f]+")
_ASCII_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]+")


@lru_cache(maxsize=200_000)
def _other(run: str) -> str:
    return run.translate(_word_table())


def words_of(text: str | None) -> list[str]:
    """The words of a text as compared; none for null."""
    if not text:
        return []
    if not text.isascii():
        if _HAS_MARK.search(text):
            text = _CLUSTER.sub(lambda m: _form(m.group()), text)
        text = _OTHER.sub(lambda m: _other(m.group()), text)
    return _ASCII_PUNCTUATION.sub("", text.lower()).split()


def myers(pattern: list, text: list) -> tuple[int, int]:
    """The least number of words to change, drop or add so that `pattern` occurs in `text`, and where that occurrence ends.

    Bit-parallel (Myers 1999): one Python integer holds a whole column of the distance table, for patterns of any length.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    eq: dict = defaultdict(int)
    for i, w in enumerate(pattern):
        eq[w] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, where = mask, 0, m, m, 0
    for j, w in enumerate(text, 1):
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, where = score, j
    return best, where


class Items:
    """Items cut into pieces, and the automaton that finds all pieces."""

    def __init__(self, items: list[tuple[object, str]], min_words: int, budget: int) -> None:
        self.min_words, self.budget = min_words, budget
        self.piece = (min_words + 1) // (budget + 2)
        if self.piece < 1:
            raise ValueError("the error budget is too large for passages of so few words")
        self.words = {i: words_of(t) for i, t in items}
        self.words = {i: w for i, w in self.words.items() if len(w) >= min_words}
        self.places: dict[str, list[tuple[object, int]]] = defaultdict(list)
        for i, words in self.words.items():
            for at in range(0, len(words) - self.piece + 1, self.piece):
                self.places[" ".join(words[at : at + self.piece])].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece in self.places:
            self.automaton.add_word(f" {piece} ", piece)
        if self.places:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[object, int, int, int]]:
        """`item, longest run of shared words, distance, word at which it ends` for each item with a passage in `text`."""
        if not self.places:
            return []
        doc = words_of(text)
        if len(doc) < self.min_words - self.budget:
            return []
        joined = f" {' '.join(doc)} "
        hits = list(self.automaton.iter(joined))
        if not hits:
            return []
        found: dict[object, tuple[int, int, int]] = {}
        chars, word = 0, 0
        done: dict[tuple[object, int], int] = {}
        for start, piece in sorted((end - len(piece) - 1, piece) for end, piece in hits):
            word += joined.count(" ", chars, start)
            chars = start
            for item, at in self.places[piece]:
                diagonal = (item, word - at)
                if done.get(diagonal, -1) < word:
                    done[diagonal] = self._verify(item, at, doc, word, found)
        return [(i, run, dist, end) for i, (run, dist, end) in found.items()]

    def _verify(self, item: object, at: int, doc: list[str], word: int, found: dict) -> int:
        """Enters what the hit of the item's word `at` at the document's word `word` proves; returns the last word of its exact run."""
        mine, p, m, k = self.words[item], self.piece, self.min_words, self.budget
        low, high = 0, p
        while at + low > 0 and word + low > 0 and mine[at + low - 1] == doc[word + low - 1]:
            low -= 1
        while at + high < len(mine) and word + high < len(doc) and mine[at + high] == doc[word + high]:
            high += 1
        run, best = high - low, None
        if run >= m:
            best = (run, 0, word + high)
        elif k:
            first, last = max(0, at + p - m), min(at, len(mine) - m)
            lo, hi = max(0, word - m - k), min(len(doc), word + m + k)
            segment = doc[lo:hi]
            there = set(segment)
            around = mine[first : last + m]
            if sum(w in there for w in around) < m - k:
                return word + high - 1
            for s in range(first, last + 1):
                passage = mine[s : s + m]
                if sum(w not in there for w in passage) > k:
                    continue
                dist, end = myers(passage, segment)
                if dist <= k and (best is None or dist < best[1]):
                    best = (run, dist, lo + end)
                    if not dist:
                        break
        if best:
            old = found.get(item)
            if old is None or (-best[1], best[0]) > (-old[1], old[0]):
                found[item] = (max(best[0], old[0]) if old else best[0], best[1], best[2])
        return word + high - 1


#: Items of this Python worker, by broadcast.
_LOADED: dict[str, Items] = {}


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull()).toLocalIterator():
        if block and size + len(r["t"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 12, budget: int = 1) -> DataFrame:
    """`doc_id, item_id, run_words, distance, end_word`: documents with a passage of `min_words` words of an item, up to `budget` wrong words.

    One row per document and item: the least distance, the longest exact run around a piece of it, and the word of the
    document at which it ends. Several items with one passage all come out. Items shorter than `min_words` words have
    no passage; null and empty texts hold none. Repeated documents come out under each id; ids need not be unique
    (then once per row). An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("__t")).where(F.col("__t").isNotNull())
    d_type, i_type = rows.schema["__d"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{doc_id}` {d_type}, `{item_id}` {i_type}, run_words int, distance int, end_word int"
    out = None
    for block in _blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast((block, min_words, budget))

        def search(batches: Iterator[pd.DataFrame], sent=sent, token=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            if token not in _LOADED:
                _LOADED.clear()
                _LOADED[token] = Items(*sent.value)
            own = _LOADED[token]
            for pdf in batches:
                got = [(d, *leak) for d, t in zip(pdf["__d"], pdf["__t"]) for leak in own.leaks(t)]
                if got:
                    yield pd.DataFrame(got, columns=[doc_id, item_id, "run_words", "distance", "end_word"])

        part = spread(rows).mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out
