"""Text that was decoded with the wrong character encoding: finding the places, and the original text.

Method: a smoothed character n-gram model is trained on the clean records; at each place outside ASCII every candidate
encode-decode chain is scored against the text as it stands, and the likeliest is accepted beyond a validated margin. A
place is a run of characters outside ASCII with two characters of context on either side, the reach of the trigrams.

A step of a chain names the codec that the text was wrongly decoded with and the codec that it was written in; repairing
encodes with the first and decodes with the second. Candidates are all single steps between the codecs below (UTF-8 read
as any of them, any one-byte codec read as another, an East Asian codec read as a one-byte one), UTF-8 steps up to
`DEPTH` times, and a UTF-8 step before or after a step of another kind. Characters that no codec can give back (U+FFFD,
C1 controls) make a place garbled even if no chain fits.

The model counts in how many different lines an n-gram stands, hashed into a fixed number of buckets, so its size
doesn't depend on the data and copies of a garbled line don't make it usual. A second pass leaves out the lines that the
first model would repair; a third scores. A line that the model was trained on is scored with one line less, else a line
that is garbled in its own way would be likely by itself; so a decision depends on the place alone, and is remembered.
The different lines and bucket counts are shuffled.
"""

from __future__ import annotations

import codecs
import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.canonical import CYRILLIC, GREEK, OTHER
from textloom.session import cut, spread

#: Buckets of the counts of each n-gram order.
BITS = {1: 17, 2: 20, 3: 22}
#: Interpolation weights of the orders 3, 2, 1; the rest is uniform.
WEIGHTS = (0.80, 0.16, 0.0399)
UNIFORM = (1 - sum(WEIGHTS)) / 100_000
#: Log-likelihood that a chain must gain. Validated on held-out lines without a word of the training lines, garbled by
#: every chain (`margin_errors`, tests/llm/test_encoding.py).
MARGIN = 3.0
#: A repair without a UTF-8 step must consist of trigrams whose likelihood is at least this on average.
PLAUSIBLE = -5.5
DEPTH = 3
#: Lines that a task counts at a time.
LINES = 20_000

# Codecs of one byte a character from 0x80 on, the commonest first.
ONE_BYTE = (
    "cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1257", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp862", "cp866",
    "koi8-r", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-8", "iso8859-15",
)
# East Asian codecs of two bytes a character.
TWO_BYTE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
# Codecs whose letters lie where the trailing bytes of UTF-8 do, so that clean words can spell sequences.
SPELL_BY_CHANCE = ("cp866", "mac_cyrillic", "iso8859-5")

#: Steps that clean text can't pass for.
_SURE = frozenset(f"{c}>utf-8" for c in (*ONE_BYTE, *TWO_BYTE) if c not in SPELL_BY_CHANCE)
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Letters of another script and blanks that show as ASCII does (problem 2): rare, but not garbled.
_BLANKS = "\u00a0\u2007\u2009\u202f\u3000"
_SHOWN_ALIKE = frozenset(CYRILLIC + GREEK + OTHER + _BLANKS)
#: Quotation marks that were typed after the garbling, and stand in a garbled run as they are.
_QUOTES = frozenset("“”‘’«»")
#: A capital behind a small letter, as in a word whose case was swapped by a wrong codec.
_CASE = re.compile("[a-zß-öø-ÿа-џα-ώ][A-ZÀ-ÖØ-ÞЀ-ЯΑ-Ω]")
_LOST = re.compile("[\ufffd\x80-\x9f]")


@lru_cache(maxsize=None)
def to_bytes(codec: str) -> dict[str, int]:
    """Character -> byte from 0x80 on; bytes that the codec leaves open are the C1 controls of that number, as many decoders have it."""
    table: dict[str, int] = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        c = bytes([b]).decode(codec, "ignore")
        if c:
            table[c] = b
    return table


@lru_cache(maxsize=1)
def _masks() -> tuple[dict[str, int], dict[str, int]]:
    """Character -> the codecs, as bits, in which it is the first byte of a UTF-8 sequence, or a later one."""
    lead: dict[str, int] = defaultdict(int)
    more: dict[str, int] = defaultdict(int)
    for i, codec in enumerate(ONE_BYTE):
        for c, b in to_bytes(codec).items():
            if 0xC2 <= b < 0xF5:
                lead[c] |= 1 << i
            elif b < 0xC0:
                more[c] |= 1 << i
    return dict(lead), dict(more)


def spelling(text: str) -> list[str]:
    """The one-byte codecs in which some two neighbours of `text` can begin a UTF-8 sequence."""
    lead, more = _masks()
    found, before = 0, 0
    for c in text:
        found |= before & more.get(c, 0)
        before = lead.get(c, 0)
    return [codec for i, codec in enumerate(ONE_BYTE) if found >> i & 1]


def undo_utf8(text: str, wrong: str) -> tuple[str, int]:
    """`text` with each UTF-8 sequence that its characters spell in `wrong` put right, and the number of sequences."""
    table, out, i, n, done = to_bytes(wrong), [], 0, len(text), 0
    while i < n:
        lead = table.get(text[i], 0)
        more = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
        if more and i + more < n:
            try:
                c = bytes([lead, *(table.get(x, 0) for x in text[i + 1 : i + 1 + more])]).decode()
                if not "\x80" <= c < "\xa0" or wrong in ("cp1252", "latin-1"):
                    out.append(c)
                    i += 1 + more
                    done += 1
                    continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out), done


def _utf8_steps(text: str, whole: bool = False) -> Iterator[tuple[str, str]]:
    """What `text` was, if it was UTF-8 read as another codec; `whole`: a sequence must begin with its first character."""
    for wrong in spelling(text[:2] if whole else text):
        fixed, n = undo_utf8(text, wrong)
        if n:
            yield fixed, f"{wrong}>utf-8"
    if text[0] >= "\u2e80":
        for wrong in TWO_BYTE:
            try:
                yield text.encode(wrong).decode(), f"{wrong}>utf-8"
            except UnicodeError:
                pass


@lru_cache(maxsize=None)
def _reads(codec: str) -> str:
    """The character of each byte, U+FFFE where the codec has none or a control."""
    back = {b: c for c, b in to_bytes(codec).items() if not "\x80" <= c < "\xa0"}
    return "".join(chr(b) if b < 0x80 else back.get(b, "\ufffe") for b in range(256))


def _other_steps(text: str) -> Iterator[tuple[str, str]]:
    """What `text` was, if it was written in a one-byte or East Asian codec and read as another one-byte codec."""
    inner = text.strip(_BLANKS)
    before, after = text[: text.find(inner)], text[text.find(inner) + len(inner) :]
    text, inner = inner, "".join([c for c in inner if c not in _QUOTES]) if not _QUOTES.isdisjoint(inner) else inner
    tried: set[bytes] = set()
    for wrong in ONE_BYTE if inner else ():
        try:
            raw = bytes([to_bytes(wrong)[c] for c in inner])
        except KeyError:
            continue
        if raw in tried:
            continue
        tried.add(raw)
        for right in ONE_BYTE:
            fixed, _ = codecs.charmap_decode(raw, "ignore", _reads(right))
            if len(fixed) == len(raw) and fixed != inner:
                if inner is not text:
                    chars = iter(fixed)
                    fixed = "".join([c if c in _QUOTES else next(chars) for c in text])
                yield before + fixed + after, f"{wrong}>{right}"
        if len(raw) > 1 and inner is text:
            for right in TWO_BYTE:
                try:
                    yield before + raw.decode(right) + after, f"{wrong}>{right}"
                except UnicodeError:
                    pass


def _mixes(before: str, run: str, after: str) -> bool:
    """True if a letter that isn't Latin would stand next to an ASCII letter."""
    return any(x.isascii() and x.isalpha() and y.isalpha() and y >= "Ͱ" for x, y in ((before[-1:], run[:1]), (after[:1], run[-1:])))


def _is_text(text: str) -> bool:
    return all(c.isprintable() or c in "\xa0\xad" for c in text)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _hashes(c: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each position from order-1 on."""
    h = c[order - 1 :].copy()
    for k in range(1, order):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ c[order - 1 - k : len(c) - k]
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS[order])).astype(np.int64)


def _bucket(codes: tuple[int, ...]) -> int:
    """The bucket of one n-gram, as `_hashes` has it."""
    h = codes[-1]
    for c in codes[-2::-1]:
        h = (h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) ^ c
    return (h * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS[len(codes)])


@lru_cache(maxsize=100_000)
def _spells(run: str) -> bool:
    return any(w not in SPELL_BY_CHANCE and undo_utf8(run, w)[1] for w in spelling(run))


def is_clean(line: str) -> bool:
    """True of a line to train on: nothing lost, and no UTF-8 sequence under a codec in which clean words can't spell one."""
    if line.isascii():
        return True
    return not _LOST.search(line) and not any(_spells(run) for run in _RUN.findall(line) if len(run) > 1)


def count_ngrams(lines: list[str]) -> dict[int, np.ndarray]:
    """For each order, per bucket the number of `lines` that hold such an n-gram.

    ASCII n-grams are never judged, only divided by: they are counted by place, and those of three characters not at all.
    """
    c = _codes("".join([f"  {x}  " for x in lines]))
    line = np.repeat(np.arange(len(lines), dtype=np.int64), [len(x) + 4 for x in lines])
    out = {}
    beyond = np.concatenate([[0], np.cumsum(c > 127)])
    for n, bits in BITS.items():
        if len(c) >= n:
            h, one = _hashes(c, n), beyond[n:] > beyond[:-n]
            once = np.unique((line[n - 1 :][one] << bits) | h[one]) & ((1 << bits) - 1)
            out[n] = np.bincount(once, minlength=1 << bits)
            if n < 3:
                out[n] += np.bincount(h[~one], minlength=1 << bits)
    return out


Found = tuple[str, str, bool]


class Model:
    """Interpolated trigram likelihoods from hashed counts of lines; decisions on places are remembered."""

    def __init__(self, counts: dict[int, np.ndarray], margin: float = MARGIN) -> None:
        self.counts, self.margin = counts, margin
        self.total = max(1, int(counts[1].sum()))
        self.memo: dict[tuple, Found | None] = {}
        self.known: dict[object, float] = {}
        self.number: dict[str, int] = {}
        self.present: set[str] = set()
        self.absent: set[str] = set()
        self.tried: dict[str, list[tuple[str, str]]] = {}

    @classmethod
    def of(cls, lines: list[str], margin: float = MARGIN) -> Model:
        return cls(count_ngrams([x for x in dict.fromkeys(lines) if is_clean(x)]), margin)

    def count(self, gram: str) -> int:
        """The number of clean lines that hold `gram`."""
        n = self.number.get(gram)
        if n is None:
            if len(self.number) > 2_000_000:
                self.number.clear()
            n = self.number[gram] = int(self.counts[len(gram)][_bucket(tuple(map(ord, gram)))])
        return n

    def _likelihood(self, gram: str, less: tuple[bool, ...]) -> float:
        """Log-likelihood of the last of three characters after the other two; `less` says which counts lose a line."""
        grams = (gram, gram[:2], gram[1:], gram[1], gram[2])
        c3, c2, c2b, c1, c1b = (max(0, self.count(g) - n) for g, n in zip(grams, less))
        w3, w2, w1 = WEIGHTS
        return math.log(w3 * min(1.0, c3 / max(1, c2)) + w2 * min(1.0, c2b / max(1, c1)) + w1 * c1b / self.total + UNIFORM)

    def scores(self, text: str, own: frozenset[str] = frozenset()) -> list[float]:
        """Log-likelihood of each character of `text` from the third on, with a line less for the n-grams `own`."""
        if len(self.known) > 2_000_000:
            self.known.clear()
        out, known = [], self.known
        for i in range(2, len(text)):
            gram = text[i - 2 : i + 1]
            less = (gram in own, gram[:2] in own, gram[1:] in own, gram[1] in own, gram[2] in own) if own else (False,) * 5
            key = (gram, less) if any(less) else gram
            p = known.get(key)
            if p is None:
                p = known[key] = self._likelihood(gram, less)
            out.append(p)
        return out

    def met(self, text: str, own: frozenset[str] = frozenset()) -> bool:
        """True if every character of `text` stands in a clean line, in one more if it is one of `own`."""
        return all(self.count(c) > (c in own) for c in text)

    def seen(self, text: str, own: frozenset[str]) -> bool:
        """True if every trigram of `text` outside ASCII stands in a clean line, in one more if it is one of `own`."""
        grams = (text[i : i + 3] for i in range(len(text) - 2))
        return all(self.count(g) > (g in own) for g in grams if not g.isascii())

    def _there(self, text: str) -> bool:
        """`met` of a text with lost characters left out, by sets of known characters."""
        for c in set(text) - self.present - self.absent:
            (self.present if c == "\ufffd" or self.count(c) else self.absent).add(c)
        return self.absent.isdisjoint(text)

    def candidates(self, run: str) -> list[tuple[str, str]]:
        """Repaired run, chain: of characters that clean lines hold, or of new ones that a whole run of UTF-8 spells."""
        if run not in self.tried:
            if len(self.tried) > 100_000:
                self.tried.clear()
            self.tried[run] = list(self._candidates(run))
        return self.tried[run]

    def _candidates(self, run: str) -> Iterator[tuple[str, str]]:
        seen, utf8, other = {run}, [], []
        step = [(run, "")]
        for _ in range(DEPTH):
            again = []
            for text, chain in step:
                for fixed, how in _utf8_steps(text):
                    if fixed not in seen:
                        seen.add(fixed)
                        again.append((fixed, f"{chain} {how}".strip()))
            utf8 += again
            step = again
        spelt = list(utf8)
        for text, chain in [(run, ""), *utf8]:
            for fixed, how in _other_steps(text):
                if fixed not in seen:
                    seen.add(fixed)
                    other.append((fixed, f"{chain} {how}".strip()))
        lead, more = _masks()
        for text, chain in other:
            # A run was read wrongly as a whole, and begins where a sequence does.
            if len(text) > 1 and lead.get(text[0], 0) & more.get(text[1], 0) and " " not in chain:
                for fixed, how in _utf8_steps(text, True):
                    if fixed not in seen:
                        seen.add(fixed)
                        utf8.append((fixed, f"{chain} {how}"))
        new = {text for text, chain in spelt if len(text) * 2 <= len(run) and _is_text(text)}
        for text, chain in (*utf8, *other):
            if text in new or self._there(text):
                yield text, chain

    def place(self, before: str, run: str, after: str, trained: bool = False) -> Found | None:
        """What stood there, by which chain, and whether it is restored; None if the place is in order.

        Without the line's own counts much that is rare loses its likelihood, so a repair without UTF-8 must then be
        of trigrams that stand elsewhere.
        """
        key = (before, run, after, trained)
        if key not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self._place(before, run, after, frozenset())
            if got is None and trained and not _SHOWN_ALIKE.issuperset(run):
                text = before + run + after
                own = (text[i : i + n] for n in BITS for i in range(len(text) - n + 1))
                got = self._place(before, run, after, frozenset(g for g in own if not g.isascii()))
            self.memo[key] = got
        return self.memo[key]

    def _place(self, before: str, run: str, after: str, own: frozenset[str]) -> Found | None:
        lost = _LOST.search(run)
        stands, best = sum(self.scores(before + run + after, own)), None
        if not lost and -stands <= self.margin:
            return None  # nothing can gain the margin: no likelihood is above 1
        alike = _SHOWN_ALIKE.issuperset(run)
        for fixed, chain in self.candidates(run):
            utf8 = all(step in _SURE for step in chain.split())
            if not utf8 and (alike or _mixes(before, fixed, after) or _CASE.search(fixed) and not _CASE.search(run)):
                continue
            text = before + fixed + after
            s = self.scores(text, own)
            gain = sum(s) - stands - self.margin * (1 + chain.count(" "))
            if gain <= 0 or best and gain <= best[0] or not utf8 and sum(s) < PLAUSIBLE * len(s):
                continue
            if not utf8 and not self.seen(text, own) or own and not self.met(fixed.replace("\ufffd", ""), own):
                continue
            best = (gain, fixed, chain)
        if best:
            return best[1], best[2], not _LOST.search(best[1])
        return (run, "", False) if lost else None

    def _as_the_rest(self, before: str, run: str, after: str, chains: set[str]) -> Found | None:
        """A place of a line in which other places were garbled by `chains`: any gain is enough."""
        stands = sum(self.scores(before + run + after))
        for fixed, chain in self.candidates(run):
            if chain in chains and not _mixes(before, fixed, after) and sum(self.scores(before + fixed + after)) > stands:
                return fixed, chain, True
        return None

    def repair(self, line: str, trained: bool = False) -> tuple[str, int, int, set[str]]:
        """The line with its garbled places put right; the numbers of garbled and of restored places; the chains.

        `trained`: the line is one of those that the model was trained on, and is scored with one line less.
        """
        out, end, places, found = [], 0, [], False
        padded, memo = f"  {line}  ", self.memo
        for m in _RUN.finditer(line):
            a, b = m.span()
            run, after = m.group(), padded[b + 2 : b + 4]
            if not after.isascii():
                after = after[:1]  # the next run may be garbled itself
            out.append(line[end:a])
            end = b
            before = f" {out[-3]}{out[-2]}{out[-1]}"[-2:] if found and a - len(out[-1]) > 0 and len(out[-1]) < 2 else padded[a : a + 2]
            key = (before, run, after, trained)
            got = memo[key] if key in memo else self.place(*key)
            if got is not None:
                found = True
            places.append((len(out), before, run, after, got))
            out.append(got[0] if got else run)
        if not found:
            return line, 0, 0, set()
        by_byte = {p[-1][1] for p in places if p[-1] and p[-1][1] and ">utf-8" not in p[-1][1]}
        n = restored = 0
        chains = set()
        for at, before, run, after, got in places:
            if got is None and by_byte:
                got = self._as_the_rest(before, run, after, by_byte)
            if got is not None:
                out[at] = got[0]
                n += 1
                restored += got[2]
                chains |= {got[1]} - {""}
        return "".join([*out, line[end:]]), n, restored, chains


def margin_errors(training: list[str], held_out: list[str], chains: list[tuple[str, str]], margins: list[float]) -> list[tuple[float, float, float]]:
    """`margin, share of clean lines touched, share of garbled lines missed` for each margin.

    `held_out` are clean lines that the training lines don't hold; each is also garbled by every chain (right, wrong).
    """
    bad = []
    for line in held_out:
        for right, wrong in chains:
            try:
                text = line.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if text != line:
                bad.append(text)
    out = []
    for margin in margins:
        model = Model.of(training, margin)
        touched = sum(model.repair(x)[1] > 0 for x in held_out) / max(1, len(held_out))
        out.append((margin, touched, sum(not model.repair(x)[1] for x in bad) / max(1, len(bad))))
    return out


def _train(batches: Iterator[pd.DataFrame], model: Model | None = None) -> Iterator[pd.DataFrame]:
    """Counts of the clean lines; of those that `model`, trained on them, would leave as they are, if it is given."""
    total = {n: np.zeros(1 << b, np.int64) for n, b in BITS.items()}
    for pdf in batches:
        lines = [x for x in pdf["__line"] if x.isascii() or is_clean(x) and not (model and model.repair(x, True)[1])]
        for at in range(0, len(lines), LINES):
            for n, c in count_ngrams(lines[at : at + LINES]).items():
                total[n] += c
    for n, c in total.items():
        there = np.flatnonzero(c)
        yield pd.DataFrame({"order": np.full(len(there), n, np.int32), "bucket": there, "n": c[there]})


#: Models of this Python worker, by broadcast.
_LOADED: dict[str, Model] = {}


def _sent(spark: SparkSession, model: Model):
    """A function that gives the model in a Python worker."""
    packed = {n: c.astype(np.uint32 if c.max(initial=0) < 2**32 else np.float64) for n, c in model.counts.items()}
    sent, margin, token = spark.sparkContext.broadcast(packed), model.margin, uuid.uuid4().hex

    def load() -> Model:
        if token not in _LOADED:
            _LOADED.clear()
            _LOADED[token] = Model({n: c.astype(np.int64) if c.dtype == np.uint32 else c for n, c in sent.value.items()}, margin)
        return _LOADED[token]

    return load


def _collected(counted: DataFrame) -> Model:
    got = counted.groupBy("order", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = {n: np.zeros(1 << b, np.int64) for n, b in BITS.items()}
    for n, part in got.groupby("order"):
        counts[int(n)][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return Model(counts)


def train_model(df: DataFrame, text: Column) -> Model:
    """The n-gram model of the different clean lines of `text`, without those that a first model of them all would repair.

    At most the buckets of the table (1.7 million in all) come to the driver; a task sends on as many at most.
    """
    rows = spread(df.select(text.alias("__text")).where(F.col("__text").isNotNull()))
    lines = cut(rows.select(F.explode(F.split("__text", "\n")).alias("__line")).where(F.col("__line") != "").distinct())
    schema = "order int, bucket long, n long"
    load = _sent(df.sparkSession, _collected(lines.mapInPandas(_train, schema)))
    return _collected(lines.mapInPandas(lambda batches: _train(batches, load()), schema))


def find_garbled(df: DataFrame, keys: list[str], text: str, model: Model | None = None) -> DataFrame:
    """`*keys, repaired_text, n_places, n_restored, chains` of the rows with at least one garbled place.

    A row whose `n_restored` equals `n_places` is wholly restored; lost characters (U+FFFD) stay in place otherwise.
    Null, empty and plain ASCII texts are in order; whole texts are read, line by line. Repeated rows come out as
    often as they stand; an empty table gives no rows.
    """
    spark: SparkSession = df.sparkSession
    trained_here = model is None
    load = _sent(spark, model or train_model(df, F.col(text)))
    rows = df.select(*keys, F.col(text).alias("__text")).where(F.col("__text").rlike("[^\\x00-\\x7f]"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = load()
        for pdf in batches:
            got: list[tuple] = []
            for i, t in enumerate(pdf["__text"]):
                parts = [own.repair(x, trained_here and is_clean(x)) if not x.isascii() else (x, 0, 0, set()) for x in t.split("\n")]
                if n := sum(p[1] for p in parts):
                    got.append((i, "\n".join(p[0] for p in parts), n, sum(p[2] for p in parts), ",".join(sorted(set().union(*(p[3] for p in parts))))))
            if got:
                at, fixed, n, restored, chains = zip(*got)
                yield pdf[keys].iloc[list(at)].assign(repaired_text=fixed, n_places=np.array(n, np.int32), n_restored=np.array(restored, np.int32), chains=chains)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return spread(rows).mapInPandas(score, f"{schema}, repaired_text string, n_places int, n_restored int, chains string")
