"""One-edit matches of a table of queries in batches of texts, worked out in the task that reads the texts: no match is shuffled to be found.

A query is split at two places `a <= b`: with p the common prefix of the query and what stands at a start, either
p >= a, so the head `q[:a]` stands there whole, or the edit lies before a, so the tail `q[b:]` stands whole at its place
or one off. A start with its head is found at its head alone, another one at its tail alone, so every match is found
once. Where a head or a tail may stand is read from the sorted grams of a batch, or every start is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KINDS = ("exact", "replacement", "insertion", "deletion")
#: Rows that a task hands on at once.
ROWS = 100_000
#: Starts over which a run of stored postings is sorted.
RUN = 1 << 20


class Split(NamedTuple):
    """How one query is looked up: its text, the end of its head and the begin of its tail, and in each the gram that is looked up."""

    q: str
    a: int
    b: int
    head: tuple[int, int] = (0, 0)
    tail: tuple[int, int] = (0, 0)


def halves(q: str) -> Split:
    """Both halves; a query of one character has no head, so all starts are tried."""
    half = len(q) // 2
    return Split(q, half, half, (0, half), (half, len(q) - half))


def ends(q: str, size: int) -> Split:
    """The first and the last gram."""
    last = len(q) - size
    return Split(q, size, last, (0, size), (last, size))


def anchors(q: str, size: int, first: int, second: int) -> Split:
    """Two windows that don't overlap."""
    return Split(q, first + size, second, (first, size), (second, size))


class Asked(NamedTuple):
    """A query in the codes of its alphabet, and where the run of equal characters begins that each of its characters is in."""

    codes: np.ndarray
    run: np.ndarray
    split: Split


class Found(NamedTuple):
    """Matches of one query: row of the text, start in the text, kind, and the range of slots."""

    row: np.ndarray
    start: np.ndarray
    kind: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Matcher:
    """The queries `splits`, ready to meet batches of texts."""

    def __init__(self, splits: list[Split], indexed: bool) -> None:
        self.indexed = indexed
        points = np.unique(np.frombuffer("".join(s.q for s in splits).encode("utf-32-le"), np.uint32))
        # 0 stands between texts, 1 for characters of no query
        self.kind = np.uint8 if len(points) < 254 else np.uint16 if len(points) < 65_534 else np.uint32
        self.grams = 2 if self.kind is np.uint32 else 4
        self.wide = np.uint32 if self.kind is np.uint8 else np.uint64
        self.bits = 8 * np.dtype(self.kind).itemsize
        self.table = np.ones(0x110000, self.kind)
        self.table[points] = np.arange(2, len(points) + 2)
        self.asked = [self._asked(s) for s in splits]
        self.pad = max((len(s.q) for s in splits), default=0) + 4
        self.low, self.high = (np.array(x, self.wide).reshape(-1, 2) for x in zip(*(self._ranges(x) for x in self.asked))) if splits else (np.zeros((0, 2), self.wide),) * 2

    def _asked(self, split: Split) -> Asked:
        codes = self.table[np.frombuffer(split.q.encode("utf-32-le"), np.uint32)]
        begins = np.r_[True, codes[1:] != codes[:-1]]
        return Asked(codes, np.maximum.accumulate(np.where(begins, np.arange(len(codes)), 0)).astype(np.int32), split)

    def _ranges(self, x: Asked) -> tuple[list[int], list[int]]:
        """Least and greatest packed gram that begins as the looked-up gram of the head, and of the tail."""
        low, high = [], []
        for at, size in (x.split.head, x.split.tail):
            size = min(size, self.grams)
            packed = 0
            for c in x.codes[at : at + size]:
                packed = packed << self.bits | int(c)
            free = self.bits * (self.grams - size)
            low.append(packed << free)
            high.append((packed << free) | ((1 << free) - 1))
        return low, high

    def found(self, texts: pa.Array, starts: np.ndarray | None = None) -> Iterator[tuple[int, Found]]:
        """Number and matches of each query that has any; only the first `starts` places of each text count, if given."""
        t = _Texts(self, texts, starts)
        if self.indexed:
            order = np.argsort(t.packed)
            packed = t.packed[order]
            lower, upper = np.searchsorted(packed, self.low, "left"), np.searchsorted(packed, self.high, "right")
        for i, x in enumerate(self.asked):
            if self.indexed:
                heads, tails = (order[lower[i, k] : upper[i, k]] for k in (0, 1))
            else:
                heads, tails = (self._places(t, k, self.low[i, k], side[1]) for k, side in enumerate((x.split.head, x.split.tail)))
            if not x.split.a:
                parts = [self._at_heads(t, x, t.all_starts())]
            else:
                parts = [self._at_heads(t, x, heads), *self._at_tails(t, x, tails)]
            whole = Found(*(np.concatenate(c) for c in zip(*parts)))
            if len(whole.row):
                yield i, whole

    def _places(self, t: _Texts, side: int, low: int, size: int) -> np.ndarray:
        size = min(size, self.grams)
        if not size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(t.prefixes(size) == (low >> self.wide(self.bits * (self.grams - size))))

    def _at_heads(self, t: _Texts, x: Asked, hits: np.ndarray) -> Found:
        """Matches at the starts at which the head stands whole."""
        q, m, (a, at) = x.codes, len(x.codes), (x.split.a, x.split.head[0])
        start = hits - at
        if a:
            for j in range(a):
                if not at <= j < at + min(x.split.head[1], self.grams):
                    start = start[t.codes[start + j] == q[j]]
        if a and a + 1 < m:  # the next character is right, or an edit is there
            c, d = t.codes[start + a], t.codes[start + a + 1]
            start = start[(c == q[a]) | (c == q[a + 1]) | (d == q[a + 1]) | (d == q[a])]
        row = t.row[start]
        inside = start - t.begin[row] < t.starts[row]
        start, row = start[inside], row[inside]
        rest = t.end[row] - start
        near = t.codes[np.arange(a, m + 1)[:, None] + start]
        same, later = near[:-1] == q[a:, None], near[1:] == q[a:, None]
        p = a + _leading(same)
        exact = p >= m
        replaced = (p < m) & (rest >= m) & (p + 1 + _trailing(same) >= m)
        inserted = (rest > m) & (p + _trailing(later) >= m)
        d = np.minimum(p, m - 1)
        deleted = (rest >= m - 1) & (d + 1 + _trailing(near[: m - 1 - a] == q[a + 1 :, None]) >= m) if m > 1 else np.zeros(len(p), bool)
        slot = self._first_slot(t, x, start, p)
        zero = np.zeros(len(p), np.int32)
        return _stacked(t, ((0, exact, start, row, zero, zero), (1, replaced, start, row, p, p), (2, inserted, start, row, slot, p), (3, deleted, start, row, x.run[d], d)))

    def _at_tails(self, t: _Texts, x: Asked, hits: np.ndarray) -> list[Found]:
        """Matches at the starts at which the head doesn't stand, by the tail at its place, one later, or one earlier."""
        q, m, (a, b, at, size) = x.codes, len(x.codes), (x.split.a, x.split.b, *x.split.tail)
        place = hits - (at - b)
        for j in range(b, m):
            if not at <= j < at + min(size, self.grams):
                place = place[t.codes[place + j - b] == q[j]]
        if b > 1:
            c, d = t.codes[place - 1], t.codes[place - 2]
            place = place[(c == q[b - 1]) | (c == q[b - 2]) | (d == q[b - 2]) | (d == q[b - 1])]
        row = t.row[place]
        near = t.codes[np.arange(-b - 1, 1)[:, None] + place]
        head = q[:b, None]
        same = near[1 : b + 1] == head
        behind = _trailing(same)
        out = []
        for kind, shift, least in ((1, 0, 1), (2, -1, 0), (3, 1, 1)):
            start = place - b + shift
            p = _leading(near[1 + shift : b + 1 + shift] == head)
            ok = (p < a) & (p + least + behind >= b) & (start >= t.begin[row]) & (start - t.begin[row] < t.starts[row])
            s, r, p = start[ok], row[ok], p[ok]
            low = p if kind == 1 else self._first_slot(t, x, s, p) if kind == 2 else x.run[p]
            out.append(_stacked(t, ((kind, np.ones(len(s), bool), s, r, low, p),)))
        return out

    @staticmethod
    def _first_slot(t: _Texts, x: Asked, start: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Where the run begins of the character at p, as an insertion at any place of the run reads alike."""
        before = np.maximum(p - 1, 0)
        return np.where((p > 0) & (t.codes[start + p] == x.codes[before]), x.run[before], p)


class _Texts:
    """The characters of a batch of texts in one array, with the row and the borders of each text."""

    def __init__(self, m: Matcher, texts: pa.Array, starts: np.ndarray | None) -> None:
        self.matcher = m
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(size)
        self.begin = m.pad + np.r_[0, np.cumsum(size + 1)[:-1]] if n else np.zeros(0, np.int64)
        self.end = self.begin + size
        self.starts = size if starts is None else starts
        total = int(self.end[-1]) + 1 if n else m.pad
        self.codes = np.zeros(total + m.pad, m.kind)
        self.row = np.zeros(total + m.pad, np.int32)
        number = np.repeat(np.arange(n, dtype=np.int32), size)
        self.places = np.arange(len(number)) + m.pad + number
        self.codes[self.places] = m.table[np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)]
        self.row[self.places] = number
        packed = self.codes.astype(m.wide)
        for j in range(1, m.grams):
            packed = packed << m.wide(m.bits) | np.r_[self.codes[j:], np.zeros(j, m.kind)]
        self.packed, self._prefixes = packed, {m.grams: packed}

    def prefixes(self, size: int) -> np.ndarray:
        if size not in self._prefixes:
            self._prefixes[size] = self.packed >> self.matcher.wide(self.matcher.bits * (self.matcher.grams - size))
        return self._prefixes[size]

    def all_starts(self) -> np.ndarray:
        return self.places


def _leading(same: np.ndarray) -> np.ndarray:
    """Per column the number of true rows at the top."""
    return np.logical_and.accumulate(same, axis=0).sum(axis=0, dtype=np.int32)


def _trailing(same: np.ndarray) -> np.ndarray:
    return _leading(same[::-1])


def _stacked(t: _Texts, parts: tuple) -> Found:
    """`parts`: kind, which, start, row, low, high."""
    rows, starts, kinds, lows, highs = [], [], [], [], []
    for kind, which, start, row, low, high in parts:
        r = row[which]
        rows.append(r)
        starts.append(start[which] - t.begin[r])
        kinds.append(np.full(len(r), kind, np.int8))
        lows.append(low[which])
        highs.append(high[which])
    return Found(*(np.concatenate(c) for c in (rows, starts, kinds, lows, highs)))


def _limited(parts: Iterator[tuple[np.ndarray, ...]], make: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of about ROWS rows, made of the columns of many queries."""
    held: list[tuple] = []
    n = 0
    for part in parts:
        for at in range(0, len(part[0]), ROWS):
            piece = tuple(c[at : at + ROWS] for c in part)
            held.append(piece)
            n += len(piece[0])
            if n >= ROWS:
                yield make(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
    if held:
        yield make(*(np.concatenate(c) for c in zip(*held)))


def grouped(matcher: Matcher, ids: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All matches, those of one query, kind and slot in lists: `query_id, edit_type, edit_index, correct_characters, sentence_ids, match_starts`, from `sentence_id, at, text, starts`.

    A list is much less to hand on than its rows, and has at most ROWS matches.
    """
    kinds = pa.array(KINDS)
    length = np.array([len(x.codes) for x in matcher.asked], np.int32)
    for batch in batches:
        sentence_id, at = batch.column("sentence_id"), batch.column("at").to_numpy()

        def made(held: list[tuple], sentence_id=sentence_id, at=at) -> pa.RecordBatch:
            i, kind, slot, size, row, start = (np.concatenate(c) for c in zip(*held))
            offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            correct = length[i] - ((kind == 1) | (kind == 3)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(offsets, x) for x in (sentence_id.take(pa.array(row)), pa.array((at[row] + start).astype(np.int32))))
            columns = [ids.take(pa.array(i)), kinds.take(pa.array(kind)), pa.array(slot.astype(np.int32), mask=kind == 0), pa.array(correct), *lists]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "edit_type", "edit_index", "correct_characters", "sentence_ids", "match_starts"])

        held: list[tuple] = []
        n = 0
        for i, f in matcher.found(batch.column("text"), batch.column("starts").to_numpy()):
            slots = f.high - f.low + 1
            row, start, kind, slot = f.row, f.start, f.kind, f.low
            if slots.max() > 1:
                each = np.repeat(np.arange(len(slots)), slots)
                slot = slot[each] + np.arange(len(each)) - np.repeat(np.cumsum(slots) - slots, slots)
                row, start, kind = row[each], start[each], kind[each]
            width = int(length[i]) + 1
            key = (kind.astype(np.int64) * width + slot).astype(np.uint16 if 4 * width < 1 << 16 else np.int64)
            order = np.argsort(key, kind="stable")
            for k in range(0, len(order), ROWS):
                piece = order[k : k + ROWS]
                own = key[piece]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                held.append((np.full(len(first), i, np.int32), (own[first] // width).astype(np.int8), own[first] % width, np.diff(np.r_[first, len(own)]), row[piece], start[piece]))
                n += len(piece)
                if n >= ROWS:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)


def listed(matcher: Matcher, ids: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `grouped`: `query_id, sentence_id, match_start, edit_type, edit_index, correct_characters`."""
    for lists in grouped(matcher, ids, batches):
        ids_, starts = lists.column("sentence_ids"), lists.column("match_starts")
        of = pc.list_parent_indices(ids_)
        columns = [lists.column("query_id").take(of), ids_.flatten(), starts.flatten(), *(lists.column(c).take(of) for c in ("edit_type", "edit_index", "correct_characters"))]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "sentence_id", "match_start", "edit_type", "edit_index", "correct_characters"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut between groups, of which each begins at a row with `fresh`, with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("fresh").to_numpy(zero_copy_only=False))
        if not len(begins):
            held.append(batch)
            continue
        yield from _numbered([*held, batch.slice(0, begins[-1])])
        held = [batch.slice(begins[-1])]
    yield from _numbered(held)


def _numbered(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    if sum(p.num_rows for p in parts):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]
        yield whole, np.cumsum(whole.column("fresh").to_numpy(zero_copy_only=False)) - 1


def kinds_of(matcher: Matcher, ids: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`query_id, edit_type, matches, n_sentences` of the groups of each batch; groups without a sentence_id count no sentence."""
    for batch, group in _whole_groups(batches):
        known = batch.column("sentence_id").is_valid().to_numpy(zero_copy_only=False)
        rows = []
        for i, f in matcher.found(batch.column("text"), batch.column("starts").to_numpy()):
            for kind in np.unique(f.kind):
                own = f.kind == kind
                seen = f.row[own]
                rows.append((i, KINDS[kind], int((f.high[own] - f.low[own] + 1).sum()), len(np.unique(group[seen[known[seen]]]))))
        if rows:
            i, kind, n, n_sentences = zip(*rows)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(kind), pa.array(n, pa.int64()), pa.array(n_sentences, pa.int64())], ["query_id", "edit_type", "matches", "n_sentences"])


def best_of(matcher: Matcher, ids: pa.Array, k: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`query_id, completed_sentence, source_text, line_no, score, sentence_id` of each query and group; with `k`, of the k best of a batch.

    A group is a record, its first row has the text, the source and the line, and its rows are in the order of their ids.
    """
    names = ["completed_sentence", "source_text", "line_no"]
    length = np.array([len(x.codes) for x in matcher.asked], np.int32)
    for batch, group in _whole_groups(batches):
        first = np.flatnonzero(batch.column("fresh").to_numpy(zero_copy_only=False))
        records = [batch.column(c).take(pa.array(first)) for c in names]
        sentence_id = batch.column("sentence_id")
        if k:
            texts = records[0].to_pylist()
            order = sorted(range(len(first)), key=lambda g: (texts[g] is not None, texts[g] or ""))
            # equal texts tie by the id that was matched, so they share a place
            place = np.zeros(len(first), np.int64)
            place[order] = np.cumsum([j > 0 and texts[g] != texts[order[j - 1]] for j, g in enumerate(order)])

        def parts(batch=batch, group=group, first=first, place=place if k else None, sentence_id=sentence_id) -> Iterator[tuple]:
            for i, f in matcher.found(batch.column("text"), batch.column("starts").to_numpy()):
                at = np.minimum(f.high, 4)
                score = 2 * (length[i] - ((f.kind == 1) | (f.kind == 3))) + np.choose(f.kind, [0, at - 5, 2 * at - 10, 2 * at - 10])
                best = np.full(len(first), np.iinfo(np.int32).min, np.int32)
                np.maximum.at(best, group[f.row], score.astype(np.int32))
                least = np.full(len(first), len(group), np.int64)
                np.minimum.at(least, group[f.row], f.row)
                g = np.flatnonzero(least < len(group))
                if k and len(g) > k:
                    key = -best[g].astype(np.int64) * (len(first) + 1) + place[g]
                    g = g[key <= np.partition(key, k - 1)[k - 1]]
                    if len(g) > k:
                        g = g[np.lexsort((sentence_id.take(pa.array(least[g])).to_numpy(), place[g], -best[g]))[:k]]
                yield np.full(len(g), i, np.int32), g, best[g], least[g]

        def made(i, g, score, row, records=records, sentence_id=sentence_id) -> pa.RecordBatch:
            columns = [ids.take(pa.array(i)), *(c.take(pa.array(g)) for c in records), pa.array(score), sentence_id.take(pa.array(row))]
            return pa.RecordBatch.from_arrays(columns, ["query_id", *names, "score", "sentence_id"])

        yield from _limited(parts(), made)


def starts_of(matcher: Matcher, ids: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`query_id, candidate_count, calls`: the starts within one of where a looked-up gram says, and their slices of one character less, as many, and one more."""
    for batch in batches:
        t = _Texts(matcher, batch.column("text"), None)
        order = np.argsort(t.packed)
        packed = t.packed[order]
        lower, upper = np.searchsorted(packed, matcher.low, "left"), np.searchsorted(packed, matcher.high, "right")
        rows = []
        for i, x in enumerate(matcher.asked):
            m, near = len(x.codes), np.zeros(len(t.codes), bool)
            for side, (at, _) in enumerate((x.split.head, x.split.tail)):
                hits = order[lower[i, side] : upper[i, side]]
                for shift in (-1, 0, 1):
                    start = hits - at + shift
                    near[start[(start >= t.begin[t.row[hits]]) & (start < t.end[t.row[hits]])]] = True
            start = np.flatnonzero(near)
            rest = t.end[t.row[start]] - start
            fits = [int((rest >= size).sum()) for size in (m - 1, m, m + 1) if size > 0]
            if fits[0]:
                rows.append((i, fits[0], sum(fits)))
        if rows:
            i, n, calls = zip(*rows)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(n, pa.int64()), pa.array(calls, pa.int64())], ["query_id", "candidate_count", "calls"])


def runs(longest: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`tail, n, sentence_ids, positions`: starts by the up to `longest` characters that stand there, from `sentence_id, at, text, starts`.

    Runs of about RUN starts, each sorted by tail, sentence and position; tails of less than `least` characters are left out.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += pc.sum(batch.column("starts")).as_py() or 0
        if n >= RUN:
            yield _run(longest, least, held)
            held, n = [], 0
    if n:
        yield _run(longest, least, held)


def _run(longest: int, least: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).sort_by([("sentence_id", "ascending"), ("at", "ascending")]).combine_chunks()
    sentence_id, texts = whole["sentence_id"].combine_chunks(), whole["text"].combine_chunks()
    at, starts = whole["at"].to_numpy(), whole["starts"].to_numpy()
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(texts.to_pylist())
    letters, code = np.unique(np.frombuffer(joined.encode("utf-32-le"), np.uint32), return_inverse=True)
    code = np.r_[code + 1, np.zeros(longest, np.int64)]
    row = np.repeat(np.arange(len(size), dtype=np.int32), starts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    rest = size[row] - offset
    row, offset, rest = (x[rest >= least] for x in (row, offset, rest))
    place = (np.cumsum(size) - size)[row] + offset
    key, most, base = code[place], len(letters), len(letters) + 1
    for j in range(1, longest):
        if most >= np.iinfo(np.int64).max // base - 1:  # only the order of the keys counts
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max(initial=0))
        key = key * base + np.where(rest > j, code[place + j], 0)
        most = most * base + base
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[first, len(key)], pa.int32())
    tails = [joined[p : p + n] for p, n in zip(place[order[first]].tolist(), np.minimum(rest[order[first]], longest).tolist())]
    row, offset = row[order], offset[order]
    lists = (pa.ListArray.from_arrays(offsets, x) for x in (sentence_id.take(pa.array(row)), pa.array((at[row] + offset).astype(np.int32))))
    return pa.RecordBatch.from_arrays([pa.array(tails, pa.string()), pa.array(np.diff(np.r_[first, len(key)]), pa.int32()), *lists], ["tail", "n", "sentence_ids", "positions"])
