"""The plain definition of a one-edit match, written from its description, as the oracle of the tests."""

from __future__ import annotations


def compare(q: str, t: str) -> list[tuple]:
    m = len(q)
    if not q or not t:
        return []
    if len(t) == m:
        if t == q:
            return [("exact", None, m)]
        return [("replacement", i, m - 1) for i in range(m) if q[:i] == t[:i] and q[i + 1 :] == t[i + 1 :]]
    if len(t) == m + 1:
        return [("insertion", i, m) for i in range(m + 1) if t[:i] + t[i + 1 :] == q]
    if len(t) == m - 1:
        return [("deletion", i, m - 1) for i in range(m) if q[:i] + q[i + 1 :] == t]
    return []


def search(queries: list[tuple], sentences: list[tuple]) -> set[tuple]:
    out = set()
    for query_id, q in queries:
        for sentence_id, n in sentences:
            for start in range(len(n or "")):
                for size in (len(q) - 1, len(q), len(q) + 1):
                    if size > 0 and start + size <= len(n):
                        out |= {(query_id, sentence_id, start, *x) for x in compare(q, n[start : start + size])}
    return out
