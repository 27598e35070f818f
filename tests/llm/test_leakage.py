from __future__ import annotations

import random

import pytest

from textloom.llm import leakage


def distance(pattern, text):
    """Least edits that turn `pattern` into a part of `text`."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    pick = random.Random(9)
    for _ in range(400):
        a = [pick.choice("abc") for _ in range(pick.randint(1, 80))]
        b = [pick.choice("abc") for _ in range(pick.randint(0, 60))]
        assert leakage.myers(a, b)[0] == distance(a, b)


WORDS = [f"word{i}" for i in range(400)]


def corpus(seed):
    pick = random.Random(seed)
    items = [(i, " ".join(pick.choice(WORDS) for _ in range(pick.randint(5, 60)))) for i in range(20)]
    docs = []
    for d in range(60):
        words = [pick.choice(WORDS) for _ in range(pick.randint(0, 80))]
        if d % 2:
            own = pick.choice(items)[1].split()
            at, size = pick.randint(0, max(0, len(own) - 12)), pick.randint(8, 30)
            part = own[at : at + size]
            for _ in range(pick.randint(0, 2)):
                k = pick.randrange(len(part))
                part = pick.choice([part[:k] + ["changed"] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + ["extra"] + part[k:]]) or ["x"]
            words = words[:20] + part + words[20:]
        docs.append((d, " ".join(words)))
    return items, docs


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_equals_brute_force(spark, budget):
    items, docs = corpus(budget)
    want = set()
    for d, text in docs:
        w = text.split()
        for i, item in items:
            own = item.split()
            if any(distance(own[k : k + 12], w) <= budget for k in range(len(own) - 11)):
                want.add((d, i))
    q = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, distance int").repartition(3)
    rows = leakage.find_leaks(df, "doc_id", "text", q, "item_id", "text", 12, budget).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)


def test_exact_run_after_a_broken_one(spark):
    own = [f"w{i}" for i in range(40)]
    text = " ".join([*own[:8], "x", *own[9:30]])
    got = leakage.Items([(1, " ".join(own))], 12, 0).leaks(text)
    assert got[0][:3] == (1, 21, 0)


def test_altered_dress(spark):
    item = "Où la lumière prévue, “préfère” déjà vérifier les clés de la forêt très tôt"
    dressed = "> OÙ LA LUMIÈRE PRÉVUE préfère -\n  déjа̀ vérifier les clés\n> de ｌａ forêt, très tôt!"
    q = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (5, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, dressed), (2, None), (3, ""), (4, "x " * 60_000 + dressed), (4, dressed)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, "doc_id", "text", q, "item_id", "text").where("run_words >= 12").collect())
    assert got == [(1, 1), (1, 4), (4, 1), (4, 1), (4, 4), (4, 4)]
    assert leakage.find_leaks(docs.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0
    assert leakage.find_leaks(docs, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0


def test_blocks(spark, monkeypatch):
    items, docs = corpus(1)
    q, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    one = {tuple(r) for r in leakage.find_leaks(df, "doc_id", "text", q, "item_id", "text").collect()}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 2000)
    assert {tuple(r) for r in leakage.find_leaks(df, "doc_id", "text", q, "item_id", "text").collect()} == one
