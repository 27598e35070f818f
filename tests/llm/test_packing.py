from __future__ import annotations

import os
import random

import numpy as np
import pytest

from textloom.llm import packing


def test_assignment():
    pick = np.random.default_rng(1)
    lengths = np.sort(pick.integers(1, 1000, 3000))[::-1]
    where = packing.assign(lengths, 2048)
    load = np.bincount(where, lengths)
    assert load.max() <= 2048 and len(load) <= 1.02 * -(-lengths.sum() // 2048)
    cost = np.bincount(where, lengths + lengths.astype(float) ** 2 / 4096)
    assert cost.max() <= 1.6 * cost.mean()
    assert len(packing.assign(np.array([], np.int64), 10)) == 0
    assert len(set(packing.assign(np.array([6, 6, 6]), 10))) == 3


def test_every_token_once(spark):
    pick = random.Random(6)
    sizes = [(i, pick.choice([0, 1, 5, 63, 64, 65, 128, 1000, None])) for i in range(500)] + [(7, 10), (7, 10)]
    df = spark.createDataFrame([(*s, 1) for s in sizes], "doc long, n long, piece int")
    packed = packing.pack_texts(df, "doc", "n", 64, shard_tokens=5000)
    rows = packed.collect()
    sequences, tokens = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        tokens.setdefault(r["doc"], []).append(r)
    assert all(sum(r["n_tokens"] for r in s) <= 64 and sorted(r["slot"] for r in s) == list(range(len(s))) for s in sequences.values())
    for doc, n in sizes[:500]:
        if doc != 7 and n:
            mine = sorted(tokens[doc], key=lambda r: r["piece"])
            assert sum(r["n_tokens"] for r in mine) == n and [r["token_start"] for r in mine] == list(range(0, n, 64))
            assert n > 64 or len(mine) == 1
    assert set(tokens) == {d for d, n in sizes if n}
    report = packing.sequence_report(packed, 64).first()
    assert report["fill"] > 0.9 and report["n_pieces"] == len(rows) and report["max_tokens"] <= 64


def test_empty(spark):
    df = spark.createDataFrame([], "doc long, n long")
    packed = packing.pack_texts(df, "doc", "n")
    assert packed.count() == 0 and packing.sequence_report(packed).first()["n_sequences"] == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary here")
def test_counts_are_the_tokenizers(spark):
    import tiktoken  # noqa: F401

    size = packing.counter(packing.TOKENIZER)
    texts = ["", None, "hello world", "Für <|endoftext|>", "слово " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert {r["id"]: r["n_tokens"] for r in packing.token_counts(df, "id", "t").collect()} == {i: size(t) if t else 0 for i, t in enumerate(texts)}
    assert packing.pack_documents(df, "id", "t", 16).agg({"n_tokens": "sum"}).first()[0] == sum(size(t) for t in texts if t)
