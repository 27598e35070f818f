from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import numpy as np
from pyspark.sql import functions as F

from textloom.llm import frequency


def brute(records):
    occurrences, held = Counter(), Counter()
    for r in records:
        words = [w for w in r or [] if w is not None]
        occurrences.update(words)
        held.update(set(words))
    return {w: (occurrences[w], held[w]) for w in occurrences}


def test_equals_brute_force(spark):
    pick = random.Random(2)
    records = [[f"w{int(pick.paretovariate(0.6)) % 300}" for _ in range(pick.randint(0, 30))] for _ in range(600)]
    records += [None, [], ["", "", None], [None], ["w1"] * 5000] + [["same", "same"]] * 40
    df = spark.createDataFrame([(i, r, "x", 1) for i, r in enumerate(records)], "id long, words array<string>, term string, records int").repartition(7)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in frequency.term_frequencies(df, F.col("words")).collect()}
    assert got == brute(records)


def test_counters_keep_the_last_record_between_batches():
    c = frequency.LastSeenCounters()
    c.add(pa.array(["a", "b", "a"]), np.array([0, 0, 0]))
    c.add(pa.array(["a", "a"]), np.array([0, 1]))
    c.add(pa.array([], pa.string()), np.array([], np.int64))
    out = c.take().to_pydict()
    assert dict(zip(out["term"], zip(out["occurrences"], out["records"]))) == {"a": (4, 2), "b": (1, 1)}
    assert c.take().num_rows == 0


def test_flush(spark, monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array([[f"t{i}", "t"] for i in range(k, k + 5)])], ["terms"]) for k in range(0, 20, 5)]
    monkeypatch.setattr(frequency, "FLUSH_TERMS", 3)
    total = Counter()
    for b in frequency._count(iter(batches)):
        for t, n in zip(b["term"].to_pylist(), b["records"].to_pylist()):
            total[t] += n
    assert total["t"] == 20 and total["t7"] == 1


def test_marks(spark):
    rows = [["all", f"r{i}"] for i in range(100)] + [["thrice"]] * 3 + [None]
    df = spark.createDataFrame([(r,) for r in rows], "w array<string>")
    got = {r["term_value"]: r["mark"] for r in frequency.marked_frequencies(df, F.col("w"), "word").collect()}
    assert (got["all"], got["r7"], got["thrice"]) == ("too_common", "too_rare", None)
    assert frequency.marked_frequencies(df.limit(0), F.col("w"), "word").count() == 0
    tiny = spark.createDataFrame([(["a"],)], "w array<string>")
    assert frequency.marked_frequencies(tiny, F.col("w"), "word").first()["mark"] == "too_rare"
