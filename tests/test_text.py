from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from textloom.functions import text as tx


def normalized(t: str) -> str:
    kept = "".join(c for c in t.lower() if not unicodedata.category(c).startswith("P") and c not in "$+<=>^`|~")
    return re.sub(r"\s+", " ", kept).strip(" ")


def test_normalize(spark):
    pick = random.Random(5)
    alphabet = "aBçÉ Straße\t  　 .,;—–¿“”$+<=>^`|~'\"!_-²½№\r\n\x1cДж"
    texts = ["", "   ", "!!!", "OR---NOT", "  First   sentence. ", "Straße", None] + ["".join(pick.choice(alphabet) for _ in range(30)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [None if t is None else normalized(t) for t in texts]


def test_word_positions(spark):
    rows = spark.createDataFrame([("this is a test",), ("",), ("one",), (None,), ("é " * 400 + "z",)], "n string").select(tx.word_positions(F.col("n")).alias("w")).collect()
    assert [tuple(x)[1:] for x in rows[0]["w"]] == [(0, 4), (5, 7), (8, 9), (10, 14)]
    assert rows[1]["w"] == [] and rows[3]["w"] is None
    assert tuple(rows[2]["w"][0]) == ("one", 0, 3)
    assert tuple(rows[4]["w"][-1]) == ("z", 800, 801)


def test_grams(spark):
    rows = spark.createDataFrame([("a😀bc",), ("ab",), ("",), (None,)], "n string").select(tx.grams(F.col("n"), 3).alias("g")).collect()
    assert [tuple(x) for x in rows[0]["g"]] == [("a😀b", 0), ("😀bc", 1)]
    assert [r["g"] for r in rows[1:]] == [[], [], []]


def test_buckets(spark):
    rows = spark.range(0, 30).select("id", tx.length_bucket(F.col("id")).alias("l"), tx.result_bucket(F.col("id")).alias("r")).collect()
    assert [rows[i]["l"] for i in (1, 6, 7, 8, 9, 12, 13, 20, 21, 29)] == ["1", "6", "7-8", "7-8", "9-12", "9-12", "13-20", "13-20", "21+", "21+"]
    assert [rows[i]["r"] for i in (0, 1, 5, 6, 20, 21)] == ["0", "1-5", "1-5", "6-20", "6-20", "21-100"]


def test_repeats(spark):
    words = ["aabc", "abcab", "abc", "", "ledger", "letter", "banana"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").where(tx.has_repeats(F.col("w"))).collect()
    assert [r["w"] for r in rows] == [w for w in words if re.search(r"(.)\1|(.{2,}).*\2", w)]


def test_mutations(spark):
    row = spark.createDataFrame([("maxim", 2), ("stream", 2)], "w string, i int").select(tx.mutations(F.col("w"), F.col("i")).alias("m")).collect()
    assert [[x["text"] for x in r["m"]] for r in row] == [["mazim", "maim", "maxxim"], ["stxeam", "steam", "stxream"]]
