from __future__ import annotations

import random

import pytest

from textloom.llm import truncation

CUT = {
    "The ledger stores the quiet bri": "open_end", "One whole sentence. And then the": "open_end", "A text that ends with a comma,": "open_end", "It goes on until the relay… [cut]": "mark", "It goes on until the (more)": "mark",
    "Since the release, cursors store…": "ellipsis", "Since the release, cursors st...": "ellipsis", "запись открыва�": "lost_character", "* First entry\nand a line that breaks o": "open_end", "Title\n\n3.": "open_end", "נכתב כאן בלי סו": "open_end",
    "Said Halowa: “We keep the": "open_end", "* An entry that goes on,": "open_end",
}
WHOLE = [
    "A sentence.", "A question?", "She said “yes.”", "He left (quickly).", "One sentence.\n\n-- \nMona Halowa", "One sentence.\n~ Mona", "One sentence.\n[Page 12]", "One.\n* first thing\n* second thing", "One.\n| a | b |", "One.\n\n*** END OF TEXT ***",
    "One.\n(About ledgers)", "One.\nFiled under: alpha, beta, gamma", "One.\n    def f(x):\n        return x + 36", "“Wir kürzen“, sagte Mona.", "One. ", "One.\n\n \n", "", None, "   ", "Ende!",
    *[f"{n}.\nMore to follow…" for n in ("One", "Two", "Three")], *[f"{n}. Well, you know the rest..." for n in ("One", "Two", "Three")],
]


def test_signs(spark):
    texts = [*CUT, *WHOLE]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "id long, text string, source string, sign int")
    got = {texts[r["id"]]: r["sign"] for r in truncation.find_truncated(df, "id", "text", "source").collect()}
    assert got == CUT


def test_stock_remarks_are_learned(spark):
    rows = [f"Sentence {i}.\nDas war noch nicht alles…" for i in range(5)] + ["Another one that goes on…"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    assert [r["id"] for r in truncation.find_truncated(df, "id", "text").collect()] == [5]


def test_copies_of_a_cut_text_are_no_stock_remark(spark):
    rows = ["Since the release, cursors store…"] * 40 + [f"Sentence {i}.\nDas war noch nicht alles…" for i in range(5)] + ["Another one."] * 60
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = truncation.find_truncated(df, "id", "text").collect()
    assert sorted(r["id"] for r in got) == list(range(40)) and {r["sign"] for r in got} == {"ellipsis"}


def test_padding_and_long_lines(spark):
    """Neither blanks at the end nor the length of a line change what its end shows."""
    long = "The archive keeps " + "many quiet words " * 60
    cut = ["The ledger stores the quiet bri" + " " * 700, "The ledger stores the quiet bri" + "\n" * 595, long + "if the relay stores the bri"]
    whole = ["The ledger stores the bridge." + " " * 700, "* An entry of a list" + " \n" * 400, "* An entry " + "of a long list " * 60 + "and its end"]
    df = spark.createDataFrame(list(enumerate(cut + whole)), "id long, text string")
    assert sorted(r["id"] for r in truncation.find_truncated(df, "id", "text").collect()) == [0, 1, 2]


def test_a_remark_is_told_by_how_its_words_go_on(spark):
    """`The...` ends three different texts, but as many last sentences that begin so go on: no remark, at any size."""
    cut = [f"Sentence {i} is here. The..." for i in range(3)]
    whole = [f"Sentence {i} is here. The relay {i} stands." for i in range(4)] + [f"Sentence {i} is here. And that was all..." for i in range(3)]
    for rows in (cut + whole, cut + whole + [f"Another {i}." for i in range(300)], (cut + whole) * 3):
        df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
        assert {rows[r["id"]] for r in truncation.find_truncated(df, "id", "text").collect()} == set(cut)


def test_three_copies_of_a_cut_text_are_all_found(spark):
    for n in (2, 3, 30):
        df = spark.createDataFrame([(i, "One sentence. Because the...") for i in range(n)], "id long, text string")
        assert truncation.find_truncated(df, "id", "text").count() == n


def test_end_signs_alone(spark):
    df = spark.createDataFrame([(1, "Cut he"), (2, "Whole."), (3, "Goes on [cut]"), (4, None), (5, "* entry")], "id long, text string")
    assert {(r["id"], r["sign"]) for r in truncation.end_signs(df, "id", "text").collect()} == {(1, "open_end"), (3, "mark")}


def test_prefixes_equal_brute_force(spark):
    pick = random.Random(11)
    base = ["".join(pick.choice("ab cé") for _ in range(pick.randint(20, 300))).strip() for _ in range(12)]
    texts = base + [b[: pick.randint(1, len(b))] for b in base for _ in range(6)] + [None, "", base[0], "x" * 40_000, "x" * 20_000, "short"]
    stripped = [(t or "").rstrip() for t in texts]
    want = {i for i, a in enumerate(stripped) if len(a) >= truncation.SHORTEST and any(len(b) > len(a) and b.startswith(a) for b in stripped)}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    assert {r["id"] for r in truncation.prefix_of_longer(df, "id", "text").collect()} == want
    want = {i for i, a in enumerate(stripped) if a and any(len(b) > len(a) and b.startswith(a) for b in stripped)}
    assert {r["id"] for r in truncation.prefix_of_longer(df, "id", "text", shortest=1).collect()} == want


def test_prefixes_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(truncation, "BROADCAST_ROWS", 0)
    heading = "A heading that begins a third of all texts. "
    texts = [heading + "x" * i for i in range(120)] + [f"{i} something else altogether" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r["id"] for r in truncation.prefix_of_longer(df, "id", "text").collect()} == set(range(119))


def test_a_longer_copy_shows_a_cut_list(spark):
    whole = "Handling of several ledgers.\n* Notes on headers and footers\n* Notes on drawers"
    df = spark.createDataFrame([(1, whole), (2, whole[:44]), (3, "Handling of several ledgers.")], "id long, text string")
    rows = truncation.find_truncated(df, "id", "text").collect()
    assert [(r["id"], r["sign"], r["has_longer_copy"]) for r in rows] == [(2, "longer_copy", True)]


def test_rates(spark):
    df = spark.createDataFrame([(1, "Cut he", "a"), (2, "Whole.", "a"), (3, "Whole.", None), (4, "cut", None), (5, None, "b")], "id long, text string, source string")
    got = {r["source"]: (r["n_rows"], r["n_truncated"], r["share"]) for r in truncation.truncation_rates(df, "id", "text", "source").collect()}
    assert got == {"a": (2, 1, 0.5), None: (2, 1, 0.5), "b": (1, 0, 0.0)}


@pytest.mark.parametrize("f", [truncation.find_truncated, truncation.prefix_of_longer])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0
