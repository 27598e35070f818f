from __future__ import annotations

import unicodedata

import pytest

from textloom.llm import canonical

SAME = [
    ("gateway", "gаtеwаy"), ("note 610", "ｎｏｔｅ　６１０"), ("after a pause", "after a pause"), ("café", "café"), ("field", "ﬁeld"), ("ledger", "led​ger"),
    ("ledger", "led­g﻿er"), ("Οù", "Où"), ("Å", "Å"), ("K", "K"), ("rôle", "ro​̂le"), ("ÇA", "ÇA"), ("Кurz", "Kurz"), ("tail", "tail  "), ("a b", "a b"),
    ("é", "е́"), ("(x)", "（x）"), ("non‑stop", "non-stop"), ("ab", "a️b"),
]
DIFFERENT = [("a", "A"), ("m²", "m2"), ("cafe", "café"), ("1", "l"), ("a b", "ab"), ("a,", "a"), ("a b", "a  b"), ("naïve", "naive"), ("“a”", '"a"'), ("№ 1", "No 1"), ("½", "1/2"), ("O", "0"), ("ß", "ss")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert canonical.skeleton(a) == canonical.skeleton(b)
    assert canonical.canonical(a) == canonical.canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert canonical.skeleton(a) != canonical.skeleton(b)


def test_mapping_is_stable():
    table = canonical.mapping()
    for code, text in table.items():
        assert canonical.skeleton(chr(code) + "|") == text + "|"
        assert canonical.skeleton(text + "|") == text + "|"
        assert unicodedata.is_normalized("NFC", text)


def test_reading_form_keeps_scripts():
    text = "Как пишет Йоуака, с ключом и рядом"
    assert canonical.canonical(text) == text
    assert canonical.canonical("Kак пишeт") == "Как пишет"
    assert canonical.canonical("Gаtеwаy orders") == "Gateway orders"
    assert canonical.canonical(canonical.canonical("Kак пишeт, а x²")) == canonical.canonical("Kак пишeт, а x²")


def test_pairs(spark):
    rows = [(1, "field"), (2, "ﬁeld"), (3, "field"), (4, "fi​eld"), (5, "other"), (6, None), (7, ""), (8, "​"), (9, "naïve"), (10, "naïve" * 5000), (11, "naïve" * 5000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, __f int")
    got = {tuple(r) for r in canonical.same_look_pairs(df, "id", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4), (10, 11)}
    assert canonical.same_look_pairs(df.limit(0), "id", "text").count() == 0


def test_pairs_equal_brute_force(spark):
    import random

    pick = random.Random(4)
    forms = ["oa", "\u043e\u0430", "\u03bfa", "o\u200ba", "o\u00e4", "oa\u0308", "ob"]
    rows = [(i, "".join(pick.choice(forms) for _ in range(2))) for i in range(150)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and canonical.skeleton(x) == canonical.skeleton(y)}
    got = [tuple(r) for r in canonical.same_look_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_longer_keys_come_first():
    same = [("\u1100\u1161\u11a8", "\uac01"), ("\u1100\u1161", "\uac00"), ("\uac00\u11a8", "\uac01"), ("\u1112\u1161\u11ab\u1100\u1173\u11af", "한글"), ("e\u200b\u0301", "é"), ("ﬁ\u0301", "fí"), ("\u2f00", "一"), ("\U0002f800", "丽"), ("ＡＢé", "ABe\u0301"), ("ᎪᏴ", "AB"), ("ｶﾞ", "ガ"), ("ﾊﾟ", "パ")]
    for a, b in same:
        assert canonical.skeleton(a) == canonical.skeleton(b), (a, b)
        assert canonical.skeleton(canonical.skeleton(a)) == canonical.skeleton(a)


def test_joined_pictures_are_not_their_parts():
    family, parts = "👩\u200d👩\u200d👧", "👩👩👧"
    assert canonical.skeleton(family) == family != canonical.skeleton(parts)
    assert canonical.skeleton("a\u200db") == "ab"


def test_one_pass_equals_the_rules_one_by_one():
    import random
    import unicodedata

    pick = random.Random(5)
    alphabet = "abé \u0301\u0308\u200b\u00a0ﬁＡаеｶﾞ\u3000\u00adöｅ"
    for _ in range(3000):
        text = "a" + "".join(pick.choice(alphabet) for _ in range(9))
        want = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(canonical.mapping())).translate(canonical.mapping()).rstrip(" ")
        assert canonical.skeleton(text) == want, ascii(text)


def test_classes_and_hot_pairs(spark):
    rows = ["a line"] * 60 + ["а line"] * 50 + ["\u200ba line", "other", None, "", "alone"] + ["other"] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(3)
    got = {(r["id"], r["class_id"], r["n_links"]) for r in canonical.same_look_classes(df, "id", "text").collect()}
    assert got == {(i, 0, 51) for i in range(60)} | {(i, 0, 61) for i in range(60, 110)} | {(110, 0, 110)}
    pairs = {(r["id_a"], r["id_b"]) for r in canonical.same_look_pairs(df, "id", "text").collect()}
    assert len(pairs) == 60 * 50 + 110 and all(a < b and rows[a] != rows[b] for a, b in pairs)
    assert canonical.same_look_classes(df.limit(0), "id", "text").count() == 0
