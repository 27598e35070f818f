from __future__ import annotations

import random

import pytest

from textloom.llm import encoding

WORDS = {
    "de": "Für Löffel Schlüssel Prüfer öffnen größere Wächter Kanäle über Straße hören spät früh gehören schließen Gärtner zählen stören nächste".split(),
    "fr": "préfère vérifier réseaux même sans témoin légère forêt fenêtre élève déjà très tôt près complète lumière rangée entrées où ÂGE RÔLE".split(),
    "es": "después página señal versión razón montaña difícil ¡Qué búsqueda según línea conexión mañana está también aquí había".split(),
    "pt": "função sessão amanhã até canções região ligação não próxima ATENÇÃO também então".split(),
    "ru": "Нельзя хранить разделы после паузы ключи проверяет список журнал открывать сервер маяки снова завтра Когда поток читает".split(),
    "he": "הספר בודק מפתחות אחרי הפסקה רשומות לפתוח סימנים ללא הודעה הגשר שומר קבצים".split(),
}
PLAIN = "the archive stores a quiet “window” once per hour, it’s 12 m² – café × 3 naïve €5".split()
CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1250")]


def lines(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        own = WORDS[pick.choice(list(WORDS))]
        out.append(" ".join(pick.choice(own if pick.random() < 0.6 else PLAIN) for _ in range(9)))
    return out


@pytest.fixture(scope="module")
def model():
    return encoding.Model.of(lines(1, 3000))


def test_clean_lines_stay(model):
    held_out = lines(2, 1500)
    wrong = [x for x in held_out if model.repair(x)[1]]
    assert len(wrong) <= 0.002 * len(held_out), wrong[:5]


@pytest.mark.parametrize("right,wrong", CHAINS)
def test_garbled_lines_are_found_and_restored(model, right, wrong):
    found = restored = n = 0
    for line in lines(3, 400):
        try:
            bad = line.encode(right).decode(wrong)
        except UnicodeDecodeError:
            continue
        if bad == line:
            continue
        n += 1
        got = model.repair(bad)
        found += got[1] > 0
        restored += got[0] == line
    assert n > 50 and found >= 0.99 * n and restored >= 0.95 * n, (n, found, restored)


def test_twice_garbled(model):
    line = "Nachdem der Prüfer den Schlüssel fand"
    bad = line.encode().decode("cp1252").encode().decode("cp1252")
    assert model.repair(bad)[0] == line


@pytest.mark.parametrize("language,wrong", [("de", "cp850"), ("es", "cp850"), ("fr", "cp850")])
def test_single_byte_confusion(model, language, wrong):
    n = found = 0
    for line in (" ".join(random.Random(i).choice(WORDS[language]) for _ in range(6)) for i in range(200)):
        bad = line.encode("cp1252").decode(wrong)
        if bad != line:
            n += 1
            found += model.repair(bad)[1] > 0
    assert found >= 0.9 * n


def test_a_place_in_an_orderly_line(model):
    assert model.repair("après la forêt, il vÃ©rifie déjà")[0] == "après la forêt, il vérifie déjà"


def test_table(spark, model):
    rows = [("t", 1, "Für die Prüfer"), ("t", 2, "FÃ¼r die PrÃ¼fer"), ("t", 3, None), ("t", 4, ""), ("t", 5, "caf� near"), ("u", 2, "plain\nFÃ¼r\nFür"), ("t", 6, "x\x85y"), ("t", 7, "gаteway"), ("t", 8, "é" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "table_name string, record_id long, text string, chains int")
    got = {(r["table_name"], r["record_id"]): r for r in encoding.find_garbled(df, ["table_name", "record_id"], "text", model).collect()}
    assert set(got) == {("t", 2), ("t", 5), ("u", 2), ("t", 6)}
    assert got["t", 2]["repaired_text"] == "Für die Prüfer" and got["t", 2]["n_places"] == got["t", 2]["n_restored"] == 2
    assert got["t", 5]["n_restored"] == 0
    assert got["u", 2]["repaired_text"] == "plain\nFür\nFür"
    assert encoding.find_garbled(df.limit(0), ["table_name", "record_id"], "text").count() == 0


def test_trained_on_a_table(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines(5, 800) + ["FÃ¼r die PrÃ¼fer"])], "id long, text string").repartition(3)
    assert [r["id"] for r in encoding.find_garbled(df, ["id"], "text").collect()] == [800]


def test_copies_of_a_garbled_line_are_found(spark):
    bad = "für den Schlüssel über größere Kanäle".encode("cp1252").decode("cp850")
    clean = lines(5, 800)
    df = spark.createDataFrame(list(enumerate([*clean, *[bad] * 400, "один " + "Нельзя хранить".encode("koi8-r").decode("cp1251")])), "id long, text string").repartition(3)
    got = {r["id"] for r in encoding.find_garbled(df, ["id"], "text").collect()}
    assert set(range(800, 1200)) <= got and len([i for i in got if i < 800]) <= 2


@pytest.mark.parametrize(
    "text,steps",
    [
        ("Schlüssel", [("utf-8", "cp1252"), ("cp1252", "cp437")]), ("Schlüssel", [("cp1252", "cp850"), ("utf-8", "cp1252")]),
        ("ключи", [("utf-8", "koi8-r")]), ("ключи", [("cp1251", "iso8859-5")]), ("הספר", [("utf-8", "cp1255")]), ("中文", [("gbk", "latin-1")]), ("中文", [("big5", "cp437")]),
        ("é", [("utf-8", "gbk")]), ("😀", [("utf-8", "latin-1")]), ("ü", [("utf-8", "cp1252")] * 3),
    ],
)
def test_every_chain_is_a_candidate(text, steps):
    run = text
    for right, wrong in steps:
        run = run.encode(right).decode(wrong)
    held = encoding.Model.of([f"{text} {x}" for x in ("ist", "war")] + ["x"])
    ascii_out = "".join(c for c in text if not c.isascii())
    pieces = [c for r in encoding._RUN.findall(run) for c, _ in held.candidates(r)]
    assert ascii_out in pieces or text in pieces


def test_margin_is_validated_on_words_that_the_training_lines_lack():
    """Half of the words of each language train, the other half is judged, clean and garbled by every chain."""
    pick = random.Random(4)
    split = {k: (w[::2], w[1::2]) for k, w in WORDS.items()}
    build = lambda half, n: [" ".join(pick.choice(split[k][half]) for _ in range(6)) for k in split for _ in range(n)]
    training, held_out = build(0, 300), build(1, 40)
    assert not {w for x in training for w in x.split()} & {w for x in held_out for w in x.split()}
    chains = [*CHAINS, ("cp1252", "cp850"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1255", "cp1252"), ("cp1251", "cp1252")]
    errors = {m: (touched, missed) for m, touched, missed in encoding.margin_errors(training, held_out, chains, [1.0, encoding.MARGIN, 12.0])}
    touched, missed = errors[encoding.MARGIN]
    assert touched <= 0.02 and missed <= 0.35, errors
    assert errors[12.0][1] >= missed and errors[1.0][0] >= touched


def test_a_single_byte_garbled_line_holds_a_third_of_the_rows(spark):
    bad = "Schlüssel für größere Kanäle über Löffel".encode("cp1252").decode("cp850")
    rows = [*lines(5, 800), *[bad] * 400]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(3)
    got = [r for r in encoding.find_garbled(df, ["id"], "text").collect()]
    assert set(range(800, 1200)) <= {r["id"] for r in got} and len(got) <= 402
    assert {r["repaired_text"] for r in got if r["id"] >= 800} == {"Schlüssel für größere Kanäle über Löffel"}


def test_new_characters_of_a_whole_utf8_run(model):
    assert model.repair("done " + "😀".encode().decode("latin-1"))[0] == "done 😀"


def test_counts_are_of_lines():
    counts = encoding.count_ngrams(["éé éé", "é", "ab"])
    assert counts[1][encoding._bucket((ord("é"),))] == 2 and counts[2][encoding._bucket((ord("é"), ord("é")))] == 1


def test_hashes_agree():
    text = "aé�😀b"
    for n in encoding.BITS:
        assert encoding._hashes(encoding._codes(text), n).tolist() == [encoding._bucket(tuple(map(ord, text[i : i + n]))) for i in range(len(text) - n + 1)]
