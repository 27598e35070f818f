from __future__ import annotations

from textloom.streaming import session

LINES = [("s", 0, "to be"), ("s", 1, "   "), ("s", 2, "or not"), ("t", 0, "to be"), ("t", 1, "  #  "), ("t", 2, "or not"), ("t", 3, None), ("t", 4, "x"), ("u", 0, "#")]
WANT = {("s", 0, "to be"), ("s", 2, "to be or not"), ("t", 0, "to be"), ("t", 2, "or not"), ("t", 4, "or not x")}


def test_batch(spark):
    lines = spark.createDataFrame(LINES, "session string, turn long, line string")
    assert {tuple(r) for r in session.session_prefixes(lines).collect()} == WANT
    assert session.session_prefixes(lines.limit(0)).count() == 0


def test_stream_over_two_batches(spark, tmp_path):
    schema = "session string, turn long, line string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    got = []
    for turns in (lambda t: t < 2, lambda t: t >= 2):
        spark.createDataFrame([x for x in LINES if turns(x[1])], schema).coalesce(1).write.mode("append").json(source)
        lines = spark.readStream.schema(schema).json(source)
        query = session.complete_stream(lines, lambda asked: asked, lambda df, _: got.extend(tuple(r) for r in df.collect()), out)
        query.processAllAvailable()
        query.stop()
    assert set(got) == {(f"{s}:{t}", p) for s, t, p in WANT}
