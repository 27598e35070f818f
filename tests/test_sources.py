from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.sources import files, index_store


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "sample.txt").write_bytes("\ufeff  First sentence.  \r\n\r\nSecond sentence!\n!!!\n".encode())
    (tmp_path / "deep" / "B.TXT").write_bytes(b"one\rtwo")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "other.md").write_bytes(b"no")
    return tmp_path


def test_folder(spark, folder):
    got = files.load(spark, str(folder))
    assert sorted(rows(got, "source_path", "status")) == [("bad.txt", "invalid"), ("deep/B.TXT", "loaded"), ("sample.txt", "loaded")]
    assert rows(files.load_stats(got), "loaded_files", "skipped_duplicates", "skipped_invalid") == [(2, 0, 1)]
    prepared = files.prepare_sentences(got).orderBy("sentence_id")
    assert rows(prepared, "sentence_id", "source_path", "line_no", "original_text", "normalized_text") == [
        (0, "deep/B.TXT", 1, "one", "one"), (1, "deep/B.TXT", 2, "two", "two"), (2, "sample.txt", 1, "  First sentence.  ", "first sentence"), (3, "sample.txt", 3, "Second sentence!", "second sentence"),
    ]


def test_relative_folders(spark, folder, monkeypatch):
    """A folder's name may come again inside it, and it may be named by a relative path, `.` or a URI."""
    base = folder / "t"
    for path in ("cat/b.txt", "hat/t/b.txt", "with blank/ü.txt"):
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text("x")
    want = ["cat/b.txt", "hat/t/b.txt", "with blank/ü.txt"]
    here = os.path.relpath(base)
    for name in (str(base), f"{base}/", f"file://{base}", here, f"./{here}"):
        assert sorted(r["source_path"] for r in files.load(spark, name).collect()) == want, name


def test_a_file_prepared_twice(spark, folder):
    got = files.load(spark, str(folder / "sample.txt"))
    both = files.drop_loaded(got.unionByName(got))
    assert sorted(rows(both, "status")) == [("duplicate",), ("loaded",)]
    assert rows(files.load_stats(both), "loaded_files", "skipped_duplicates", "skipped_invalid") == [(1, 1, 0)]
    again = files.drop_loaded(got, got)
    assert files.prepare_sentences(again.where("status = 'loaded'")).count() == 0
    assert rows(files.load_stats(again), "loaded_files", "skipped_duplicates", "skipped_invalid") == [(0, 1, 0)]


def test_single_file_and_errors(spark, folder):
    assert rows(files.load(spark, str(folder / "deep" / "B.TXT")), "source_path", "content") == [("B.TXT", "one\ntwo")]
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(folder / "absent.txt"))
    with pytest.raises(ValueError):
        files.load(spark, str(folder / "other.md"))


def test_zip_by_content(spark, tmp_path):
    path = tmp_path / "archive.data"
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("folder/a.txt", "Hello, WORLD!\r\nAnother   line.\n")
        out.writestr("ignore.bin", b"\0")
        out.writestr("bad.txt", b"\xff")
    got = files.load(spark, str(path))
    assert sorted(rows(got, "source_path", "status")) == [("bad.txt", "invalid"), ("folder/a.txt", "loaded")]
    assert rows(files.lines_of(got), "line_no", "original_text", "normalized_text") == [(1, "Hello, WORLD!\r", "hello world"), (2, "Another   line.", "another line")]


def test_zip_behind_other_bytes_and_in_chunks(spark, tmp_path, monkeypatch):
    path = tmp_path / "with blank.bin"
    with zipfile.ZipFile(path, "w") as out:
        for i in range(9):
            out.writestr(f"m{i}.txt", f"line {i}")
    path.write_bytes(b"a stub before the archive" + path.read_bytes())
    got = files.load(spark, str(path))
    assert sorted(rows(got, "source_path", "content")) == [(f"m{i}.txt", f"line {i}") for i in range(9)]


def test_index_rejects_repeated_ids_and_unindexed_lengths(spark, tmp_path):
    one = spark.createDataFrame([(1, "ab", "ab", "f", 1), (1, "cd", "cd", "f", 2)], "sentence_id long, original_text string, normalized_text string, source_path string, line_no int")
    with pytest.raises(ValueError, match="stands 2 times"):
        index_store.save_index(one, str(tmp_path / "i"), [2])
    with pytest.raises(ValueError, match="positive"):
        index_store.save_index(one, str(tmp_path / "i"), [0])
    index_store.save_index(one.limit(1), str(tmp_path / "i"), [2])
    index = index_store.load_index(spark, str(tmp_path / "i"), [2])
    seeds = spark.createDataFrame([("ab",), ("zz",)], "seed string")
    assert sorted(rows(search.frequency_of(seeds, index, [2]), "seed", "frequency")) == [("ab", 1), ("zz", 0)]
    with pytest.raises(Exception, match="gram size not indexed"):
        search.frequency_of(spark.createDataFrame([("abc",)], "seed string"), index, [2]).collect()


def test_second_load_is_a_duplicate(spark, folder):
    got = files.load(spark, str(folder))
    again = files.drop_loaded(got, got)
    assert files.lines_of(again).count() == 0
    assert rows(files.load_stats(again), "loaded_files", "skipped_duplicates", "skipped_invalid") == [(0, 2, 1)]
    assert rows(files.load_stats(got.limit(0)), "loaded_files", "skipped_duplicates", "skipped_invalid") == [(0, 0, 0)]


def test_index_round_trip(spark, tmp_path, folder):
    prepared = files.prepare_sentences(files.load(spark, str(folder)))
    path = str(tmp_path / "index")
    mark = index_store.fingerprint(spark, str(folder / "sample.txt"))
    index_store.save_index(prepared, path, [2, 3], mark)
    index = index_store.load_index(spark, path, [2, 3], mark)
    assert index["sentences"].count() == 4
    assert index["frequencies"].where("gram_size = 3 and gram = 'sen'").first()["frequency"] == 2
    for sizes, other in (([1, 2], mark), ([2, 3], "changed")):
        with pytest.raises(ValueError):
            index_store.load_index(spark, path, sizes, other)
    assert not index_store.index_is_valid(spark, str(tmp_path / "absent"), [2, 3])


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("q1", ["a", "b"], 2)], "query_id string, tags array<string>, n int")
    index_store.write_query_csv(df, str(tmp_path / "csv"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv")), "query_id", "tags", "n") == [("q1", "a|b", "2")]
    assert index_store.markdown_table(df.drop("tags")).split("\n")[-1] == "| q1 | 2 |"
    index_store.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert index_store.pending(df, df).count() == 0


def test_line_numbers_count_blank_lines_and_empty_contents(spark):
    df = spark.createDataFrame([("a", "\n\nx\n", "loaded"), ("b", None, "invalid"), ("c", "", "loaded")], "source_path string, content string, status string")
    assert rows(files.lines_of(df), "source_path", "line_no") == [("a", 3)]
    assert files.prepare_sentences(df.limit(0)).count() == 0
    assert rows(files.prepare_sentences(df, 7), "sentence_id") == [(7,)]
    assert df.where(F.col("content").isNull()).count() == 1
