"""Text files, folders of them, and ZIP archives as tables; and sentences made from them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.numbering import row_numbers
from textloom.session import file_system, partitions, ship

LOADED, INVALID, DUPLICATE = "loaded", "invalid", "duplicate"
FILE_COLUMNS = ["file_key", "source_path", "content", "status"]


#: Bytes at the end of a file in which a ZIP archive's directory must end: its fixed part and the longest comment.
_ZIP_END = 22 + 65_535
#: Bytes of members, unpacked, that one task reads from an archive at a time.
CHUNK = 64 << 20


def _located(spark: SparkSession, path: str):
    """Hadoop's file system and the qualified path: a relative path becomes absolute, a scheme is added."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def _kind(spark: SparkSession, path: str) -> str:
    """directory, zip (by its end, whatever its name), txt; raises for a missing path or any other file."""
    fs, where = _located(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    status = fs.getFileStatus(where)
    if status.isDirectory():
        return "directory"
    stream = fs.open(where)
    try:
        stream.seek(max(0, status.getLen() - _ZIP_END))
        end = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    if zipfile.is_zipfile(io.BytesIO(end)) or b"PK\x05\x06" in end:
        return "zip"
    if path.lower().endswith(".txt"):
        return "txt"
    raise ValueError(f"{path} is no folder, ZIP archive or .txt file")


def load(spark: SparkSession, path: str) -> DataFrame:
    """`file_key, source_path, content, status` of a folder (searched through), a ZIP archive or one .txt file."""
    kind = _kind(spark, path)
    return scan_zip(spark, path) if kind == "zip" else scan_text(spark, path, kind == "directory")


def scan_text(spark: SparkSession, path: str, directory: bool = True) -> DataFrame:
    """Text files: strict UTF-8, a leading BOM dropped, line ends made \\n. Undecodable files have null content and status invalid.

    Paths are relative to the folder, whichever way it is named (relative, `.`, with a scheme); one file has its bare
    name. Extensions count in any case.
    """
    reader = spark.read.format("binaryFile")
    if directory:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]")
    rows = reader.load(path).select("path", F.col("content").alias("raw"))
    name = F.element_at(F.split("path", "/"), -1)
    if directory:
        root = _located(spark, path)[1].toString().rstrip("/")
        name = F.substring("path", len(root) + 2, F.length("path"))
    decoded = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string"))
    content = F.regexp_replace(F.regexp_replace(decoded, "^\ufeff", ""), "\r\n?", "\n")
    return rows.select(F.col("path").alias("file_key"), name.alias("source_path"), content.alias("content"), F.when(decoded.isNull(), INVALID).otherwise(LOADED).alias("status"))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The .txt members of archives, in chunks that one task reads."""
    for pdf in batches:
        for path in pdf["path"]:
            fs, at = file_system(path)
            got, chunk, size = [], 0, 0
            try:
                with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive:
                    members = archive.infolist()
            except (zipfile.BadZipFile, OSError) as error:
                raise ValueError(f"{path} is no ZIP archive") from error
            for i, member in enumerate(members):
                if not member.is_dir() and member.filename.lower().endswith(".txt"):
                    if size and size + member.file_size > CHUNK:
                        chunk, size = chunk + 1, 0
                    size += member.file_size
                    got.append((path, chunk, i))
            if got:
                yield pd.DataFrame(got, columns=["path", "chunk", "member"])


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The contents of members, one at a time."""
    for pdf in batches:
        for path, part in pdf.groupby("path"):
            fs, at = file_system(path)
            with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive:
                listed = archive.infolist()
                for i in part["member"]:
                    member = listed[i]
                    try:
                        content: str | None = archive.read(member).decode("utf-8-sig")
                    except (UnicodeDecodeError, zipfile.BadZipFile, RuntimeError, OSError):
                        content = None
                    name = member.filename
                    yield pd.DataFrame({"file_key": [f"{path}::{name}"], "source_path": [name], "content": [content], "status": [INVALID if content is None else LOADED]})


def scan_zip(spark: SparkSession, path: str) -> DataFrame:
    """The .txt members of ZIP archives (a glob reads many at once). Line ends stay as they are; bad members have status invalid.

    Only paths and member numbers are exchanged: archives are listed, then chunks of their members are opened where
    they are read, so neither a large archive nor a large member has to pass through one record.
    """
    ship(spark)
    paths = spark.read.format("binaryFile").load(path).select("path")
    listed = paths.repartition(partitions(spark), "path").mapInPandas(_listed, "path string, chunk int, member int")
    return listed.repartition(partitions(spark), "path", "chunk").mapInPandas(_members, "file_key string, source_path string, content string, status string")


def drop_loaded(files: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Files loaded before (by key), or repeated here, get status duplicate and lose their content.

    Of the readable files of one key one stays loaded; unreadable ones stay invalid, each time. Repeats are counted per
    key, combined on the map side, so a key that fills the table isn't brought together.
    """
    per = files.groupBy("file_key", "source_path", "status").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("content"))
    if loaded is None:
        marked = per.withColumn("known", F.lit(False))
    else:
        known = loaded.where(F.col("status") == LOADED).select("file_key").distinct().withColumn("known", F.lit(True))
        marked = per.join(known, "file_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    new = (F.col("status") == LOADED) & ~F.col("known")
    first = marked.where(new).select(*FILE_COLUMNS)
    more = F.when(new, F.col("n") - 1).otherwise(F.col("n"))
    repeated = marked.withColumn("more", more).where(F.col("more") > 0).select("file_key", "source_path", "status", F.explode(F.sequence(F.lit(1), F.col("more"))))
    status = F.when(F.col("status") == LOADED, DUPLICATE).otherwise(F.col("status"))
    return first.unionByName(repeated.select("file_key", "source_path", F.lit(None).cast("string").alias("content"), status.alias("status")))


def load_stats(files: DataFrame) -> DataFrame:
    """One row: loaded_files, skipped_duplicates, skipped_invalid."""
    count = lambda s, name: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(name)
    return files.agg(count(LOADED, "loaded_files"), count(DUPLICATE, "skipped_duplicates"), count(INVALID, "skipped_invalid"))


def lines_of(files: DataFrame) -> DataFrame:
    """`source_path, line_no, original_text, normalized_text` of the lines that normalize to something.

    Lines end at \\n alone; numbers start at 1 and count blank lines; the original line stays as it is.
    """
    cut = files.where(F.col("content").isNotNull()).select("source_path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "original_text"))
    rows = cut.select("source_path", (F.col("pos") + 1).cast("int").alias("line_no"), "original_text", tx.normalize(F.col("original_text")).alias("normalized_text"))
    return rows.where(F.col("normalized_text") != "")


def prepare_sentences(files: DataFrame, first_id: int = 0) -> DataFrame:
    """Sentences with dense ids in order of (source_path, line_no), from `first_id` on, and their word positions."""
    numbered = row_numbers(lines_of(files), ["source_path", "line_no"], "sentence_id")
    return numbered.select((F.col("sentence_id") + first_id).alias("sentence_id"), "original_text", "normalized_text", "source_path", "line_no", tx.word_positions(F.col("normalized_text")).alias("word_positions"))


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """A saved workload: JSON `{"queries": [...]}`, one row a query."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("queries").alias("x")).select("x.*")
