"""Small helpers around a SparkSession: table access, sizing and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a SparkContext, so that Python workers find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._textloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, used wherever an operator must name a partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Input of less than this many bytes a core, in fewer files than cores, is dealt out before costly row-wise work.
SMALL_INPUT = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, if it is small and lies in fewer files than there are cores; otherwise as it is.

    One small file is one task, however much work its rows make. Large inputs already have many tasks and are never
    shuffled for this.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * SMALL_INPUT or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, set here to a temporary folder only for a local master that has none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="textloom-"))
    return named or context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """The URI of a new folder in the shared folder, for files that executors write and read."""
    return f"{shared_folder(spark).rstrip('/')}/textloom-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, local or not, and the path in it; works on the driver and in Python workers."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def cut(df: DataFrame) -> DataFrame:
    """A copy of `df` that no longer depends on its lineage, kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
