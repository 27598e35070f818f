"""Dense row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import cut


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, counting from 0 in the order of the columns `order` (which should identify a row).

    Rows are range-partitioned and numbered per partition; partition offsets, one number each, come from the driver.
    The ranged rows are kept in the checkpoint folder, so both steps see the same partitions. Empty in, empty out.
    """
    kept = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__p", F.spark_partition_id()))
    offsets, total = [], 0
    for r in kept.groupBy("__p").count().orderBy("__p").collect():
        offsets.append((r["__p"], total))
        total += r["count"]
    local = kept.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1)
    begin = df.sparkSession.createDataFrame(offsets, "__p int, __o long")
    return local.join(F.broadcast(begin), "__p").withColumn(name, (F.col("__r") + F.col("__o")).cast("long")).drop("__p", "__r", "__o")
