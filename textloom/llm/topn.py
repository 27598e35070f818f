"""The N best items of every group, however large a group is.

Method: two-stage salted ranking. The rows of a group are spread over subgroups by a hash of the item; each subgroup
ranks its items and keeps N; the survivors, at most N times the subgroups, are ranked once more. Spark also drops
rows beyond rank N before each exchange (WindowGroupLimit), so a hot group is never brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Subgroups of a group.
SALTS = 32


def top_n_per_group(df: DataFrame, group: str, item: Sequence[str], score: str, n: int = 5, salts: int = SALTS) -> DataFrame:
    """`group, *item, score, rank`: per group the `n` items with the highest score.

    An item is a distinct value of the `item` columns; it counts once, with its highest score. Order: score
    descending, then the item columns ascending, by code point, null first. Rows with a null group or score are left
    out. Repeated rows change nothing; a group with fewer than `n` items keeps all; an empty table gives no rows.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts are 1 or more")
    cols = {c: f"__i{k}" for k, c in enumerate(item)}
    rows = df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).select(F.col(group).alias("__g"), F.col(score).alias("__s"), *[F.col(c).alias(a) for c, a in cols.items()])
    best = rows.groupBy("__g", *cols.values()).agg(F.max("__s").alias("__s"))
    order = [F.col("__s").desc(), *[F.col(a).asc_nulls_first() for a in cols.values()]]
    salted = best.withColumn("__salt", F.pmod(F.xxhash64(*cols.values()), F.lit(salts)))
    kept = salted.withColumn("__r", F.row_number().over(W.partitionBy("__g", "__salt").orderBy(*order))).where(F.col("__r") <= n)
    final = kept.drop("__r", "__salt").withColumn("__r", F.row_number().over(W.partitionBy("__g").orderBy(*order))).where(F.col("__r") <= n)
    return final.select(F.col("__g").alias(group), *[F.col(a).alias(c) for c, a in cols.items()], F.col("__s").alias(score), F.col("__r").alias("rank"))
