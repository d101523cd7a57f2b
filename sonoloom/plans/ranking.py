"""Gapless row numbers inside groups that may be too large for one window task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows that one window partition should hold on average.
ROWS_PER_BUCKET = 100_000


def gapless_rank(df: DataFrame, group: str, order: list[str], out: str, n_rows: int, salt: str | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... inside each ``group``, without one task per group.

    Rows of a group are dealt to hash buckets of ``order``; a bucket's first rank is the number of
    rows in the group's earlier buckets. ``df`` is read twice, so pass a written table. Rows that
    agree in all of ``order`` get neighbouring ranks in any order. The bucket count follows
    ``n_rows``, so a group that holds a third of all rows still spreads over many tasks. Rows that agree in all of
    ``order`` share a bucket, unless the table has a column ``salt`` of numbers that differ among them; it is dropped.
    """
    order = [*order, salt] if salt else order
    buckets = max(256, n_rows // ROWS_PER_BUCKET)
    bucket: Column = F.pmod(F.xxhash64(*order), F.lit(buckets))
    keyed = df.withColumn("_bucket", bucket)
    base = (
        keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.sum("_n").over(W.partitionBy(group).orderBy("_bucket")) - F.col("_n"))
        .select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), "_base")
    )
    numbered = keyed.withColumn("_i", F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order)) - 1)
    return (
        numbered.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
        .withColumn(out, (F.col("_base") + F.col("_i")).cast("long"))
        .drop("_bucket", "_i", "_g", "_b", "_base", *([salt] if salt else []))
    )
