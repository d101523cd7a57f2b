"""Stored segmentations, keyed by clip and original frame: upsert, remove some, remove all.

The table is Parquet in a fixed number of parts by clip. A change reads and rewrites the parts of the clips that it names and no
other file: new content is written to scratch first and then replaces its parts by dynamic partition overwrite. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoloom.plans.scratch import discard, materialise

KEYS, PARTS = ("clip_id", "frame_no"), 64


def _with_part(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64("clip_id"), F.lit(PARTS)).cast("int"))


def create(captured: DataFrame, path: str) -> None:
    """A new table; of rows with the same key the one with the largest values stays, so that keys are unique."""
    _with_part(_unique(captured)).repartition("part").write.partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def _unique(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c not in KEYS]
    return df.groupBy(*KEYS).agg(F.max(F.struct(*rest)).alias("v")).select(*KEYS, "v.*") if rest else df.select(*KEYS).distinct()


def upsert(captured: DataFrame, path: str) -> None:
    """Captured frames replace those of their key, or are added."""
    new = _unique(captured)
    _rewrite(path, new, lambda held: held.join(new.select(*KEYS), list(KEYS), "left_anti").unionByName(new))


def remove_frames(frames: DataFrame, path: str) -> None:
    """Segmentations of the named frames go."""
    _rewrite(path, frames, lambda held: held.join(frames.select(*KEYS), list(KEYS), "left_anti"))


def remove_clips(clips: DataFrame, path: str) -> None:
    """All segmentations of the named clips go."""
    _rewrite(path, clips, lambda held: held.join(clips.select("clip_id"), "clip_id", "left_anti"))


def _rewrite(path: str, named: DataFrame, change) -> None:
    spark = named.sparkSession
    parts = [r["part"] for r in _with_part(named.select("clip_id")).select("part").distinct().collect()]  # at most PARTS numbers
    if not parts:
        return
    held = spark.read.parquet(path).where(F.col("part").isin(parts)).drop("part")
    now = materialise(_with_part(change(held)), "segmentations")
    left = {r["part"] for r in now.select("part").distinct().collect()}
    now.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for part in set(parts) - left:  # a part without rows is not overwritten
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if left:
        discard(now)
