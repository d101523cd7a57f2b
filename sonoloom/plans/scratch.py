"""Lineage cuts: intermediate tables in the folder that the cluster shares.

The folder is read from ``spark.checkpoint.dir``. Only a local session may run without that
setting; it then gets ``/tmp/checkpoints``. On a cluster a machine-local folder would be wrong,
so a missing setting is an error there. Tables stay while results may still read them; ``clear`` deletes those of
this driver, and those in the local default folder go when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"
BATCH_BYTES = "4m"
_made: list[str] = []
_tables: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_DEFAULT


def scratch_path(spark: SparkSession, name: str, joint: str = "-") -> str:
    """A new path on every call; nothing is ever overwritten."""
    path = f"{scratch_root(spark)}/{name}{joint}{uuid.uuid4().hex}"
    _made.append(path)
    if path.startswith(LOCAL_DEFAULT + "/"):
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def clear(spark: SparkSession) -> None:
    """Delete the tables made so far, in the catalogue too; no result that reads them may be used afterwards."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the tables that ``df``, and nothing else any more, reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}:
        for path in [p for p in _made if p.rsplit("/", 1)[-1] == folder]:
            if folder in _tables:
                spark.sql(f"DROP TABLE IF EXISTS {folder}")
                _tables.remove(folder)
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            _made.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Bound by bytes what a Python worker gets at once: rows of long texts would make batches by count large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses neither recompute nor lose it with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, key: str, name: str, spread: bool = True) -> DataFrame:
    """Like ``materialise``, in a catalogue table bucketed by ``key``: joins on it do not shuffle these rows again.

    Rows that already come by bucket, as those of a join with such a table do, need no ``spread``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, "_")
    table = path.rsplit("/", 1)[-1]
    _tables.append(table)
    (df.repartition(buckets, key) if spread else df).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)
