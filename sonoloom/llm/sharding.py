"""Balanced shards by longest-processing-time scheduling.

Documents of equal text form a group that stays together. Groups sorted by size, largest first, go to the
least-loaded shard through a heap. Groups of one size are alike, so the driver schedules the histogram of group
sizes: a run of equal groups is dealt at once up to its last round, as the heap would. Of total size b there are
at most sqrt(2 b) different sizes, far fewer in practice; no group or text comes to the driver. Spark numbers
the groups of each size and looks up their shard, then gives it to their documents; groups with at least
1/``hot`` of all rows, ``hot`` at most, are joined by broadcast.

Law: ``bytes`` (sizes near equal). Size: UTF-8 bytes of the text plus 1.

Defined results: null text counts as empty (size 1, CRC 0) and shares the empty texts' group; equal rows
share a group and get slots of their own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoloom.plans.ranking import gapless_rank
from sonoloom.plans.scratch import materialise

SHARDS, HOT = 16, 10_000


def deal(heap: list[tuple[int, int]], size: int, count: int) -> dict[int, int]:
    """shard -> groups of ``size`` that the heap of (load, shard) gives it, one after the other; the heap is brought up to date."""
    got: dict[int, int] = {}
    if count > 2 * len(heap):  # all that go to loads under some level, without popping each
        low, high = heap[0][0], heap[0][0] + size * (count + 1)
        under = lambda level: sum(max(0, -((load - level) // size)) for load, _ in heap)
        while low + 1 < high:
            middle = (low + high) // 2
            low, high = (middle, high) if under(middle) <= count else (low, middle)
        got = {shard: n for load, shard in heap if (n := max(0, -((load - low) // size)))}
        heap[:] = [(load + size * got.get(shard, 0), shard) for load, shard in heap]
        heapq.heapify(heap)
        count -= sum(got.values())
    for _ in range(count):
        load, shard = heap[0]
        got[shard] = got.get(shard, 0) + 1
        heapq.heapreplace(heap, (load + size, shard))
    return got


def schedule(counts: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, first number, shard) runs for a histogram (size, groups): groups from a first number on go to that shard."""
    heap, out = [(0, s) for s in range(shards)], []
    for size, count in sorted(counts, reverse=True):
        got, first, starts = deal(heap, size, count), 0, []
        for n in got.values():
            starts.append(first)
            first += n
        out.append((size, starts, list(got)))
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, hot: int = HOT) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of ``docs``; slots are gapless in a shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")), "sizes",
    )
    groups = materialise(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    whole = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("c")).toArrow()
    runs = schedule(list(zip(sizes["bytes"].to_pylist(), sizes["c"].to_pylist())), shards)
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    table = pa.table([pa.array(list(c), k) for c, k in zip(zip(*runs) if runs else ((), (), ()), kinds)], names=["of", "starts", "shards"])
    numbered = gapless_rank(groups, "bytes", ["group"], "number", whole["groups"])
    at = F.size(F.filter("starts", lambda x: x <= F.col("number")))
    placed = numbered.join(spark.createDataFrame(table), F.col("bytes") == F.col("of")).select("group", "n", F.element_at("shards", at).alias("shard"))
    placed = materialise(placed, "placed")
    large = F.col("n") * hot >= F.lit(whole["rows"])
    own = F.broadcast(placed.where(large).select("group", F.col("shard").alias("own")))
    rest = placed.where(~large).select("group", F.col("shard").alias("rest"))
    seen = rows.join(own, "group", "left")
    columns = ["doc_id", "size", "text_crc32"]
    found = seen.where("own IS NOT NULL").select(*columns, F.col("own").alias("shard")).unionByName(seen.where("own IS NULL").join(rest, "group").select(*columns, F.col("rest").alias("shard")))
    return gapless_rank(materialise(found.withColumn("_salt", F.monotonically_increasing_id()), "shards"), "shard", ["doc_id", "text_crc32", "size"], "slot", whole["rows"], "_salt")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
