import heapq
import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sonoloom.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard string, group string"


def check(docs, rows, shards):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, by_text, load = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        by_text[r.text_crc32, r["size"]].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert set(load) <= set(range(shards))
    return [load[s] for s in range(shards)]


def run(spark, docs, **kw):
    return sharding.assign(spark.createDataFrame([(*d, "clash", "clash", "clash") for d in docs], SCHEMA), **kw).collect()


def test_is_exactly_lpt_where_every_group_is_large(spark):
    rng = random.Random(1)
    docs = [(None, None), (1, ""), (1, ""), (None, "x")] + [(i, rng.choice("aébc") * rng.randint(1, 400)) for i in range(150)] + [(999, "long " * 50_000)]
    rows = run(spark, docs, shards=5)
    load = check(docs, rows, 5)
    groups = Counter()
    for _, t in docs:
        groups[t or ""] += len((t or "").encode()) + 1
    slow = [0] * 5
    for size in sorted(groups.values(), reverse=True):
        slow[slow.index(min(slow))] += size
    assert sorted(load) == sorted(slow)


def plain_lpt(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
    return [load for load, _ in sorted(heap, key=lambda e: e[1])]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 300), st.integers(1, 90), max_size=12), st.integers(1, 7))
def test_runs_are_dealt_as_the_heap_would(counts, shards):
    load = [0] * shards
    for size, starts, to in sharding.schedule(list(counts.items()), shards):
        for a, b, s in zip(starts, [*starts[1:], counts[size]], to):
            load[s] += size * (b - a)
    assert load == plain_lpt([s for s, c in counts.items() for _ in range(c)], shards)


def test_equals_plain_lpt_with_over_100_000_groups_and_a_hot_one(spark):
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("é"), (F.pmod(F.xxhash64("id"), F.lit(97)) + F.when(F.col("id") < 40, 3000).otherwise(0)).cast("int")))
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), text.alias("text")).unionByName(spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text")))
    found = sharding.assign(docs)
    load = {r.shard: r.b for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    groups = [r.b for r in docs.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()]
    assert len(groups) > 100_000 and [load[s] for s in range(16)] == plain_lpt(groups, 16)
    assert found.where(F.col("text_crc32") == zlib.crc32(b"copy")).select("shard").distinct().count() == 1
    slots = found.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in slots)


def test_empty_table(spark):
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = sharding.query(spark, sf).collect()
    load = check(docs, rows, 16)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    groups = Counter()
    for _, t in docs:
        groups[t or ""] += len((t or "").encode()) + 1
    assert max(load) - min(load) <= max(groups.values())
