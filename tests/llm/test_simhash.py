import random

import xxhash
from pyspark.sql import functions as F

from sonoloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root string"


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    lab = {i: i for i in range(len(rows))}
    fps = [slow_fingerprint(t) for _, t in rows]

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                lab[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    found = simhash.near_duplicates(docs)
    return sorted(map(tuple, found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()), key=str)


def test_brute_force_with_edge_cases(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß", "x y"]
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "One"), (3, "One"), (None, "one"), (7, "two words"), (9, "퟿ \U0001f600 end")]
    for k in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 80, 400]))]
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(vocab).upper()
            rows.append((100 + k * 4 + c, rng.choice([" ", "\n"]).join(copy)))
    rows.append((1000, "very long " * 70_000))
    assert result(spark, rows) == slow_components(rows)


def test_dense_cluster_is_chunked(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)})
    nodes = spark.createDataFrame([(f,) for f in fps] + [(~base,)], "node long")
    links = simhash.covering_links(nodes, chunk=64)
    assert all((a ^ b).bit_count() <= 3 for a, b in links.limit(500).collect())
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert len({roots[f] for f in fps}) == 1 and ~base not in roots


def test_chunks_of_one_group_share_their_edges(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) for a in range(60)} | {base})  # two bits apart at most, so all are linked
    nodes = spark.createDataFrame([(f, 0) for f in fps], "node long, c long")
    pairs = simhash.in_chunks(nodes.withColumn("v", F.lit(0)).withColumn("k", F.lit(0)), ["v", "k"], F.lit(5), ["node"])
    links = pairs.mapInArrow(simhash._forests(3), "a long, b long").distinct().collect()
    assert len(links) <= len(fps) + 25  # one forest for each chunk and an edge for each pair
    assert len({r.root for r in simhash.components(spark.createDataFrame(links)).collect()}) == 1


def test_contracted_edges_connect_the_same_and_are_few_in_a_dense_group(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(6000)] + [(1000 + i, 1001 + i) for i in range(50)] + [(-5, -4), (-4, -5), (2000, 2000)]
    df = spark.createDataFrame(edges, "a long, b long").where("a != b").cache()
    few = simhash.contracted(df).collect()
    assert len(few) < 1000
    assert {x for r in few for x in r} == {x for e in edges if e[0] != e[1] for x in e}
    lab = {x: x for e in edges for x in e}

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        lab[max(x, y)] = min(x, y)
    assert {(r.node, r.root) for r in simhash.components(df).collect()} == {(x, find(x)) for x in lab if x != 2000}


def test_every_pair_within_radius_meets():
    rng = random.Random(3)
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for _ in range(20_000):
        d = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not m & d for m in masks)


def test_every_pair_within_a_wide_radius_meets():
    rng = random.Random(4)
    tables = simhash.covering_tables(15, 2, 2)
    assert len(tables) == 60
    for _ in range(5_000):
        d = sum(1 << i for i in rng.sample(range(128), rng.randint(0, 15)))
        assert any(not (m % (1 << 64)) & (d >> (64 * w)) & ((1 << 64) - 1) for w, m in tables)


def test_empty_table_and_keep_one(spark):
    assert result(spark, []) == []
    long = " ".join(f"t{i}" for i in range(300))
    docs = spark.createDataFrame([(5, long, "a", "b"), (4, long, "a", "b"), (4, long, "a", "b"), (None, long, "a", "b"), (None, "other text here", "a", "b")], SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [4, None]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.query(spark, sf).collect()), key=str) == slow_components(rows)


def test_exploded_rows_are_not_broadcast(spark):
    """Spark estimates them as small as the nodes; a broadcast of over 4 MB is an error here."""
    nodes = spark.range(40_000).select(F.xxhash64("id").alias("node")).union(spark.range(1).select(F.xxhash64("id").bitwiseXOR(F.lit(5)).alias("node")))
    spark.conf.set("spark.sql.maxBroadcastTableSize", 4 << 20)
    try:
        got = simhash.covering_links(nodes).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [(r.a ^ r.b) & (2**64 - 1) for r in got] == [5]
