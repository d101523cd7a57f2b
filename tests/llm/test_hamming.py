import math
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoloom.llm import hamming


def slow(queries, rows, k):
    out = []
    for q, c in set(queries):
        if q is None or c is None:
            continue
        near = sorted((((c ^ d) & (2**64 - 1)).bit_count(), i) for i, d in rows if i is not None and d is not None)[:k]
        out += [(q, i, d, r + 1) for r, (d, i) in enumerate(near)]
    return sorted(out)


def test_brute_force_with_edge_cases(spark):
    rng = random.Random(7)
    hot = rng.randrange(-(2**63), 2**63)
    rows = [(i, hot) for i in range(400)] + [(400 + i, hot ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(150)]
    rows += [(1000 + i, rng.randrange(-(2**63), 2**63)) for i in range(500)] + [(5, hot), (None, hot), (7000, None), (1000, 3)]
    queries = rows[::40] + [(0, hot), (0, hot), (-1, 0), (-2, -1), (None, 1), (9, None)]
    df, qs = (spark.createDataFrame(x, "id long, code long") for x in (rows, queries))
    assert sorted(map(tuple, hamming.top_k(qs, df, 10).collect())) == slow(queries, rows, 10)


@pytest.mark.parametrize("n", [0, 3])
def test_few_rows(spark, n):
    rows = [(i, i * 77) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, code long")
    queries = spark.createDataFrame([(50, -1)], "id long, code long")
    assert sorted(map(tuple, hamming.top_k(queries, df, 10).collect())) == slow([(50, -1)], rows, 10)
    if not n:
        assert hamming.top_k(queries.limit(0), df, 10).count() == 0


def test_flips_and_cuts(spark):
    for width, distance in ((5, 1), (5, 3), (8, 4), (3, 3)):
        masks = spark.range(1).select(hamming._flips(width, distance).alias("m")).first().m
        assert len(set(masks)) == len(masks) == math.comb(width, distance)
        assert all(m.bit_count() == distance and m < 1 << width for m in masks)
    for n in (0, 1, 500, 50_000, 10**10):
        parts = hamming.cuts(n)
        assert sum(w for _, w in parts) == 64 and all(a + w == b for (a, w), (b, _) in zip(parts, parts[1:]))


def test_sign_code(spark):
    v = [0.5, None, -1.0] + [1.0] * 61
    got = spark.createDataFrame([(v,), ([2.0],)], "v array<float>").select(hamming.sign_code(F.col("v")).alias("c")).collect()
    assert [r.c & (2**64 - 1) for r in got] == [sum(1 << i for i, x in enumerate(v) if (x or 0) > 0), 1]


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = hamming.query(spark, sf)
    expected = con.execute(hamming.SQL)
    assert df.columns == [c[0] for c in expected.description]
    assert sorted(map(tuple, df.collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("spread", [2, 6, 64])
def test_levels_and_scans_of_a_block(spark, spread):
    """Neighbours found by probing, by looking at all codes, and behind a value that many codes share."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**63, 2500, dtype=np.uint64)
    codes = np.unique(np.concatenate([centres ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (spread // 2, 2500), dtype=np.uint64), axis=0) for _ in range(8)] + [np.arange(9000, dtype=np.uint64) << np.uint64(40)]))
    rng.shuffle(codes)
    parts = hamming.cuts(len(codes))
    rounds = hamming._levels(len(codes), parts)
    assert max(level for level, _ in rounds) >= 2
    masks = {(w, n): np.array([sum(1 << i for i in c) for c in combinations(range(w), n)]) for _, w in parts for n in range(4)}
    asked = np.unique(np.concatenate([codes[:40], centres[:20], np.array([0, 2**64 - 1], dtype=np.uint64)]))
    q, at, gap = hamming._Block(codes, parts, 10).nearest(asked, rounds, masks)
    gaps = np.bitwise_count(codes[None, :] ^ asked[:, None]).astype(np.int64)
    best = np.argsort(gaps * len(codes) + np.arange(len(codes)), axis=1)[:, :10]
    assert (q.reshape(-1, 10) == np.arange(len(asked))[:, None]).all() and (at.reshape(-1, 10) == best).all() and (gap.reshape(-1, 10) == np.take_along_axis(gaps, best, 1)).all()


def test_no_probes_reach_the_driver(spark, monkeypatch):
    """Several blocks and tasks; a broadcast of over 4 MB is an error."""
    monkeypatch.setattr(hamming, "BLOCK", 1 << 11, raising=False)
    monkeypatch.setattr(hamming, "ASKED", 1 << 5, raising=False)
    rng = random.Random(3)
    rows = [(i, rng.randrange(-(2**63), 2**63)) for i in range(10_000)]
    spark.conf.set("spark.sql.maxBroadcastTableSize", 4 << 20)
    try:
        df = spark.createDataFrame(rows, "id long, code long")
        got = sorted(map(tuple, hamming.top_k(df.where("id % 100 = 0"), df, 10).collect()))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == slow(rows[::100], rows, 10)
