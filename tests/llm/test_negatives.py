"""Hard negatives, against all inner products."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoloom.llm import negatives as N

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    held = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    held = sorted({(i, label, tuple(v)) for i, label, v in held})
    out = []
    for a, la, va in held:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in held if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fits = [(n, -t) for t, n, label in scored if label != la and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k, n, -s, t) for k, (n, t) in enumerate(fits, 1)]
    return sorted(out)


def found(df, **how):
    return sorted(map(tuple, N.hard_negatives(N.integer_rows(df), F.col("id") % how.pop("every", 100) == 0, **how).select(COLUMNS).collect()))


@pytest.mark.parametrize(("block_rows", "query_bytes"), [(4096, 1 << 23), (40, 1 << 23), (64, 600)])
def test_equals_its_sql(spark, block_rows, query_bytes):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({N.SQL})").fetchall())
    assert want and found(spark.read.parquet(f"{sf}/embeddings.parquet"), block_rows=block_rows, query_bytes=query_bytes) == want


def cases(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 0.2, 1, 3])).round(2).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    rows += [(i, rows[30][1], int(i % 3)) for i in range(200, 260)]  # one vector many times
    rows += [(300, None, 1), (301, [1.0] * 6, None), (302, [1.0, None] * 3, 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (305, [], 1), (306, [0.0] * 6, 1), (310, [1.0, -1.0], 2), (310, [0.5] * 6, 2), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = cases(seed)
    padded = [(i, None if v is None else v + [0.0] * (6 - len(v)), label) for i, v, label in rows]
    df = spark.createDataFrame(rows, DDL).withColumns({"anchor": F.lit(1), "score": F.lit("x"), "part": F.lit(None).cast("int")})
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in padded], 10)
    assert want and found(df, every=10, block_rows=16) == want


def test_pruning_lets_no_row_go():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-300, 300, (400, 8))
    vectors[:200] //= 20
    size = np.linalg.norm(vectors.astype(float), axis=1)
    order = np.argsort((vectors / np.where(size > 0, size, 1)[:, None]).T, axis=1, kind="stable")
    block = N._Block(N._packed(vectors=vectors, labels=np.zeros(400), ids=np.arange(400), first=np.arange(401), order=order))
    pruned = 0
    for q in rng.integers(-300, 300, (60, 8)):
        scores = vectors @ q
        for least in (-5, 0, 1, int(scores.max() * 0.5), int(scores.max() * 0.9), int(scores.max()), int(scores.max()) + 1, 10**9):
            got = block.candidates(q, least)
            assert set(np.flatnonzero(scores >= least)) <= set(got.tolist())
            pruned += 400 - len(got)
    assert pruned > 60 * 400


def test_large_components_are_exact(spark):
    rows = [(100, [4e6, 1 / 256], 1), (1, [4e6, 5 / 256], 1), (2, [2e6, 3 / 256], 2), (3, [2e6, 2 / 256], 2), (4, [3e18, 0.0], 3)]
    got = found(spark.createDataFrame(rows, DDL.replace("float", "double")))
    assert got and got == brute(rows[:4]) and got[0][4] > 2**53  # the fifth row's product is cut to the largest long, over the band


def test_empty(spark):
    assert found(spark.createDataFrame([], DDL)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], DDL)) == []  # no anchor
    assert found(spark.createDataFrame([(100, [1.0], 1), (2, [1.0], 2)], DDL)) == []  # no positive
