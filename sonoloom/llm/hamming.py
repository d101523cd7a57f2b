"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code of ``BITS`` bits is cut into m segments of about log2(rows) bits, each with an index from segment
value to codes (Norouzi, Punjani and Fleet, 2012). Level a probes the segments, first one half and then
the other, with all values at distance a from the query's. Once b segments have been probed to a and the
others to a - 1, any code within m*a + b - 1 of the query has been found: a code farther away in every
segment is at least b*(a+1) + (m-b)*a away. A query is done as soon as its k-th verified distance is
within that radius; the others go on. So results are exact.

Codes are dealt to blocks of about ``BLOCK``, each indexed by the tasks that search it for up to ``ASKED`` queries; a query's nearest are the
nearest of its nearest in the blocks. So nothing is broadcast, and no probed value is a row of a table. Where a level would probe
more values than looking at each code of the block would cost, or a query's values are shared by a great part of them, the codes are looked at one by one.

The index holds distinct codes; only the k smallest ids of a code can be in a result, so a code that a
third of all rows share is k ids. Queries of one code are searched once.

Defined results: neighbours are ordered by distance, then id; a query is its own neighbour; with fewer
rows than k all are returned; rows whose vector or id is null are neither queries nor neighbours; a null
or missing component counts as 0; repeated ids are neighbours as often as they occur, and a repeated query
gets one result; empty tables give an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sonoloom.plans.scratch import materialise

BITS, K, EVERY = 64, 10, 100
#: Codes of a block and queries that a task searches it for.
BLOCK, ASKED = 1 << 16, 1 << 14
#: Queries searched at once, and codes looked at in the time of one probe.
BATCH, PROBE = 64, 64


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set if component i is positive."""
    bit = lambda i: F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = bit(0)
    for i in range(1, bits):
        code = code.bitwiseOR(bit(i))
    return code


def cuts(rows: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of the segments: as many as make a segment about log2(rows) bits wide, at most 24."""
    m = min(bits, max(2, round(bits / min(24, max(8.0, math.log2(max(2, rows)))))))
    edges = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _flips(width: int, distance: int) -> Column:
    """Array of the masks with ``distance`` bits of ``width``, built inside Spark from smaller ones."""
    masks = [sum(1 << i for i in c) for c in combinations(range(width), min(distance, 2))]
    found = F.array(*(F.lit(m).cast("long") for m in masks))
    for _ in range(distance - 2):  # add one bit above the highest set so far
        above = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        found = F.flatten(F.transform(found, lambda x: F.transform(F.filter(above, lambda b: b > x), lambda b: b.bitwiseOR(x))))
    return found


def _levels(codes: int, parts: list[tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """(level, segments) of the rounds that cost less than looking at each of ``codes`` codes."""
    half, out = -(-len(parts) // 2), []
    for level in range(max(width for _, width in parts) + 1):
        for held in (range(half), range(half, len(parts))):
            own = [s for s in held if level <= parts[s][1]]
            if PROBE * sum(math.comb(parts[s][1], level) * (1 + codes / (1 << parts[s][1])) for s in own) >= codes:
                return out
            out.append((level, own))
    return out


class _Block:
    """Codes in the order of their ids, with an index for each segment."""

    def __init__(self, codes: np.ndarray, parts: list[tuple[int, int]], k: int):
        self.codes, self.parts, self.k = codes, parts, min(k, len(codes))
        self.index = []
        for shift, width in parts:
            own = self._own(codes, shift, width)
            by = np.argsort(own, kind="stable")
            self.index.append((by, np.searchsorted(own[by], np.arange((1 << width) + 1))))

    @staticmethod
    def _own(codes: np.ndarray, shift: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def nearest(self, asked: np.ndarray, rounds: list[tuple[int, list[int]]], masks: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place of the code, distance) of the k nearest of each query, ties by place."""
        best = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        bound, looked = np.full(len(asked), BITS, dtype=np.int64), np.zeros(len(asked), dtype=bool)
        left, m = np.arange(len(asked)), len(self.parts)
        for level, own in rounds:
            for s in own:
                shift, width = self.parts[s]
                by, first = self.index[s]
                flips = masks[width, level]
                values = (self._own(asked[left], shift, width)[:, None] ^ flips[None, :]).ravel()
                begin, n = first[values], first[values + 1] - first[values]
                many = 4 * n.reshape(len(left), len(flips)).sum(axis=1) > len(self.codes)
                if many.any():  # a value that a great part of the codes share
                    looked[left[many]] = True
                    n[np.repeat(many, len(flips))] = 0
                of = np.repeat(np.repeat(left, len(flips)), n)
                best = self._merged(best, of, by[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())], asked, bound)
                left = left[~many]
            done = bound[left] <= m * level + own[-1]  # as many segments as the last one's number are probed to this level, and that one
            left = left[~(done & (np.bincount(best[0], minlength=len(asked))[left] >= self.k))]
            if not len(left):
                break
        looked[left] = True
        probed = ~looked[best[0]]
        whole = [tuple(x[probed] for x in best), *(self._looked(q, asked[q], int(bound[q])) for q in np.flatnonzero(looked).tolist())]
        return tuple(np.concatenate(x) for x in zip(*whole))

    def _looked(self, q: int, code: np.uint64, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of a query by looking at every code; ``most`` is at least the k-th distance."""
        gaps = np.bitwise_count(self.codes ^ code)
        some = gaps[: 1 << 11]
        if len(some) >= self.k:
            most = min(most, int(np.partition(some, self.k - 1)[self.k - 1]))
        near = np.flatnonzero(gaps <= most)
        near = near[np.argsort(gaps[near], kind="stable")[: self.k]]
        return np.full(len(near), q), near, gaps[near].astype(np.int64)

    def _merged(self, best: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray, at: np.ndarray, asked: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of each query among ``best`` and what was found; ``bound`` is set to the k-th distance where there are k."""
        gap = np.bitwise_count(self.codes[at] ^ asked[of]).astype(np.int64)
        near = gap <= bound[of]
        q, at, gap = (np.concatenate(x) for x in zip(best, (of[near], at[near], gap[near])))
        order = np.lexsort((at, gap, q))
        q, at, gap = q[order], at[order], gap[order]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1])
        q, at, gap = q[new], at[new], gap[new]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < self.k
        last = np.arange(len(q)) - first == self.k - 1
        bound[q[last]] = gap[last]
        return q[kept], at[kept], gap[kept]


def _search(k: int, parts: list[tuple[int, int]], rounds: list[tuple[int, list[int]]], masks: dict[tuple[int, int], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        held = group.filter(group["first"].is_valid()).sort_by([("first", "ascending"), ("code", "ascending")])
        asked = group.filter(group["first"].is_null())["code"].to_numpy().view(np.uint64)
        codes = held["code"].to_numpy().view(np.uint64)
        block = _Block(codes, parts, k) if len(codes) else None
        found = []
        for a in range(0, len(asked) if block else 0, BATCH):
            q, at, gap = block.nearest(asked[a : a + BATCH], rounds, masks)
            found.append((q + a, at, gap))
        q, at, gap = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3
        return pa.table({"q": asked[q].view(np.int64), "code": codes[at].view(np.int64), "first": held["first"].take(pa.array(at)), "distance": pa.array(gap, pa.int32())})

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) for ``queries`` and ``rows`` of (id, code)."""
    spark = rows.sparkSession
    first = W.partitionBy("code").orderBy("id")
    held = materialise(rows.where("id IS NOT NULL AND code IS NOT NULL").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n"), "members")
    index = materialise(held.groupBy("code").agg(F.min("id").alias("first")), "index")
    wanted = materialise(queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("of")).distinct(), "queries")
    asked = materialise(wanted.select(F.col("of").alias("code")).distinct(), "asked")
    n = index.count()
    blocks, tasks = max(1, n // BLOCK), max(1, asked.count() // ASKED)
    parts = cuts(n // blocks, bits)
    rounds = _levels(n // blocks, parts)
    asks = sorted({(parts[s][1], level) for level, own in rounds for s in own if level})
    flips = spark.range(1).select(F.lit(0), *(_flips(*a) for a in asks)).first()
    masks = {(width, 0): np.zeros(1, dtype=np.int64) for _, width in parts} | {a: np.array(f, dtype=np.int64) for a, f in zip(asks, flips[1:])}
    place = lambda many: F.pmod(F.xxhash64("code"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    kind = index.schema["first"].dataType
    met = index.select(place(blocks).alias("block"), every(tasks).alias("task"), "code", "first").union(asked.select(every(blocks), place(tasks), "code", F.lit(None).cast(kind)))
    dealt = met.repartition(min(blocks * tasks, 4096), "block", "task")  # a group is small, but work
    near = dealt.groupBy("block", "task").applyInArrow(_search(k, parts, rounds, masks), f"q long, code long, first {kind.simpleString()}, distance int")
    best = lambda df, *order: df.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    # of k codes that come before another by distance and first id, each has an id before its ids
    found = best(best(near, "distance", "first", "code").select("q", "code", "distance").hint("merge").join(held, "code").select("q", "id", "distance"), "distance", "id")
    named = wanted.join(found, F.col("of") == F.col("q"))
    return named.select("query_id", F.col("id").alias("neighbour_id"), F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.when(F.col("embedding").isNotNull(), sign_code(F.col("embedding"))).alias("code"))
    return top_k(rows.where(F.col("id") % EVERY == 0), rows)


SQL = """
WITH c AS (SELECT vec_id AS id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN coalesce(embedding[i + 1], 0) > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END), lambda a, b: a | b) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.id AS query_id, c.id AS neighbour_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance FROM (SELECT DISTINCT * FROM c WHERE id % 100 = 0) q, c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
SELECT query_id, neighbour_id, distance, rank FROM r WHERE rank <= 10
"""
