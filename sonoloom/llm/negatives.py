"""Hard negatives of embeddings, by coordinate pruning over length buckets.

The rows stand in an index of blocks sorted by vector length, longest first; a block holds for each coordinate the list of
its unit vectors in order. For an anchor and a least score t, a block whose longest vector cannot reach t is passed
over. Otherwise t becomes an angle, and a unit vector within that angle of the anchor's has each coordinate
in a closed range around the anchor's own. The ranges of the anchor's largest coordinates (the focus) are cut out of the sorted
lists and intersected; what is left is verified by its integer inner product.

The least score is the k-th best found so far. It grows from block to block inside a task, and from round to
round: a round takes as many blocks as ``GROWTH`` times those before it, so a task of a later round gives only rows that beat the
earlier ones. First the positives are found, then, with their scores as bounds, the negatives of
all positives of an anchor in one look at each block.

Anchors are a stated set; they are packed into blocks of at most ``QUERY_BYTES`` and each goes to all index
blocks by broadcast. Rows of one label with the same vector are one index entry with their first ids, so many copies of
a vector cost what one costs.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; equal rows
count once; of rows that share an id, each is an anchor and a candidate, but not of its own id; a vector shorter than the longest one
has zeros for the rest, and an empty one scores 0; scores beyond a long are cut to its ends; no anchors or no positives give no rows; other
columns play no part.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sonoloom.plans.scratch import materialise

POSITIVES, NEGATIVES, LOW, HIGH, EVERY, SCALE, LABELS, SHIFTED = 5, 10, 30, 90, 100, 256, 10, 7
#: Rows of an index block, bytes of a block of anchors, blocks of a round per block before it, coordinates in the focus.
BLOCK_ROWS, QUERY_BYTES, GROWTH, FOCUS = 4096, 1 << 23, 8, 4
_SAFE = 2**53
_MOST = 2**63 - 1


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as held:
        return {k: held[k] for k in held.files}


def _matrix(vectors: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where they are, else in Python's integers."""
    if rows.size and float(np.abs(rows).max()) * float(np.abs(q).max()) * rows.shape[1] >= _SAFE:
        return np.clip((rows.astype(object) @ q.astype(object)), -_MOST, _MOST).astype(np.int64)
    return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)


class _Block:
    """Vectors of similar length with a sorted list for each coordinate of their unit vectors."""

    def __init__(self, raw: bytes) -> None:
        held = _unpacked(raw)
        self.vectors, self.labels, self.ids, self.first, self.order = (held[k] for k in ("vectors", "labels", "ids", "first", "order"))
        size = np.linalg.norm(self.vectors.astype(np.float64), axis=1)
        self.longest = float(size.max(initial=0.0))
        unit = self.vectors / np.where(size > 0, size, 1)[:, None]
        self.lists = np.take_along_axis(unit.T, self.order.astype(np.int64), axis=1)

    def candidates(self, q: np.ndarray, least: float) -> np.ndarray:
        """Places of the rows that may score ``least`` or more with ``q``; a rounding margin lets a few more in."""
        everyone = np.arange(len(self.vectors))
        size = float(np.linalg.norm(q.astype(np.float64)))
        if least <= 0:
            return everyone
        if size * self.longest * (1 + 1e-9) < least:
            return everyone[:0]
        angle = np.arccos(min(1.0, least / (size * self.longest))) + 1e-6
        unit = q / size
        hits, used = np.zeros(len(everyone), dtype=np.int8), 0
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            mine = float(np.arccos(np.clip(unit[f], -1, 1)))
            low, high = np.cos(min(np.pi, mine + angle)) - 1e-6, np.cos(max(0.0, mine - angle)) + 1e-6
            a, b = np.searchsorted(self.lists[f], low, side="left"), np.searchsorted(self.lists[f], high, side="right")
            if b - a == len(everyone):
                continue
            hits[self.order[f, a:b]] += 1
            used += 1
        return np.flatnonzero(hits == used) if used else everyone

    def ranked(self, at: np.ndarray, scores: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the rows at these places without id ``own``, best first."""
        n = self.first[at + 1] - self.first[at]
        of = np.repeat(np.arange(len(at)), n)
        ids = self.ids[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(len(of))]
        keep = ids != own
        ids, s = ids[keep], scores[of[keep]]
        order = np.lexsort((ids, -s))
        return s[order], ids[order]


def _best(held: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    s, ids = np.concatenate([held[0], found[0]]), np.concatenate([held[1], found[1]])
    order = np.lexsort((ids, -s))[:k]
    return s[order], ids[order]


_NONE = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
FOUND = "anchor long, slot int, score long, id long"


def _search(k: int, same: bool):
    """Rows of (anchor blocks, index block), both packed, to the best ``k`` of each anchor and slot that beat its floor.

    A slot is a band of scores, low to high; its floor is the k-th best score of earlier rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, dict] = {}
        for b in batches:
            for part, anchors, raw in zip(*(b.column(c) for c in ("part", "anchors", "payload"))):
                part = part.as_py()
                if part not in asked:
                    asked[part] = a = _unpacked(anchors.as_py())
                    a["best"] = [_NONE] * len(a["low"])
                a, block = asked[part], _Block(raw.as_py())
                best, low, high, floor = a["best"], a["low"], a["high"], a["floor"]
                for i in range(len(a["anchor"])):
                    slots = range(a["slots"][i], a["slots"][i + 1])
                    if not slots:
                        continue
                    at = block.candidates(a["vectors"][i], float(min(max(low[j], floor[j]) for j in slots)))
                    at = at[(block.labels[at] == a["labels"][i]) == same]
                    if not len(at):
                        continue
                    s, ids = block.ranked(at, _products(block.vectors[at], a["vectors"][i]), a["ids"][i])
                    for j in slots:
                        begin = np.searchsorted(-s, -high[j], side="left")
                        end = np.searchsorted(-s, -max(low[j], floor[j]), side="right")
                        if begin < end:
                            best[j] = _best(best[j], (s[begin : min(end, begin + k)], ids[begin : min(end, begin + k)]), k)
                            if len(best[j][0]) == k:
                                floor[j] = max(floor[j], best[j][0][-1])
        for a in asked.values():
            slots = np.diff(a["slots"])
            anchor, slot = np.repeat(a["anchor"], slots), np.arange(len(a["low"])) - np.repeat(a["slots"][:-1], slots)
            n = np.array([len(x[0]) for x in a["best"]], dtype=np.int64)
            score, ids = (np.concatenate([x[c] for x in a["best"]] or [_NONE[0]]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor, n), pa.int64()), pa.array(np.repeat(slot, n), pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], ["anchor", "slot", "score", "id"])

    return run


def _index_blocks(dims: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, rows):
                part = b.slice(begin, rows)
                vectors, ids = _matrix(part.column("vec").to_pylist(), dims), part.column("ids").to_pylist()
                size = np.linalg.norm(vectors.astype(np.float64), axis=1)
                order = np.argsort((vectors / np.where(size > 0, size, 1)[:, None]).T, axis=1, kind="stable").astype(np.int32)
                narrow = np.int16 if np.abs(vectors).max(initial=0) < 2**15 else np.int64
                payload = _packed(vectors=vectors.astype(narrow), labels=part.column("label").to_numpy(), ids=np.array([x for v in ids for x in v], dtype=np.int64), first=np.cumsum([0, *map(len, ids)]), order=order)
                yield pa.RecordBatch.from_arrays([pa.array([float(size.max())]), pa.array([payload], pa.binary())], ["longest", "payload"])

    return run


def build_index(rows: DataFrame, dims: int, copies: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(block, payload), longest vectors first, and how many blocks; of equal vectors of one label, the first ``copies`` ids.

    A range of lengths is a block; where it came out larger than ``block_rows``, it has several rows.
    """
    first = W.partitionBy("label", "vec").orderBy("id")
    held = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= copies).groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialise(held.withColumn("longest", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "entries")
    n = entries.count()
    parts = max(1, -(-n // block_rows))
    spread = entries.repartitionByRange(parts, F.desc("longest"), F.xxhash64("ids")).sortWithinPartitions(F.desc("longest"), F.xxhash64("ids"))
    index = materialise(spread.mapInArrow(_index_blocks(dims, block_rows), "longest double, payload binary").select(F.spark_partition_id().alias("block"), "payload"), "index")
    return index, parts if n else 0


def _asked(dims: int):
    """Anchors of one part, packed: their slots are ``low``, ``high`` and ``floor`` one after the other."""

    def run(rows: pa.Table) -> pa.Table:
        bands = rows["bands"].to_pylist()
        flat = [x for v in bands for x in v]
        payload = _packed(
            anchor=rows["anchor"].to_numpy(), ids=rows["id"].to_numpy(), labels=rows["label"].to_numpy(), vectors=_matrix(rows["vec"].to_pylist(), dims),
            slots=np.cumsum([0, *map(len, bands)]), **{c: np.array([x[c] for x in flat], dtype=np.int64) for c in ("low", "high", "floor")},
        )
        return pa.table({"part": rows["part"][:1], "anchors": pa.array([payload], pa.binary())})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each anchor and slot."""
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bands_after(bands: DataFrame, best: DataFrame, k: int) -> DataFrame:
    kth = best.where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("kth"))
    return bands.join(kth, ["anchor", "slot"], "left").withColumn("floor", F.coalesce(F.greatest("floor", "kth"), "floor")).drop("kth")


def _retrieve(anchors: DataFrame, bands: DataFrame, index: DataFrame, n_blocks: int, parts: int, dims: int, k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id, rank): the best ``k`` rows of each band (anchor, slot, low, high), of the anchor's label or of others."""
    bands = bands.withColumn("floor", F.col("low"))
    best, done = None, 0
    while done < n_blocks:
        upto = min(n_blocks, done + max(1, done * GROWTH))
        floors = bands if best is None else _bands_after(bands, best, k)
        listed = floors.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high", "floor"))).alias("bands"))
        packed = materialise(anchors.join(listed, "anchor").groupBy("part").applyInArrow(_asked(dims), "part int, anchors binary"), "anchors")
        blocks = index.where((F.col("block") >= done) & (F.col("block") < upto))
        found = best.drop("rank") if best is not None else None
        for part in range(parts):
            one = F.broadcast(packed.where(F.col("part") == part))  # at most QUERY_BYTES of vectors
            now = blocks.withColumn("part", F.lit(part)).join(one, "part").mapInArrow(_search(k, same), FOUND)
            found = now if found is None else found.unionByName(now)
        best, done = materialise(_top(found, k), "best"), upto
    return best


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` of (id long, label int, vec array<long>).

    An anchor's positives are its first ``positives`` other rows of its label. For each, the first ``negatives`` rows of
    other labels whose score, in hundredths of the positive's, lies from ``low`` to ``high``.
    """
    spark = rows.sparkSession
    kept = materialise(rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").select("id", "label", "vec").distinct(), "vectors")
    dims = kept.agg(F.max(F.size("vec"))).first()[0] or 0
    asked = materialise(kept.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "asked")
    parts = max(1, -(-asked.count() * 8 * dims // query_bytes))
    anchors = asked.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
    index, n_blocks = build_index(kept, dims, max(positives + 1, negatives), block_rows)
    if not n_blocks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    everything = asked.select("anchor", F.lit(0).alias("slot"), F.lit(-_MOST).alias("low"), F.lit(_MOST).alias("high"))
    first = _retrieve(anchors, everything, index, n_blocks, parts, dims, positives, True)
    found = first.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda p: F.col("positive_score").cast("decimal(20,0)") * p / 100
    bands = found.where("positive_score >= 0").select("anchor", "slot", F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high"))
    best = _retrieve(anchors, materialise(bands, "bands"), index, n_blocks, parts, dims, negatives, False)
    named = best.join(found, ["anchor", "slot"]).join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def integer_rows(embeddings: DataFrame, vector: Callable[[Column], Column] = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))) -> DataFrame:
    """(id, label, vec) of ``embeddings``: whole rows only, labels shifted where the id is divisible by ``SHIFTED``."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return whole.select(F.col("vec_id").cast("long").alias("id"), label.cast("int").alias("label"), F.transform("embedding", vector).alias("vec"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives(rows, F.col("id") % EVERY == 0)


SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
