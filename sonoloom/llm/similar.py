"""SimHash near-duplicates with a check of similarity: five-word shingle sets alike by 0.8 or more (Jaccard).

A change of one word changes five shingles, so fingerprints of shingles move far (10 of 64 bits at 0.8). Candidates
therefore come from fingerprints of the text's distinct words, 128 bits wide, which stay near: a covering
LSH (see ``simhash``) over four parts of 32 bits finds every pair within ``RADIUS`` bits, with 15 masks a part.
Texts connected by such pairs form a group; inside a group the shingle sets are compared exactly, and
only texts whose similarity is reached are linked. Components over these links are near-duplicates.

So no link inside a group is lost or added; a similar pair is lost only if its words' fingerprints are more than
``RADIUS`` bits apart and no chain of others joins them (README gives the measured share). Groups are dealt into pairs of chunks of
bounded size, so no task holds a large group.

Defined results: words are parted by ASCII white space, A-Z count as a-z; a text under five words is one
shingle; null text and text without words have the empty set, alike only among themselves. Hashes of shingles
have 64 bits, of sets too. Equal rows get equal results; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sonoloom.llm.hashing import _LOWER
from sonoloom.llm.simhash import _edges, components, covering_links, in_chunks, one_of_each, pair_forest, runs
from sonoloom.llm.substring import PIECE_BYTES, _cut, runs_of, word_hashes
from sonoloom.plans.scratch import materialise, small_batches

SHINGLE, RADIUS, PARTS = 5, 15, 2
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Shingles in a chunk of a group.
CHUNK = 1 << 17


def shingles(text: str | None, size: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of the shingles, 128-bit fingerprint of the distinct words) of a whole text, a piece at a time."""
    found, words, first = [], [], None
    for piece, behind, own in _cut((text or "").encode().translate(_LOWER), SHINGLE, size):
        h = word_hashes(piece)[0]
        first = h if first is None else first
        words.append(np.unique(h[behind : behind + own], axis=0) if own else h[:0])
        if len(h) >= SHINGLE:
            found.append(np.unique(runs_of(h, SHINGLE, 0)))
    found = found or [runs_of(first, max(1, len(first)), 0)]  # under five words, the first piece has them all
    once = np.unique(np.concatenate(words), axis=0) if len(words) > 1 else words[0]
    votes = np.zeros(128, dtype=np.int64)
    for at in range(0, len(once), 1 << 16):
        votes += np.unpackbits(np.ascontiguousarray(once[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    sets = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    return sets, np.packbits(2 * votes > len(once)).view("<i8")


def set_key(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), dtype=np.uint64).view(np.int64)) if len(s) else 0


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, node, size, low, high): ``node`` names the set of shingles, low and high are the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingles(t.as_py()) for t in b.column(2)]
            print_ = np.array([f for _, f in held], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([set_key(s) for s, _ in held], pa.int64()), pa.array([len(s) for s, _ in held], pa.int64()), pa.array(print_[:, 0]), pa.array(print_[:, 1])],
                ["doc_id", "text_key", "node", "size", "low", "high"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, text_key long, node long, size long, low long, high long")


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the sets (sorted, distinct) that are similar enough."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(of, kind="stable")
    many = np.bincount(of)
    first, holders, begin = np.cumsum(many) - many, owner[order], np.cumsum(sizes) - sizes
    edges, left = [], np.ones(len(sets), dtype=bool)
    for i in range(len(sets)):
        if not left[i]:
            continue
        queue, left[i] = [i], False
        while queue and left.any():
            k = queue.pop()
            own = of[begin[k] : begin[k] + sizes[k]]
            n = many[own]
            at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(holders[at], minlength=len(sets))
            near = np.flatnonzero(left & ((OVER + UNDER) * shared >= OVER * (sizes + sizes[k])))
            edges += [(k, int(j)) for j in near]
            queue += near.tolist()
            left[near] = False
    return edges


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, 3):
        left, node, held = t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5)
        _, once = np.unique(node, return_index=True)

        def forest(at: np.ndarray) -> list[tuple[int, int]]:
            return [(int(node[at[i]]), int(node[at[j]])) for i, j in linked([np.frombuffer(held[int(k)].as_buffer(), dtype="<u8") for k in at])]

        yield _edges(pair_forest(forest, once[left[once]], once[~left[once]]))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([shingles(t.as_py())[0].tobytes() for t in b.column(3)], pa.binary())], ["root", "n", "node", "set"])


def links(docs: DataFrame, id_col: str, text_col: str, keyed: DataFrame) -> DataFrame:
    """(a, b): links between the nodes of ``keyed``, a written table, that connect what all links connect."""
    nodes = materialise(keyed.groupBy("node").agg(F.min("text_key").alias("text_key"), *(F.first(c).alias(c) for c in ("size", "low", "high"))), "nodes")
    near = components(covering_links(nodes, RADIUS, code=("low", "high"), parts=PARTS))
    grouped = nodes.join(near.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select("node", "text_key", "size", "root")
    sizes = grouped.groupBy("root").agg(F.sum("size").alias("n"))
    # of all copies of a text the one with the smallest id is asked for, so the join has no hot key
    one = keyed.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("k")).select("text_key", F.col("k.doc_id").alias("wanted_id"))
    wanted = materialise(grouped.join(sizes, "root").join(one, "text_key").select("root", "n", "node", "text_key", "wanted_id"), "wanted")
    own = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own_key"), F.col(id_col).alias("own_id"))
    texts = own.join(wanted.hint("merge"), (F.col("own_key") == F.col("text_key")) & F.col("own_id").eqNullSafe(F.col("wanted_id"))).select("root", "n", "node", "text")
    sets = materialise(texts.mapInArrow(_sets, "root long, n long, node long, set binary").dropDuplicates(["node"]), "sets")
    pairs = in_chunks(sets, ["root"], F.ceil(F.col("n") / CHUNK).cast("int"), ["node", "set"])
    return pairs.mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, root), one row per row of ``docs``; root names the component over links."""
    small_batches(docs.sparkSession)
    keyed = materialise(_keyed(docs, id_col, text_col), "shingled")
    roots = components(links(docs, id_col, text_col, keyed))
    return keyed.select("doc_id", "text_key", "node").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, chosen as in ``simhash.one_of_each``."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
