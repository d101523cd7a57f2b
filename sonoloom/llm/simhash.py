"""SimHash near-duplicates by covering locality-sensitive hashing.

Method (Pagh, "CoveringLSH", 2016): every bit position i has a vector phi(i) in {0,1}^(r+1). For each
non-zero v of that space, table v keeps the bits with odd <phi(i), v>. Two words that differ in at
most r positions give r linear conditions on v, so some v keeps none of these positions, and the pair
meets in that table: no pair within the radius is lost.

Defined results: null text and text without words have fingerprint 0, linked like any other; equal
rows get equal results; a null doc_id never is a component's id unless the component has no other;
an empty table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonoloom.plans.naming import fresh
from sonoloom.plans.scratch import materialise, small_batches

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Members of one bucket that one step compares; larger buckets are dealt into chunk pairs.
CHUNK = 512
#: Shingles whose bits are counted at once, which bounds memory for long texts.
STEP = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash: bit set if set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and only ASCII white space
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(digest, joined), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Column of signed 64-bit fingerprints of whole texts."""

    @F.arrow_udf("long")
    def of_batch(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint_of(t.as_py(), shingle, seed) for t in texts), pa.int64())

    return of_batch(text)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; phi runs through the non-zero vectors, so each mask keeps about half of the bits."""
    span = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % span + 1) & v).bit_count() & 1) for v in range(1, span + 1)]


def covering_tables(radius: int, words: int = 1, parts: int = 1) -> list[tuple[int, int]]:
    """(word, signed mask) for codes of ``words`` 64-bit words, each cut into ``parts``: of two codes within the
    radius, some part differs in at most radius / (words * parts) bits, and its masks cover that."""
    width = BITS // parts
    masks = [m << (p * width) for p in range(parts) for m in covering_masks(radius // (words * parts), width)]
    return [(w, m - (1 << 64) if m >> 63 else m) for w in range(words) for m in masks]


def _forest(node: np.ndarray, code: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what the links within the radius connect; at most len(node) - 1 of them."""
    edges, left = [], np.arange(len(node))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(code[left] ^ code[i]).sum(axis=1) <= radius
            edges += [(int(node[i]), int(node[j])) for j in left[near]]
            queue += list(left[near])
            left = left[~near]
    return edges


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``keys`` columns, which are integers, over batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for a, c in zip(cuts, cuts[1:]):
            part = b.slice(a, c - a)
            if held and any(held[-1].column(i)[-1] != part.column(i)[0] for i in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _edges(found: np.ndarray | list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.sort(np.asarray(found, dtype=np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def pair_forest(forest: Callable[[np.ndarray], list[tuple[int, int]]], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what all links in a pair of chunks connect; ``forest`` gives those of some rows, ``left`` and ``right`` have the chunks' rows by node.

    A chunk's own edges do not depend on the other chunk, so they are the same in all its pairs; only parts that they leave get an
    edge across. A group of n rows in k chunks so gives n + k^2 edges if all are alike, not n * k.
    """
    edges = [e for rows in (left, right) if len(rows) for e in forest(rows)]
    if not len(left) or not len(right):
        return edges
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    own = len(edges)
    for n, (i, j) in enumerate([*edges, *forest(np.concatenate([left, right]))]):
        a, b = top(i), top(j)
        if a != b:
            up[a] = b
            if n >= own:
                edges.append((i, j))
    return edges


def _forests(radius: int, few: int = 4):
    """Over partitions sorted by bucket: edges for each run of equal buckets, all links in one of ``few`` rows at most, else a spanning forest."""

    def links(keys: np.ndarray, left: np.ndarray, node: np.ndarray, code: np.ndarray) -> Iterator[np.ndarray]:
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        first, sizes = cuts[:-1], np.diff(cuts)
        for m in range(2, few + 1):
            at = first[sizes == m]
            for i, j in combinations(range(m), 2):
                near = at[np.bitwise_count(code[at + i] ^ code[at + j]).sum(axis=1) <= radius]
                yield np.stack([node[near + i], node[near + j]], axis=1)
        for a, n in zip(first[sizes > few].tolist(), sizes[sizes > few].tolist()):
            own = a + np.argsort(node[a : a + n])
            first_chunk = left[own] == 1
            yield np.array(pair_forest(lambda at: _forest(node[at], code[at], radius), own[first_chunk], own[~first_chunk]), dtype=np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            now = [np.stack(now[:4], axis=1), now[4], now[5], np.stack(now[6:] or now[5:], axis=1).view(np.uint64)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            whole = int(np.flatnonzero((now[0] != now[0][-1]).any(axis=1)).max(initial=-1)) + 1  # the last run may go on
            held = [x[whole:] for x in now]
            yield _edges(np.concatenate([np.zeros((0, 2), np.int64), *links(*(x[:whole] for x in now))]))
        if held is not None:
            yield _edges(np.concatenate([np.zeros((0, 2), np.int64), *links(*held)]))

    return run


def covering_links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, code: tuple[str, ...] = ("node",), parts: int = 1) -> DataFrame:
    """(a, b): a set of links within the radius that connects the same distinct ``node`` as all links do.

    ``code`` names the 64-bit words of a node's code; a bucket of over ``chunk`` nodes is dealt into chunk pairs.
    """
    masks = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(w).alias("w"), F.lit(m).alias("m")) for v, (w, m) in enumerate(covering_tables(radius, len(code), parts))))
    held = list(dict.fromkeys(("node", *code)))
    word = F.element_at(F.array(*code), F.col("t.w") + 1)
    keyed = nodes.select(*held, F.explode(masks).alias("t")).select(*held, F.col("t.v").alias("v"), word.bitwiseAND(F.col("t.m")).alias("k"))
    full = keyed.groupBy("v", "k").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the exploded rows for as small as the nodes, and would broadcast them
    met = in_chunks(keyed.hint("merge").join(full, ["v", "k"]), ["v", "k"], F.ceil(F.col("n") / chunk).cast("int"), held)
    return met.mapInArrow(_forests(radius), "a long, b long").distinct()


def in_chunks(rows: DataFrame, group: list[str], split: Column, held: list[str]) -> DataFrame:
    """``rows`` (group, lo, hi, left, held), dealt and sorted by group and chunk pair: any two of a group's nodes meet in some pair.

    ``left`` is true for the rows of chunk ``lo``.

    A group of more than one chunk has a part for each pair of different chunks, so none is larger than two chunks.
    """
    own = F.pmod(F.xxhash64("node"), split).cast("int")
    others = F.filter(F.sequence(F.lit(0), split - 1), lambda d: (d != F.col("c")) | (split == 1))
    keys = [*group, "lo", "hi"]
    dealt = rows.withColumn("c", own).select(*group, *held, "c", F.explode(others).alias("d")).select(*group, F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), (F.col("c") <= F.col("d")).alias("left"), *held)
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def _lowest(both: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours; ``both`` has each edge in both directions."""
    return both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b): edges that connect what ``edges``, a written table, connect: each node with its smallest neighbour, and of an edge the two ends' smallest neighbours.

    Nodes of a dense group share few smallest neighbours, so its many edges become few besides one for each node.
    """
    low = materialise(_lowest(edges.union(edges.select("b", "a"))), "lowest")
    ends = edges.join(low, F.col("a") == F.col("u")).select(F.col("m").alias("from"), "b").join(low, F.col("b") == F.col("u")).select(F.col("from").alias("a"), F.col("m").alias("b"))
    moved = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return moved.union(low).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``, root the smallest node reachable; by alternating stars.

    Each round replaces the edges by written ones; the rounds grow with the logarithm of the longest path.
    """
    edges = materialise(contracted(materialise(edges, "edges")), "edges")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = _lowest(both)
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
        low2 = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = down.join(low2, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b")
        edges = materialise(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id), one row per row of ``docs``.

    component_id is the smallest id reachable over links, root a fingerprint that names the component.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    keyed = materialise(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), fingerprint(text, shingle, seed).alias("fp")), "fingerprints")
    nodes = materialise(keyed.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(covering_links(nodes.select(F.col("fp").alias("node")), radius))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = materialise(rooted.join(lowest, "root").select(F.col("fp").alias("of"), "root", "component_id"), "classes")
    return keyed.join(classes, F.col("fp") == F.col("of")).select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, chosen as in :func:`one_of_each`."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each ``root`` of ``found`` (doc_id, text_key, root), all columns kept.

    The document with the smallest id stays (a null id only where no other is); of rows that repeat
    that id, the one with the smallest xxHash64 of its text, and any one of rows equal in both.
    """
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "root")).alias("k"))
    own, key = fresh(docs, "kept_id", "kept_key")
    kept = materialise(best.select(F.col("k.doc_id").alias(own), F.col("k.text_key").alias(key)), "kept")
    stays = docs.join(kept.hint("merge"), F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(key)), "left_semi")
    return stays.withColumn(key, F.xxhash64(text_col)).dropDuplicates([id_col, key]).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
