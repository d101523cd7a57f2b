"""Benchmark decontamination by a prefix-filtered set join.

Every item gives windows of ``window`` consecutive words (a shorter item is one window). A window's
shingles are ordered by rarity, counted over the whole corpus. As a window must be contained whole, one
prefix token is necessary and enough to join on: its rarest shingle. A document position that holds this
shingle fixes where the window would start (positional bound); it must lie inside the document (length
bound); and its words are compared one by one (exact containment).

The index holds the words of the items, so it is broadcast only in blocks of ``block_words`` words at
most (an item is never split); more items mean more passes over the documents, whose hits are united.

Defined results: null text and text without words have no words, no hits and no items; an item without
words has no windows; an item of over two million different words is an error; words of an item without an id are hit, but it is not listed; items that repeat an
id count once; equal rows get equal results; empty tables on either side are allowed; other columns play
no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sonoloom.plans.naming import fresh
from sonoloom.plans.scratch import materialise, small_batches

WINDOW, SHINGLE = 10, 3
#: Words of items that one broadcast index may hold, and bytes of documents looked at once.
BLOCK_WORDS, STEP = 400_000, 1 << 19
#: A-Z become a-z; other ASCII but digits and letters becomes a blank; bytes of longer characters stay.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def _chunks(texts: Iterable[str | None], vocab: dict[bytes, int]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """(word numbers, words of each document); a 0 stands for any word outside the vocabulary and after each document."""
    words: list[bytes] = []
    sizes: list[int] = []
    size = 0
    for t in texts:
        own = words_of(t)
        words += own
        words.append(b"")
        sizes.append(len(own))
        size += len(t or "")
        if size >= STEP:
            yield np.fromiter(map(vocab.get, words, repeat(0)), np.int64, len(words)), sizes
            words, sizes, size = [], [], 0
    if sizes:
        yield np.fromiter(map(vocab.get, words, repeat(0)), np.int64, len(words)), sizes


def _keys(ids: np.ndarray, length: int) -> np.ndarray:
    """One exact number for each run of ``length`` words; 0 where a word is outside the vocabulary."""
    n = len(ids) - length + 1
    if n <= 0:
        return ids[:0]
    key, known = ids[:n].copy(), ids[:n] > 0
    for i in range(1, length):
        key = (key << 21) | ids[i : n + i]
        known &= ids[i : n + i] > 0
    return np.where(known, key, 0)


class _Index:
    """Windows of a block of items, as word numbers, and their prefix shingles."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        self.window, owners = window, defaultdict(set)
        for item_id, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text))
            if len(self.vocab) >= 1 << 21:
                raise ValueError("a block of items, or one item, has over two million different words; give smaller items")
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[ids[i : i + window]] |= {item_id} - {None}
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.spans = sorted({min(shingle, len(w)) for w in self.windows})
        self.shingles = {n: np.unique(np.concatenate([_keys(np.array(w), n) for w in self.windows if min(shingle, len(w)) == n])) for n in self.spans}
        self.shingle = shingle

    def count(self, texts: Iterable[str | None]) -> dict[int, np.ndarray]:
        found = {n: np.zeros(len(s), dtype=np.int64) for n, s in self.shingles.items()}
        for ids, _ in _chunks(texts, self.vocab):
            for n, s in self.shingles.items():
                key = _keys(ids, n)
                at = _find(s, key[key > 0])
                found[n] += np.bincount(at[at >= 0], minlength=len(s))
        return found

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle as the one to join on; of equally rare ones the smallest number."""
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}
        chosen = defaultdict(list)
        for w, ids in enumerate(self.windows):
            n = min(self.shingle, len(ids))
            keys = _keys(np.array(ids), n)
            rarity = counts[n][_find(self.shingles[n], keys)]
            offset = int(np.lexsort((keys, rarity))[0])
            chosen[n].append((int(keys[offset]), offset, w))
        for n, rows in chosen.items():
            key, offset, w = (np.array(c, dtype=np.int64) for c in zip(*sorted(rows)))
            own, first, many = np.unique(key, return_index=True, return_counts=True)
            self.prefix[n] = own, first, many, offset, w
        self.size = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.words = np.zeros((len(self.windows), self.window), dtype=np.int64)
        for w, ids in enumerate(self.windows):
            self.words[w, : len(ids)] = ids

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every window that occurs in ``ids``."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (own, first, many, offset, window) in self.prefix.items():
            key = _keys(ids, n)
            at = np.flatnonzero(key)
            of = _find(own, key[at])
            at, of = at[of >= 0], of[of >= 0]
            row = np.repeat(first[of] - np.cumsum(many[of]) + many[of], many[of]) + np.arange(many[of].sum())
            start, w = np.repeat(at, many[of]) - offset[row], window[row]
            inside = (start >= 0) & (start + self.size[w] <= len(ids))
            start, w = start[inside], w[inside]
            for i in range(self.window):
                same = (i >= self.size[w]) | (ids[np.minimum(start + i, len(ids) - 1)] == self.words[w, i])
                start, w = start[same], w[same]
            starts.append(start)
            found.append(w)
        return np.concatenate(starts), np.concatenate(found)

    def hits(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[dict], list[str]]]:
        for ids, sizes in _chunks(texts, self.vocab):
            start, w = self.occurrences(ids)
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + self.size[w], -1)
            change = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
            opens, closes = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            begin = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
            of_span, of_hit = np.searchsorted(begin, opens, side="right") - 1, np.searchsorted(begin, start, side="right") - 1
            spans, items = defaultdict(list), defaultdict(set)
            for d, a, b in zip(of_span.tolist(), opens.tolist(), closes.tolist()):
                spans[d].append({"start": a - int(begin[d]), "end": b - int(begin[d])})
            for d, x in set(zip(of_hit.tolist(), w.tolist())):
                items[d].update(self.owners[x])
            for d, n in enumerate(sizes):
                yield n, spans.get(d, []), sorted(items.get(d, ()))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in the sorted ``table``, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _rarity(docs: DataFrame, text_col: str, index: _Index) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents; as many rows come back as it has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value.count(t.as_py() for b in batches for t in b.column(0))
        for n, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(counts[at])], ["n", "at", "c"])

    out = {n: np.zeros(len(s), dtype=np.int64) for n, s in index.shingles.items()}
    for r in docs.select(text_col).mapInArrow(run, "n int, at long, c long").groupBy("n", "at").agg(F.sum("c").alias("c")).collect():
        out[r.n][r.at] = r.c
    return out


def _hits(text: Column, spark: SparkSession, index: _Index) -> Column:
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(HITS)
    def of_batch(texts: pa.Array) -> pa.Array:
        n, spans, items = zip(*shared.value.hits(t.as_py() for t in texts)) if len(texts) else ((), (), ())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return of_batch(text)


def _indexes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, shingle: int, block_words: int) -> Iterator[_Index]:
    """An index for each block of items, ready to use; at least one."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    total = items.agg(F.sum(F.length("t") / 2)).first()[0] or 0  # no more words than that
    blocks = int(total // block_words) + 1
    for b in range(blocks):
        index = _Index([tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()], window, shingle)
        index.order(_rarity(docs, text_col, index))
        yield index


@F.arrow_udf(HITS["spans"].dataType)
def _united(spans: pa.Array) -> pa.Array:
    out = []
    for held in spans.to_pylist():
        own: list[dict] = []
        for s in sorted(held, key=lambda s: (s["start"], s["end"])):
            if own and s["start"] <= own[-1]["end"]:
                own[-1]["end"] = max(own[-1]["end"], s["end"])
            else:
                own.append(dict(s))
        out.append(own)
    return pa.array(out, spans.type)


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items), one row per row of ``docs``; spans are hit word ranges, end exclusive."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("_text"))
    found = []
    for index in _indexes(docs, benchmark, text_col, item_col, item_text, window, shingle, block_words):
        found.append(base.withColumn("_hits", _hits(F.col("_text"), docs.sparkSession, index)).select("doc_id", "text_key", "_hits.*"))
    if len(found) == 1:
        return found[0]
    every = materialise(found[0], "hits")
    for part in found[1:]:
        every = every.unionByName(materialise(part, "hits"))
    joined = every.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), _united(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(found)).cast("int").alias("_copies"),
    )
    return joined.select("*", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "col")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs``, all columns, without documents that hold any window of an item."""
    own, key = fresh(docs, "hit_id", "hit_key")
    hit = find_hits(docs, benchmark, id_col, text_col, **kw).where(F.size("spans") > 0).select(F.col("doc_id").alias(own), F.col("text_key").alias(key)).distinct()
    return docs.join(materialise(hit, "contaminated"), F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(key)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM s),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win)),
k AS (SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM pos),
occ AS (SELECT r, p, k.n, item_id FROM k JOIN win USING (n, k)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
