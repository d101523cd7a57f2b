"""Spelling variants of the words of a corpus, by a dictionary of pairs of trie nodes.

The distinct words stand in two tries, one read forwards and one read backwards. A node is the number of the first
word, in order, that passes it, plus its depth: ``offset of that word + depth``, an integer. A word split before place
i is the pair (node of what precedes i, node of what follows); it names the word exactly. Leaving out the letter at i
gives the pair (node before i, node after i). Then

* two words of equal length that differ at i share the pair that skips i,
* a word from which the letter at i is left out is the word whose own split pair is that pair,

so one grouping on integer pairs meets exactly the words at one replacement, insertion or deletion. A group holds at
most one word for each letter of the alphabet and one split word, so it is bounded, and each member gets one row: the
count of its near words there and the best of them. No pair of words is emitted.

The tries are built from range partitions of the sorted words; a partition inherits from the ones before it the
nodes on the path to its first word. The driver sees one first word, one last word and one path for each partition of
about ``WORDS_PER_PART`` words.

Defined results: a null text has no words; a null id counts as the empty text in ``<doc_id>:<run>``; rows that repeat
count again; no documents or no words give an empty table; other columns play no part. Texts of any length are read in
chunks cut between words; a word's rows grow with its length, not with its square.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoloom.plans.scratch import materialise, small_batches

MODULUS, LEAST_LETTERS, LEAST_COUNT, FACTOR = 97, 5, 3, 2
WORDS_PER_PART = 20_000
#: Bytes of text that are counted at once.
STEP = 1 << 21
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ASCII = np.array([97 <= c <= 122 for c in range(256)])
_TAIL = np.array([0x80 <= c <= 0xBF for c in range(256)])
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one of _TAIL


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased UTF-8 belong to the letters a-z and U+00C0 to U+00FF."""
    wide = np.zeros(len(raw), dtype=bool)
    wide[1:] = (raw[:-1] == _LEAD) & _TAIL[raw[1:]]
    mine = _ASCII[raw] | wide
    mine[:-1] |= wide[1:]
    return mine


def _parts(text: bytes) -> Iterator[bytes]:
    """A lower-cased text in parts of about ``STEP`` bytes, cut at a byte that is in no word."""
    at = 0
    while len(text) - at > STEP:
        end = at + STEP
        while end < len(text):
            gaps = np.flatnonzero(~_letters(np.frombuffer(text[end - 1 : end + STEP], dtype=np.uint8))[1:])
            if len(gaps):
                end += int(gaps[0])
                break
            end += STEP
        yield text[at:end]
        at = end
    yield text[at:]


def _count(modulus: int):
    """Counts of the words of some documents: (word, n), a word more than once."""

    def counted(texts: list[bytes], ids: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        mine = _letters(raw)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mine])))
        start, size = edge[0::2], edge[1::2] - edge[0::2]
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(raw[mine])).dictionary_encode()
        known, of = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        # crc32(a + b) = crc32(zeros of b's length, crc32(a)) ^ crc32(those zeros) ^ crc32(b)
        own = np.array([zlib.crc32(w.encode()) for w in known], dtype=np.uint32)
        widths, width = np.unique(size, return_inverse=True)
        pair, where = np.unique(doc.astype(np.int64) * len(widths) + width, return_inverse=True)
        heads = [zlib.crc32(i + b":") for i in ids]
        zeros = bytes(int(widths[-1])) if len(widths) else b""
        blank = [zlib.crc32(zeros[:w]) for w in widths.tolist()]
        moved = np.array([zlib.crc32(zeros[: widths[k % len(widths)]], heads[k // len(widths)]) ^ blank[k % len(widths)] for k in pair.tolist()], dtype=np.uint32)
        h = moved[where] ^ own[of] if len(of) else own
        hit = h % modulus == 0
        counts = np.bincount(of[~hit], minlength=len(known))
        found, n = [known[k] for k in np.flatnonzero(counts)], counts[counts > 0].tolist()
        both, times = np.unique(of[hit].astype(np.int64) << 32 | h[hit].astype(np.int64), return_counts=True)
        for k, t in zip(both.tolist(), times.tolist()):
            w = known[k >> 32]
            at = (k & 0xFFFFFFFF) % len(w)
            found.append(w[:at] + w[at + 1 :])
            n.append(t)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, size = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for part in _parts((text.as_py() or "").encode().translate(_LOWER)):
                    texts.append(part)
                    ids.append((doc_id or "").encode())
                    size += len(part)
                    if size >= STEP:
                        yield counted(texts, ids)
                        texts, ids, size = [], [], 0
        if texts:
            yield counted(texts, ids)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with at least ``letters`` code points and ``least`` occurrences."""
    small_batches(docs.sparkSession)
    counted = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(_count(modulus), "word string, n long")
    return counted.where(F.char_length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _paths(rows: pa.Table) -> pa.Table:
    """Local nodes of the sorted words of one part; the offset of a word is the number of letters of those before it."""
    order = np.argsort(np.array([w.encode() for w in rows["w"].to_pylist()], dtype=object), kind="stable")
    rows = rows.take(pa.array(order))
    words, nodes, ends, firsts, before, path, offset = rows["w"].to_pylist(), array("q"), [0], bytearray(), "", array("q"), 0
    for w in words:
        shared = len(os.path.commonprefix([before, w]))
        path = path[:shared] + array("q", range(offset + shared + 1, offset + len(w) + 1))
        nodes.extend(path)
        firsts.extend(i == 0 or w[i - 1] != c for i, c in enumerate(w))
        offset += len(w)
        ends.append(offset)
        before = w
    n = len(words)
    lists = lambda flat: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return pa.table({
        "part": rows["part"], "place": pa.array(range(n), pa.int64()), "w": rows["w"], "key": rows["key"], "n": rows["n"], "nodes": lists(pa.array(np.frombuffer(nodes, dtype=np.int64))),
        "firsts": lists(pa.array(np.frombuffer(firsts, dtype=np.bool_))), "letters": pa.array([offset] * n, pa.int64()),
    })


def _numbered(words: DataFrame, n_words: int, name: str) -> DataFrame:
    """``words`` (w, key, n) with the trie nodes of w, depths 1 and up, and its place in the order of all (``rank``)."""
    spark = words.sparkSession
    parts = max(1, -(-n_words // WORDS_PER_PART))
    ranged = words.repartitionByRange(parts, "w").withColumn("part", F.spark_partition_id())
    schema = "part int, place long, w string, key string, n long, nodes array<long>, firsts array<boolean>, letters long"
    local = materialise(materialise(ranged, f"{name}_ranges").groupBy("part").applyInArrow(lambda rows: _paths(rows), schema), name)
    ends = local.groupBy("part").agg(F.min_by("w", "place").alias("first"), F.max_by(F.struct("w", "nodes"), "place").alias("last"), F.max("letters").alias("letters"))
    known, base, before, path = [], 0, "", []
    for e in ends.orderBy("part").collect():  # one row for each part
        held = path[: len(os.path.commonprefix([before, e["first"]]))]
        known.append((e["part"], base, held))
        before, path = e["last"]["w"], [held[x - 1] if x <= len(held) else base + x for x in e["last"]["nodes"]]
        base += e["letters"]
    carried = spark.createDataFrame(known, "part int, base long, held array<long>")
    fixed = F.transform("nodes", lambda x: F.when(x <= F.size("held"), F.try_element_at("held", x.cast("int"))).otherwise(F.col("base") + x))
    rank = F.shiftleft(F.col("part").cast("long"), 40) + F.col("place")
    return local.join(F.broadcast(carried), "part").select("w", "key", "n", fixed.alias("nodes"), "firsts", rank.alias("rank"))


def near_words(vocab: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary of distinct (word, n)."""
    words = materialise(vocab.select(F.col("word").alias("w"), F.col("word").alias("key"), "n"), "words")
    n_words = words.count()
    ahead = materialise(_numbered(words, n_words, "trie_ahead").drop("key"), "trie")
    back = _numbered(ahead.select(F.reverse("w").alias("w"), F.col("rank").cast("string").alias("key"), "n"), n_words, "trie_back")
    split = materialise(ahead.join(back.select(F.col("key").cast("long").alias("rank"), F.col("nodes").alias("after")), "rank"), "split")
    size, zero = F.size("nodes"), F.lit(0).cast("long")
    before = lambda i: F.when(i == 0, zero).otherwise(F.try_element_at("nodes", i))
    after = lambda i: F.when(i == size, zero).otherwise(F.try_element_at("after", size - i))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(before(i).alias("p"), after(i + 1).alias("s"), F.lit(False).alias("whole"), F.try_element_at("firsts", i + 1).alias("joins")))
    wholes = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(before(i).alias("p"), after(i).alias("s"), F.lit(True).alias("whole"), F.lit(False).alias("joins")))
    pairs = split.select("rank", (-F.col("n")).alias("m"), F.inline(F.concat(skips, wholes)))
    # A group: at most one skipping word for each letter and one whole word. A deletion from a run of equal letters counts at the run's start only.
    met = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("m", "rank", "whole", "joins")).alias("held")).where(F.size("held") > 1)
    near = lambda a, b: (a["rank"] != b["rank"]) & (~a["whole"] & ~b["whole"] | a["whole"] & b["joins"] | b["whole"] & a["joins"])
    mine = F.transform("held", lambda a: F.struct(a["rank"].alias("rank"), F.transform(F.filter("held", lambda b: near(a, b)), lambda b: F.struct(b["m"].alias("m"), b["rank"].alias("rank"))).alias("near")))
    seen = met.select(F.inline(mine)).where(F.size("near") > 0).select("rank", F.size("near").alias("n"), F.array_min("near").alias("best"))
    best = seen.groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))
    joined = ahead.select("rank", F.col("w").alias("word"), "n").join(best, "rank", "left")
    fits = -F.col("best.m") >= factor * F.col("n")
    linked = materialise(joined.select("rank", "word", "n", F.coalesce("n_near", zero).alias("n_near"), F.when(fits, F.col("best.rank")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "linked")
    roots = _roots(linked.where("form IS NOT NULL").select("rank", F.col("form").alias("root")))
    named = linked.select(F.col("rank").alias("_r"), F.col("word").alias("_w"))
    of = lambda c, out: named.select(F.col("_r").alias(c), F.col("_w").alias(out))
    found = linked.join(roots, "rank", "left").join(of("form", "form_word"), "form", "left").join(of("root", "root_word"), "root", "left")
    return found.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(rank, root): links followed to the end by doubling. Counts at least double along a link, so six rounds are enough for any long count."""
    now = materialise(links, "roots")
    while True:
        ahead = now.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        now = materialise(now.join(ahead, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("rank", "root")
        now = now.drop("moved")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_words(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))
