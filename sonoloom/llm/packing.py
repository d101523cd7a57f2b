"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths never exceed the capacity, so the packing is planned on the histogram of lengths, which has at
most ``capacity`` rows however large the corpus is: (1) large lengths, sorted, fall into groups of equal
cardinality, each rounded up to its largest; (2) the few sizes give a cutting-stock programme, solved by
column generation, whose configurations are used as often as its rounded-down solution says; (3) actual
documents are substituted: each place of a configuration takes the longest document left that its rounded
length holds, the last place of several the longest that the sequence itself still holds, so that little is
wasted; (4) what is left, small lengths last, goes into the gaps by best fit, longest first. The plan is a list of
runs "documents number a to b of length l go to sequences c, c+1, ... at offset o"; Spark numbers the
documents of each length and looks up their run.

Defined results: null text is empty and has the end token alone; equal rows are packed as separate
documents; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections import defaultdict
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer

from sonoloom.plans.ranking import gapless_rank
from sonoloom.plans.scratch import materialise, small_batches

CAPACITY, END = 1024, 2
#: Lengths over this share of the capacity are large; they form so many groups.
LARGE_SHARE, GROUPS = 1 / 8, 64
#: Tokens that a configuration's sequence may leave to small documents.
SLACK = 16
#: What a tokenizer's file says, besides its vocabulary and merges, where the fast coder gives the same ids.
PLAIN = {
    "truncation": None, "padding": None, "normalizer": None, "post_processor": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


class _Coder:
    """text -> ids of the vocabulary in a file: a fast coder where it provably agrees, else the file's own library.

    The fast coder merges by rank; that is the file's order of merges if merge i makes token 256 + i, and the file
    says nothing else that decides ids (``PLAIN``). Where no two white-space characters stand together, its
    splitting needs no look-ahead over them.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, pairs = spec["model"].pop("vocab"), [m.split(" ") if isinstance(m, str) else m for m in spec["model"].pop("merges")]
        merged = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs))
        self.plain = merged and all(spec.get(k) == v for k, v in PLAIN.items()) and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if not self.plain:  # the file's own library codes everything
            return
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.fixed = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.fixed}
        pattern = public_tokenizers.PATTERN
        single = pattern.replace(r"|\s+(?!\S)|\s+", r"|\s")
        self.general, self.single = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, single))
        self.pairs = re.compile(r"\s\s")

    @cached_property
    def own(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> array | np.ndarray:
        if self.plain and not any(t in text for t in self.fixed):
            if not self.pairs.search(text):
                return array("I", self.single.encode_ordinary(text))
            try:
                return self.general.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its matching gives up on very long runs of white space
                pass
        return array("I", self.own.encode(text, add_special_tokens=False).ids)


@cache
def _coder(path: str) -> _Coder:
    return _Coder(path)


def token_ids(text: str | None, path: str) -> np.ndarray:
    return np.asarray(_coder(path)(text or ""), dtype="<u4")


def pieces_of(text: Column, path: str, capacity: int = CAPACITY, end: int = END) -> Column:
    """Array of little-endian uint32 id strings: all of ``capacity`` ids but the first, which may be shorter."""

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def of_batch(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            ids = np.append(token_ids(t.as_py(), path), np.uint32(end)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            out.append([p.tobytes() for p in np.split(ids, range(first, len(ids), capacity))])
        return pa.array(out, pa.list_(pa.binary()))

    return of_batch(text)


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, text_key, piece, start, length, ids), one row for each piece; ids are little-endian uint32."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    cut = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), pieces_of(F.col(text_col), path, capacity, end).alias("all"))
    length = F.length("ids") / 4
    first = F.length(F.col("all")[0]) / 4
    return (  # outer: no text is without pieces, and for an inner one Spark would tokenise every text once more, to filter by it
        cut.select("doc_id", "text_key", "all", F.posexplode_outer("all").alias("piece", "ids"))
        .select("doc_id", "text_key", "piece", F.when(F.col("piece") == 0, 0).otherwise(first + (F.col("piece") - 1) * capacity).cast("long").alias("start"), length.cast("long").alias("length"), "ids")
    )


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, how many of each size) of the cutting-stock programme's optimum, times rounded down."""
    k, need = len(sizes), np.array(demand, dtype=float)
    columns = np.diag([float(capacity // s) for s in sizes])
    for _ in range(40 * k):
        prices = np.linalg.solve(columns.T, np.ones(k))
        best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        size, worth = np.array(sizes), prices
        for room in range(min(sizes), capacity + 1):  # unbounded knapsack
            fits = size <= room
            value = best[room - size[fits]] + worth[fits]
            top = int(np.argmax(value))
            if value[top] > best[room - 1] + 1e-12:
                best[room], taken[room] = value[top], np.flatnonzero(fits)[top]
            else:
                best[room], taken[room] = best[room - 1], -1
        if best[capacity] <= 1 + 1e-9:
            break
        new, room = np.zeros(k), capacity
        while room > 0:
            if taken[room] < 0:
                room -= 1
            else:
                new[taken[room]] += 1
                room -= sizes[taken[room]]
        x, d = np.linalg.solve(columns, need), np.linalg.solve(columns, new)
        ratio = np.where(d > 1e-12, x / np.where(d > 1e-12, d, 1), np.inf)
        columns[:, int(np.argmin(ratio))] = new
    times = np.floor(np.linalg.solve(columns, need) + 1e-9).astype(int)
    return [(int(t), columns[:, j].astype(int).tolist()) for j, t in enumerate(times) if t > 0]


class _Plan:
    """Runs of equal bins. A run: (first bin, number of bins, tokens used)."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.runs = capacity, 0, []
        self.taken: dict[int, int] = defaultdict(int)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], count, first, offset))
        self.taken[length] += count

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def best_fit(self, length: int, count: int) -> None:
        while count:
            gap = min((g for g in self.gaps if g >= length), default=None)
            if gap is None:
                per = self.capacity // length
                full, rest = divmod(count, per)
                for n, each in ((full, per), (1 if rest else 0, rest)):
                    if n:
                        first = self.open(n)
                        for i in range(each):
                            self.put(length, n, first, i * length)
                        self.leave(first, n, self.capacity - each * length)
                return
            first, n = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap]
            use = min(n, count)
            self.put(length, use, first, self.capacity - gap)
            self.leave(first, use, gap - length)
            self.leave(first + use, n - use, gap)
            count -= use

    def leave(self, first: int, n: int, gap: int) -> None:
        if n and gap:
            self.gaps[gap].append((first, n))


def plan(counts: dict[int, int], capacity: int = CAPACITY, large_share: float = LARGE_SHARE, groups: int = GROUPS, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, count, first sequence, offset) for all documents of the histogram ``counts``: configurations first, then best fit."""
    out = _Plan(capacity)
    left = {n: c for n, c in counts.items() if n > capacity * large_share and c}
    total, at = sum(left.values()), 0
    joined: dict[int, int] = defaultdict(int)  # rounded size -> documents
    for n in sorted(left, reverse=True):
        end = at + left[n]
        while at < end:  # a group ends where its share is reached, so equal lengths may span groups
            g = at * groups // total
            upto = min(end, -(-(g + 1) * total // groups))
            rounded = n if -(-g * total // groups) >= end - left[n] else rounded  # the length at the group's begin
            joined[rounded] += upto - at
            at = upto
    sizes, demand = list(joined), list(joined.values())
    lengths = sorted(left)

    def longest(room: int, held: list[int]) -> int | None:
        """The longest of the documents left, but for those held, that the room takes."""
        i = bisect_right(lengths, room)
        while i:
            i -= 1
            if left[lengths[i]] > held.count(lengths[i]):
                return lengths[i]
        return None

    for times, pattern in _configurations(sizes, demand, capacity) if sizes else ():
        places = [size for size, many in zip(sizes, pattern) for _ in range(many)]
        while times:
            own: list[int] = []
            for i, size in enumerate(places):
                last = i and i == len(places) - 1
                found = longest(capacity - sum(own) if last else size, own)
                if found:
                    own.append(found)
            if not own or capacity - sum(own) > slack:
                break  # what is left no longer fills this configuration; best fit does better
            n = min(times, *(left[x] // own.count(x) for x in own))
            first, used = out.open(n), 0
            for x in own:
                out.put(x, n, first, used)
                left[x] -= n
                used += x
            out.leave(first, n, capacity - used)
            times -= n
            lengths = [x for x in lengths if left[x]]
    for length in sorted(counts, reverse=True):
        out.best_fit(length, left.get(length, 0) if length in left else counts[length])
    return out.runs


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, salt: str | None = None) -> DataFrame:
    """``pieces``, a written table with ``length``, with sequence_id and offset; ``order`` tells its rows apart."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = sorted(plan(counts, capacity))
    starts = np.array([r[:2] for r in runs], dtype=np.int64).reshape(-1, 2)
    to = np.array([r[3:] for r in runs], dtype=np.int64).reshape(-1, 2)
    keys = (starts[:, 0] << 48) + starts[:, 1]

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        n = number.to_numpy(zero_copy_only=False)
        run = np.searchsorted(keys, (length.to_numpy(zero_copy_only=False) << 48) + n, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(to[run, 0] + n - starts[run, 1]), pa.array(to[run, 1])], ["sequence_id", "offset"])

    ranked = gapless_rank(pieces, "length", order, "_number", sum(counts.values()), salt)
    return ranked.withColumn("_at", place("length", "_number")).select(*(c for c in pieces.columns if c != salt), "_at.sequence_id", "_at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from placed pieces that still have their ids; a sequence has ``capacity`` ids at most."""
    joined = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return joined.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns: each piece's place and a digest of its ids."""
    digested = tokenise(docs).select("doc_id", "text_key", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialise(digested.withColumn("_salt", F.monotonically_increasing_id()), "pieces"), ["doc_id", "text_key", "piece"], salt="_salt").drop("text_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
