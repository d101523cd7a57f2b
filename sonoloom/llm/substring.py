"""Repeated-passage removal by level-wise doubling.

A window of ``window`` words can only repeat if shorter windows inside it repeat. The levels double up
to the window length (35 words: 9, 18, 35). At each level a window is represented by its smallest hash
of that many words; windows whose representative starts once only are dropped, the others go on to the
next level, until the last level is the whole window.

Words are hashed with 128 bits by a mixing function whose key is drawn for each run, no polynomial of their bytes. The levels below the last only rule windows out, with 64 bits;
equal windows have equal hashes, so none is lost. The last level decides with 128 bits, which 10^13
different windows share by chance with a probability under 10^-12.

Texts are cut into pieces of bounded size, each with the ``window`` - 1 words before and behind it, and packed
into blocks of bounded size, one row for each, in a table bucketed by block: texts are shuffled once, and no
task or worker holds more than a block's words. A block sends each hash it holds once, packed by hash range;
the range's task answers with one bit for each hash: does it start in two places or more? So a word
sequence that fills a third of the corpus is one hash for each block, never one group's rows.

Defined results: null text and text without words have no words, an empty kept text and nothing
removed; equal rows remove each other's windows; an empty table gives an empty result; other columns
play no part. A text's kept words are put together in one row, as its input was.
"""

from __future__ import annotations

import re
import secrets as entropy
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoloom.llm.hashing import _mix
from sonoloom.plans.scratch import bucketed, materialise, small_batches

WINDOW, SHORTEST, SEED = 35, 9, 0x9E3779B97F4A7C15
#: Bytes of text in a piece and in a block, and of hashes in a part.
PIECE_BYTES, BLOCK_BYTES, PART_BYTES = 1 << 20, 1 << 21, 1 << 23
#: Odd multipliers, one for each half of a hash.
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
HASHES = "block long, part long, hashes binary, flags binary"
WORD, SPACE = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
MASK, LONG_WORD = (1 << 64) - 1, 64
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
KEY = np.dtype([("low", "<u8"), ("high", "<u8")])


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths from about ``shortest`` up to ``window``, each at most twice the one before."""
    found = [window]
    while found[0] > shortest:
        found.insert(0, -(-found[0] // 2))
    return found


def word_hashes(text: bytes, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((n, 2) halves of the hashes, start, end) of a text's words.

    Eight bytes at a time go through a mixing function (one-to-one, so words of at most eight bytes cannot collide
    in either half); XXH3 hashes words of over ``LONG_WORD`` bytes.
    """
    gap = np.concatenate([[True], _SPACE[np.frombuffer(text, dtype=np.uint8)], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    size = end - start
    lanes = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    h = _mix(np.array([seed & MASK, ~seed & MASK], dtype=np.uint64) + size.astype(np.uint64)[:, None] * np.array(STEPS, dtype=np.uint64))
    at, first = np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        rest = size[at] - first
        lane = lanes[start[at] + first] & np.where(rest < 8, (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(MASK))
        h[at, 0], h[at, 1] = _mix(h[at, 0] ^ lane), _mix(h[at, 1] + lane * np.uint64(STEPS[0]))
        at, first = at[rest > 8], first + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = np.frombuffer(xxhash.xxh3_128_digest(text[start[i] : end[i]], seed), dtype="<u8")
    return h, start, end


def runs_of(h: np.ndarray, length: int, half: int) -> np.ndarray:
    """One half of the hash of each run of ``length`` words: a polynomial of their hashes, which are as good as random."""
    n, base = max(0, len(h) - length + 1), STEPS[half]
    out, have, run, span = None, 0, h[:, half], 1  # run: hashes of ``span`` words; out: of the last ``have`` of the length
    while True:
        if length & span:
            out = run[:n].copy() if out is None else out * np.uint64(pow(base, span, 1 << 64)) + run[have : have + n]
            have += span
        if have == length:
            return out
        run, span = run[:-span] * np.uint64(pow(base, span, 1 << 64)) + run[span:], 2 * span


def _slide(a: np.ndarray, width: int, best, fill: int) -> np.ndarray:
    """best of a[i : i + width] for each i."""
    fill, span = np.uint64(fill), 1

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[k:], np.full(min(k, len(x)), fill)])

    while 2 * span <= width:
        a, span = best(a, ahead(a, span)), 2 * span
    return best(a, ahead(a, width - span)) if span < width else a


class _Block:
    """The pieces of a block; ``alive`` marks the starts of windows still in question, ``own`` those that count here."""

    def __init__(self, row: dict, window: int, seed: int):
        self.text, self.window = zstandard.ZstdDecompressor().decompress(row["z"]), window
        self.h, self.begin, self.end = word_hashes(self.text, seed)
        ends = np.searchsorted(self.begin, np.cumsum(row["size"]))  # of each piece, in words
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sizes, behind = ends - starts, np.array(row["behind"], dtype=np.int64)
        self.bounds = list(zip((starts + behind).tolist(), (starts + behind + np.array(row["own"], dtype=np.int64)).tolist()))
        here, low, high = np.arange(len(self.h)), starts + behind, starts + behind + np.array(row["own"], dtype=np.int64)
        self.alive = here + window <= np.repeat(ends, sizes)
        self.own = (here >= np.repeat(low, sizes)) & (here < np.repeat(high, sizes))

    def level(self, length: int) -> np.ndarray:
        """Places of the runs of ``length`` words that represent the windows alive."""
        n, width = len(self.h), self.window - length + 1
        if not self.alive.any():
            self.least, self.alive = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
            return np.zeros(0, dtype=np.int64)
        self.grams = np.concatenate([runs_of(self.h, length, 0) | np.uint64(1), np.full(length - 1, ~np.uint64(0))])
        self.least = _slide(self.grams, width, np.minimum, 2**64 - 1)
        chosen = _slide(np.where(self.alive, self.least, np.uint64(0))[::-1], width, np.maximum, 0)[::-1]
        return np.flatnonzero((chosen == self.grams) & (chosen > 0))

    def asked(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, how often each starts here, key of each place) of a level; keys in order."""
        at, last = self.level(length), length == self.window
        keys = np.zeros(len(at), dtype=KEY)
        if len(at):
            keys["low"] = self.grams[at]
            keys["high"] = runs_of(self.h, length, 1)[at] if last else 0
        order = np.lexsort((keys["high"], keys["low"])) if last else np.argsort(keys["low"])
        ranked = keys[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        of = np.empty(len(at), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        self.at = at
        return ranked[new], np.bincount(of, self.own[at] if last else None, int(new.sum())).astype(np.int64), of

    def keep(self, repeated: np.ndarray, keys: np.ndarray, of: np.ndarray, length: int) -> None:
        """Only windows whose representative is ``repeated`` stay alive."""
        if length == self.window:
            stays = np.zeros(len(self.h), dtype=bool)
            stays[self.at[repeated[of]]] = True
            self.alive &= stays
            return
        known = keys["low"][repeated]
        if len(known):
            at = np.minimum(np.searchsorted(known, self.least), len(known) - 1)
            self.alive &= known[at] == self.least
        else:
            self.alive[:] = False

    def removed(self) -> np.ndarray:
        edge = np.zeros(len(self.h) + 1, dtype=np.int32)
        edge[:-1] += self.alive
        edge[self.window :] -= self.alive[: max(0, len(edge) - self.window)]
        return np.cumsum(edge[:-1]) > 0


def _behind(text: bytes, start: int, n: int) -> int:
    """Where the ``n`` words before ``start``, the end of a word, begin."""
    size = 64 * n
    while True:
        low = max(0, start - size)
        found = [m.start() for m in WORD.finditer(text, low, start)]
        if len(found) > n or not low:  # the first one found may be cut
            return found[-n] if len(found) >= n else (found or [start])[0]
        size *= 4


def _cut(text: bytes, window: int, size: int) -> Iterator[tuple[bytes, int, int]]:
    """(piece with its neighbours, words before its own, own words) of a text, cut at white space."""
    start, n = 0, window - 1
    while True:
        gap = SPACE.search(text, start + size)
        end = gap.start() if gap else len(text)
        begin = _behind(text, start, n) if start and n else start
        ahead = end
        for _, m in zip(range(n), WORD.finditer(text, end)):
            ahead = m.end()
        yield text[begin:ahead], len(text[begin:start].split()), len(text[start:end].split())
        if end == len(text):
            return
        start = end


#: A block: its texts, one after the other, and for each piece bytes, words before its own, own words, row, number, whether its text was cut, id.
BLOCK = [("block", pa.int64()), ("z", pa.binary()), *((n, pa.list_(t)) for n, t in [("size", pa.int32()), ("behind", pa.int32()), ("own", pa.int32()), ("uid", pa.int64()), ("piece", pa.int32()), ("cut", pa.bool_())])]


def _pack(window: int, piece_bytes: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = TaskContext.get().partitionId() << 33
        block = row = size = 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            texts = [h[0] for h in held]
            z = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            cols = [list(c) for c in zip(*held)]
            values = [high + block, z, [len(t) for t in texts], *cols[1:]]
            schema = pa.schema([*BLOCK, ("ids", pa.list_(kind))])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for b in batches:
            kind = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (text.as_py() or "").encode()
                for number, (piece, behind, own) in enumerate(_cut(raw, window, piece_bytes)):
                    held.append((piece + b" ", behind, own, high + row, number, len(raw) > piece_bytes, doc_id))
                    size += len(piece)
                    if size >= block_bytes:
                        yield flush()
                        held, size, block = [], 0, block + 1
                row += 1
        if held:
            yield flush()

    return run


def _told(row: dict, block: _Block, lengths: list[int], upto: int) -> None:
    """Apply the answers of the levels below ``upto``."""
    answers: dict[int, list] = {}
    for a in row["answers"] or []:
        answers.setdefault(a["level"], []).append((a["part"], a["n"], a["bits"]))
    for k in range(upto):
        keys, _, of = block.asked(lengths[k])
        bits = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for _, n, b in sorted(answers.get(k, []))]
        block.keep(np.concatenate(bits).astype(bool) if bits else np.zeros(len(keys), dtype=bool), keys, of, lengths[k])


def _ask(lengths: list[int], level: int, part_bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            block = _Block(row, lengths[-1], seed)
            _told(row, block, lengths, level)
            keys, counts, _ = block.asked(lengths[level])
            part = (keys["low"] >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(keys), dtype=np.int64)
            cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(keys)]
            sent = keys if level == len(lengths) - 1 else keys["low"]
            out = [(row["block"], int(part[a]), sent[a:b].tobytes(), np.packbits([counts[a:b] > 0, counts[a:b] > 1]).tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "part", "hashes", "flags"])

    return run


def _answer(level: int, last: bool):
    def run(key, rows):
        raw, kind = rows["hashes"].to_pylist(), KEY if last else np.dtype("<u8")
        sizes = np.array([len(x) // kind.itemsize for x in raw], dtype=np.int64)
        keys = np.frombuffer(b"".join(raw), dtype=kind)
        flags = [np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=2 * n).reshape(2, -1) for f, n in zip(rows["flags"].to_pylist(), sizes)]
        order = np.lexsort((keys["high"], keys["low"])) if last else np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        of = np.cumsum(new) - 1
        counts = np.bincount(of, np.concatenate(flags, axis=1).sum(axis=0)[order], int(new.sum()))
        repeated = np.empty(len(keys), dtype=bool)
        repeated[order] = counts[of] > 1
        bits = [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum(sizes)[:-1])]
        n = len(raw)
        return pa.table({
            "block": rows["block"].cast(pa.int64()), "level": pa.array([level] * n, pa.int32()), "part": rows["part"].cast(pa.int64()),
            "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary()),
        })

    return run


def _finish(lengths: list[int], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            row = one.to_pylist()[0]
            block = _Block(row, lengths[-1], seed)
            _told(row, block, lengths, len(lengths))
            gone = block.removed()
            n_words, n_removed, kept = [], [], []
            for low, high in block.bounds:
                own = gone[low:high]
                words = block.text[block.begin[low] : block.end[high - 1]].split() if high > low else []
                n_words.append(high - low)
                n_removed.append(int(own.sum()))
                kept.append(b" ".join(compress(words, ~own) if own.any() else words).decode())
            columns = [one.column(c).flatten() for c in ("uid", "piece", "cut", "ids")]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "piece", "cut", "doc_id", "n_words", "n_removed", "kept"])

    return run


def _blocks(docs: DataFrame, id_col: str, text_col: str, window: int, piece_bytes: int, block_bytes: int) -> DataFrame:
    """One row for each block, in a table bucketed by block in the shared scratch folder."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    ddl = f"block long, z binary, size array<int>, behind array<int>, own array<int>, uid array<long>, piece array<int>, cut array<boolean>, ids array<{kind.simpleString()}>"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 20_000)
    packed = docs.select(id_col, text_col).mapInArrow(_pack(window, piece_bytes, block_bytes), ddl)
    return bucketed(packed, buckets, "block", "blocks")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shortest: int = SHORTEST, piece_bytes: int = PIECE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per row of ``docs``; kept is the text of the words that stay."""
    small_batches(docs.sparkSession)
    lengths, seed = levels(window, shortest), entropy.randbits(64)
    blocks = _blocks(docs, id_col, text_col, window, piece_bytes, block_bytes)
    words = blocks.select(F.sum(F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    part_bits = max(6, (8 * words // PART_BYTES).bit_length())
    answers = None
    for level in range(len(lengths)):
        last = level == len(lengths) - 1
        hashes = _with(blocks, answers).mapInArrow(_ask(lengths, level, part_bits, seed), HASHES)
        now = materialise(hashes.groupBy("part").applyInArrow(_answer(level, last), "block long, level int, part long, n int, bits binary"), f"answers{level}")
        answers = now if answers is None else answers.unionByName(now)
    kind = docs.schema[id_col].dataType
    schema = f"uid long, piece int, cut boolean, doc_id {kind.simpleString()}, n_words long, n_removed long, kept string"
    found = materialise(_with(blocks, answers).mapInArrow(_finish(lengths, seed), schema), "pieces")
    columns = ["doc_id", "n_words", "n_removed", "kept"]
    joined = found.where("cut").groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("n_removed").alias("n_removed"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("piece", "kept"))), lambda p: p["kept"] != ""), lambda p: p["kept"]), " ").alias("kept"),
    )
    return found.where("not cut").select(columns).unionByName(joined.select(columns))


def _with(blocks: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Each block with the answers it has got so far."""
    if answers is None:
        return blocks.withColumn("answers", F.lit(None).cast("array<struct<level:int,part:bigint,n:int,bits:binary>>"))
    told = answers.groupBy("block").agg(F.collect_list(F.struct("level", "part", "n", "bits")).alias("answers"))
    return blocks.join(told.hint("merge"), "block", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
