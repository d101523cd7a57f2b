"""Toxicity by multiple-instance learning: only documents have labels, sentences get scores.

A sentence's log-odds are an intercept plus the weights of its words and word stems (first 4, 5 and 6
bytes), each once. A document is toxic if any sentence is: 1 - product(1 - p), the noisy-or. The weights
are learned through that product from document labels by FTRL-proximal steps; the gradient of a toxic
document falls on its likeliest sentences. The intercept is fixed and low, so many plain sentences stay
plain together. Sentences end at a full stop, exclamation or question mark, or line end.

Defined results: null text, empty text and text without words have no sentence and score 0; equal texts
get equal scores; without any label no weight is learned; empty tables are allowed; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sonoloom.llm.hashing import _CLASS, _LOWER, _VALUE, REPEAT, STEP, _mix, _spans, tokens
from sonoloom.llm.learning import SAMPLE, Example, Ftrl, fit, held_out, labelled_sample

BITS, STEMS, INTERCEPT = 20, (4, 5, 6), -8.0
ALPHA, L1, L2, EPOCHS = 3.0, 4.0, 1e-3, 10
#: Weight of a toxic document, as most are not.
POSITIVE = 2.0
THRESHOLD = 0.5
_END = np.zeros(256, dtype=bool)
_END[[10, 33, 46, 63]] = True
SCORED = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
])


def _stretches(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, part) of a text in parts of at most ``STEP`` bytes, cut after a sentence's end, else before white space, else anywhere."""
    at = 0
    while len(text) - at > STEP:
        end = max(text.rfind(c, at, at + STEP) for c in (b".", b"!", b"?", b"\n")) + 1
        end = end if end > at else max(text.rfind(c, at + 1, at + STEP) for c in (b" ", b"\t"))
        end = end if end > at else at + STEP
        yield at, text[at:end]
        at = end
    yield at, text[at:] if at else text


def _of_part(lowered: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    h, start, end = tokens(lowered)
    raw = np.frombuffer(lowered, dtype=np.uint8)
    word = _CLASS[raw[start]] == 1
    h, start, end = h[word], start[word], end[word]
    if not len(h):
        return none, none, none, none
    _, first, of = np.unique(np.cumsum(_END[raw])[start], return_index=True, return_inverse=True)
    hashes, where = [h], [of]
    for n in STEMS:
        long = end - start > n
        hashes.append(_spans(_VALUE[raw], start[long], start[long] + n) + np.array(n, np.uint64) * np.array([REPEAT]))
        where.append(of[long])
    bucket = (_mix(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int64)
    keys = np.unique(np.concatenate(where) << BITS | bucket)
    last = np.append(first[1:], len(end)) - 1
    return keys >> BITS, keys & ((1 << BITS) - 1), start[first], end[last]


def sentences(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, bucket) of the distinct features, and each sentence's first and last byte."""
    found, n = [], 0
    for at, part in _stretches((text or "").encode().translate(_LOWER)):
        of, bucket, first, last = _of_part(part)
        found.append((of + n, bucket, first + at, last + at))
        n += len(first)
    return found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found)))


def _noisy_or(z: np.ndarray) -> tuple[np.ndarray, float]:
    p = np.minimum(1 / (1 + np.exp(-np.clip(z, -35, 35))), 1 - 1e-12)
    return p, float(-np.expm1(np.log1p(-p).sum()))


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    of, bucket, _, _ = sentences(text)
    return of.astype("<i4"), bucket.astype("<i4")


def learn(examples: list[Example]) -> np.ndarray:
    model = Ftrl(BITS, ALPHA, L1, L2)
    examples = [e for e in examples if len(e[0])]
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            of, bucket, y = examples[i]
            n = of[-1] + 1
            at, where = np.unique(bucket, return_inverse=True)
            w = model.weights(at)
            p, whole = _noisy_or(INTERCEPT + np.bincount(of, w[where], n))
            slope = p * (1 - y / max(whole, 1e-12)) * (POSITIVE if y else 1.0)
            model.update(at, w, np.bincount(where, slope[of]))
    return model.weights(slice(None))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, label, sample), encode, learn)


def score(text: Column, weights: np.ndarray, spark: SparkSession) -> Column:
    """struct<score, offending>: the document's noisy-or, and the sentences of at least even odds, offsets in code points."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(SCORED)
    def of_batch(texts: pa.Array) -> pa.Array:
        w, out = shared.value, []
        for t in texts:
            text = t.as_py()
            of, bucket, first, last = sentences(text)
            if not len(first):
                out.append({"score": 0.0, "offending": []})
                continue
            p, whole = _noisy_or(INTERCEPT + np.bincount(of, w[bucket], len(first)))
            bad = np.flatnonzero(p >= THRESHOLD)
            if len(bad):
                chars = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
                spans = zip((chars[first[bad]] - 1).tolist(), chars[last[bad] - 1].tolist(), p[bad].tolist())
            else:
                spans = ()
            out.append({"score": whole, "offending": [{"start": a, "end": b, "score": s} for a, b, s in spans]})
        return pa.array(out, pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]))

    return of_batch(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = docs.select("doc_id", score(F.col("text"), train(docs, labels), spark).alias("s"))
    listed = F.array_join(F.transform("s.offending", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), listed.alias("offending"))
