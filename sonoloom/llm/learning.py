"""What the two classifiers share: folds, a bounded labelled sample, and the follow-the-regularised-leader learner."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sonoloom.plans.scratch import small_batches

#: Labelled documents that a model learns from at most. More labels do not make training longer.
SAMPLE = 16_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int = SAMPLE) -> DataFrame:
    """(text, y) of at most ``bound`` labelled ids outside the held-out fold, chosen by a hash of the id.

    Labels that are null, or whose id is, are left out; an id with several labels gets their majority,
    and 1 if they tie. Only the bounded sample of (id, label) is broadcast to the documents.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(bound)
    )
    return docs.select(F.col("doc_id").alias("_of"), "text").join(F.broadcast(ids), F.col("_of") == F.col("_id")).select("text", "y")


class Ftrl:
    """FTRL-proximal with per-coordinate rates over hashed features (McMahan et al., 2013)."""

    def __init__(self, bits: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step for distinct coordinates ``at`` with weights ``w`` and gradient ``g``."""
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new


Example = tuple[np.ndarray, np.ndarray, float]


def fit(sample: DataFrame, encode: Callable[[str], tuple[np.ndarray, np.ndarray]], learn: Callable[[list[Example]], np.ndarray]) -> np.ndarray:
    """Encode the bounded sample where it lies, learn from the encoded examples in one task; the weights come back sparse.

    ``encode`` gives an int32 and a second array of four-byte numbers, whose kind is that of the encoding of "".
    """
    kind = encode("")[1].dtype
    small_batches(sample.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y in zip(b.column(0), b.column(1)):
                at, x = encode(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([x.tobytes()]), pa.array([y.as_py()])], ["a", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((a, x, y) for b in batches for a, x, y in zip(*(c.to_pylist() for c in b.columns)))
        w = learn([(np.frombuffer(a, "<i4"), np.frombuffer(x, kind), y) for a, x, y in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([len(w)]), pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].astype("<f8").tobytes()])], ["size", "at", "w"])

    examples = sample.mapInArrow(encoded, "a binary, x binary, y double")
    got = examples.repartition(1).mapInArrow(run, "size long, at binary, w binary").collect()
    if not got:  # no label, no task
        return learn([])
    size, at, w = got[0]
    out = np.zeros(size)
    out[np.frombuffer(at, "<i4")] = np.frombuffer(w, "<f8")
    return out
