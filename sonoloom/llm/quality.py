"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL-proximal.

Features are words and pairs of neighbours (see ``hashing``), as shares of the document's entries, hashed
to 2^BITS weights; the last weight is the intercept. A score is one sparse dot product.

Defined results: null text, empty text and text without tokens get the intercept's score; equal texts get
equal scores; without any label every score is 0.5; empty tables are allowed; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sonoloom.llm.hashing import features
from sonoloom.llm.learning import SAMPLE, Example, Ftrl, fit, held_out, labelled_sample

BITS, SCALE, ALPHA, L1, L2, EPOCHS = 20, 30.0, 0.5, 0.0, 1e-4, 2
THRESHOLD = 0.3


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, values) of a text; the last coordinate is the intercept's."""
    bucket = np.concatenate([b for _, b, _ in features([text], BITS)])
    at, counts = np.unique(bucket, return_counts=True)
    return np.append(at, 1 << BITS).astype("<i4"), np.append(counts * (SCALE / max(1, counts.sum())), 1.0).astype("<f4")


def learn(examples: list[Example]) -> np.ndarray:
    model = Ftrl(BITS + 1, ALPHA, L1, L2)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            u, x, y = examples[i]
            w = model.weights(u)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            model.update(u, w, (p - y) * x)
    return model.weights(slice((1 << BITS) + 1))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, label, sample), encode, learn)


def score(text: Column, weights: np.ndarray, spark: SparkSession) -> Column:
    """Column of scores of whole texts; the weights are 2^BITS + 1 numbers, whatever the corpus."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(T.DoubleType())
    def of_batch(texts: pa.Array) -> pa.Array:
        w, out, open_ = shared.value, [], np.zeros(2)
        for doc, bucket, n in features((t.as_py() for t in texts), BITS):
            sums = np.array([np.bincount(doc, minlength=n + 1), np.bincount(doc, w[bucket], n + 1)], dtype=np.float64)
            sums[:, 0] += open_
            open_ = sums[:, n]  # of a document that goes on
            z = sums[1, :n] * (SCALE / np.maximum(1, sums[0, :n])) + w[1 << BITS]
            out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return of_batch(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the documents that score under ``threshold``."""
    weights = train(docs, labels)
    return docs.where(score(F.col("text"), weights, docs.sparkSession) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), train(docs, labels), spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
