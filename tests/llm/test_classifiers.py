import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoloom.llm import hashing, learning, quality, toxicity

DOCS, LABELS = "doc_id long, text string, quality string, y string, _score string", "doc_id long, quality int, toxic int"
ODD = [(None, None), (1, ""), (2, " \n.!?"), (3, "ünïcode \U0001f600 und Wörter."), (3, "ünïcode \U0001f600 und Wörter."), (4, "long words here. " * 60_000), (None, "x")]


def tables(spark, docs, labels):
    return spark.createDataFrame([(*d, "clash", "clash", "clash") for d in docs], DOCS), spark.createDataFrame(labels, LABELS)


def test_tokens_agree_with_a_pattern():
    for text in ("", "a", "  It's 5%%% ok, naïve_one !! ", "ß\t\x00b"):
        raw = text.encode().lower()
        _, start, end = hashing.tokens(raw)
        assert [raw[a:b] for a, b in zip(start, end)] == re.findall(rb"[0-9a-z_\x80-\xff]+|[^\s0-9a-z_\x80-\xff]+", raw)


def test_features_do_not_depend_on_neighbours():
    texts = ["one two two two", "", "two one", "one two two two"]
    alone = [np.sort(b).tolist() for t in texts for _, b, _ in hashing.features([t], 16)]
    doc, bucket, n = next(hashing.features(texts, 16))
    assert n == 4 and [np.sort(bucket[doc == i]).tolist() for i in range(4)] == alone


def test_folds_and_sample(spark):
    docs, labels = tables(spark, [(i, f"t{i}") for i in range(50)] + [(None, "n")], [(i, 1, i % 2) for i in range(50)] + [(7, 0, 0), (7, 1, 0), (None, 1, 1), (8, None, None)])
    got = learning.labelled_sample(docs, labels, "quality").collect()
    assert sorted(r.text for r in got) == sorted(f"t{i}" for i in range(50) if zlib.crc32(str(i).encode()) % 5)
    assert all(r.y == 1 for r in got)
    assert learning.labelled_sample(docs, labels, "quality", bound=9).count() == 9
    folds = docs.select("doc_id", learning.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in folds)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_cases(spark, module):
    docs, labels = tables(spark, ODD + [(10 + i, "plain words. " * 3 if i % 2 else "idiot words. Other things.") for i in range(40)], [(10 + i, i % 2, 1 - i % 2) for i in range(40)])
    weights = module.train(docs, labels)
    col = module.score(F.col("text"), weights, spark)
    score = (lambda r: r.s) if module is quality else (lambda r: r.s.score)
    rows = docs.select("doc_id", "text", col.alias("s")).collect()
    by_text = {}
    for r in rows:
        assert 0 <= score(r) <= 1 and by_text.setdefault(r.text, score(r)) == score(r)
    assert by_text["plain words. " * 3] > 0.5 > by_text["idiot words. Other things."] if module is quality else by_text["plain words. " * 3] < 0.5
    none = module.train(docs, labels.limit(0))
    assert not none.any() and docs.limit(0).select(module.score(F.col("text"), none, spark)).count() == 0


def test_noisy_or_locates_the_sentence(spark):
    text = "Ein schöner Tag. You utter moron! Good bye."
    docs, labels = tables(spark, [(i, text if i % 2 else f"Ein schöner Tag {i}. Good bye. You utter {i}!") for i in range(300)], [(i, 1, i % 2) for i in range(300)])
    weights = toxicity.train(docs, labels)
    got = docs.where("doc_id = 1").select(toxicity.score(F.col("text"), weights, spark).alias("s")).first().s
    assert got.score > 0.5 and [text[o.start : o.end] for o in got.offending] == ["You utter moron"]
    of, bucket, first, _ = toxicity.sentences(text)
    p = 1 / (1 + np.exp(-(toxicity.INTERCEPT + np.array([weights[bucket[of == i]].sum() for i in range(len(first))]))))
    assert abs(1 - np.prod(1 - p) - got.score) < 1e-9


def test_score_is_the_sparse_dot_product(spark):
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << quality.BITS) + 1)
    text = "one two two three"
    docs, _ = tables(spark, [(1, text)], [])
    got = docs.select(quality.score(F.col("text"), weights, spark).alias("s")).first().s
    _, bucket, _ = next(hashing.features([text], quality.BITS))
    z = weights[bucket].sum() * quality.SCALE / len(bucket) + weights[-1]
    assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", (0.98, 0.98, 0.99)), (toxicity, "toxic", (0.94, 0.89, 0.96))])
def test_held_out_fold_of_sf01(spark, module, label, least):
    """Precision, recall and area under the curve; some toxic labels are on texts without any toxic word, which bounds recall."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.score, r.predicted, r[label]) for r in module.query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()]
    right, flagged, real = sum(p and y for _, p, y in rows), sum(p for _, p, _ in rows), sum(y for _, _, y in rows)
    pos, neg = np.array([s for s, _, y in rows if y]), np.sort([s for s, _, y in rows if not y])
    auc = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2 / len(pos) / len(neg)
    print(label, len(rows), right / flagged, right / real, auc)
    assert len(rows) > 700 and right / flagged >= least[0] and right / real >= least[1] and auc >= least[2]


class SlowFtrl:
    """One coordinate at a time, in plain numbers."""

    def __init__(self, alpha, l1, l2):
        self.z, self.n, self.alpha, self.l1, self.l2 = {}, {}, alpha, l1, l2

    def weight(self, i):
        z = self.z.get(i, 0.0)
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((1 + math.sqrt(self.n.get(i, 0.0))) / self.alpha + self.l2)

    def step(self, i, w, g):
        n = self.n.get(i, 0.0)
        self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


TEXTS = ["good plain words here", "bad idiot words. fine words!", "", "you idiot. you moron", "plain words again and again", "fine day. idiot"]


def test_quality_learns_as_coordinates_do_one_by_one():
    examples = [(*quality.encode(t), float(i % 2)) for i, t in enumerate(TEXTS)]
    slow = SlowFtrl(quality.ALPHA, quality.L1, quality.L2)
    for epoch in range(quality.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            at, x, y = examples[i]
            w = [slow.weight(k) for k in at.tolist()]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x.tolist()))))
            for k, a, b in zip(at.tolist(), w, x.tolist()):
                slow.step(k, a, (p - y) * b)
    got = quality.learn(examples)
    assert np.flatnonzero(got).tolist() == sorted(k for k in slow.z if slow.weight(k)) and all(abs(got[k] - slow.weight(k)) < 1e-9 for k in slow.z)


def test_toxicity_learns_as_coordinates_do_one_by_one():
    examples = [(*toxicity.encode(t), float("idiot" in t)) for t in TEXTS]
    slow = SlowFtrl(toxicity.ALPHA, toxicity.L1, toxicity.L2)
    kept = [e for e in examples if len(e[0])]
    for epoch in range(toxicity.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(kept)):
            of, bucket, y = (x.tolist() if hasattr(x, "tolist") else x for x in kept[i])
            w = {k: slow.weight(k) for k in set(bucket)}
            z = [toxicity.INTERCEPT + sum(w[k] for o, k in zip(of, bucket) if o == s) for s in range(of[-1] + 1)]
            p = [1 / (1 + math.exp(-v)) for v in z]
            whole = 1 - math.prod(1 - v for v in p)
            slope = [v * (1 - y / max(whole, 1e-12)) * (toxicity.POSITIVE if y else 1) for v in p]
            for k in w:
                slow.step(k, w[k], sum(slope[o] for o, b in zip(of, bucket) if b == k))
    got = toxicity.learn(examples)
    assert np.flatnonzero(got).size and all(abs(got[k] - slow.weight(k)) < 1e-6 * max(1, abs(slow.weight(k))) for k in slow.z)


def test_long_texts_are_looked_at_in_chunks(monkeypatch):
    text = "some words here and here and here. Other words! " * 40 + "x" * 300 + " end"
    whole = np.sort(np.concatenate([b for _, b, _ in hashing.features([text], 18)]))
    monkeypatch.setattr(hashing, "STEP", 512)
    found, ended = [], 0
    for doc, bucket, n in hashing.features(["first words", text, "last"], 18):
        found.append(bucket[doc + ended == 1])
        ended += n
    assert ended == 3 and np.sort(np.concatenate(found)).tolist() == whole.tolist()
    of, bucket, first, last = toxicity.sentences(text)
    monkeypatch.setattr(toxicity, "STEP", 512)
    cut = toxicity.sentences(text)
    assert cut[0].tolist() == of.tolist() and cut[1].tolist() == bucket.tolist() and cut[2].tolist() == first.tolist() and cut[3].tolist() == last.tolist()


def test_batches_of_empty_texts_only(spark):
    weights = np.zeros((1 << quality.BITS) + 1)
    weights[-1] = 1.0
    docs = spark.createDataFrame([(None,), ("",), (" ",)], "text string").coalesce(1)
    assert all(abs(r.s - 1 / (1 + math.exp(-1))) < 1e-12 for r in docs.select(quality.score(F.col("text"), weights, spark).alias("s")).collect())


def test_keep_good_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.keep_good(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
