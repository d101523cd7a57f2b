"""Spelling variants, against every word one edit away."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sonoloom.llm import spelling

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def counted(rows, letters=5, least=3):
    found = Counter()
    for i, t in rows:
        for w, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER))).items():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            at = h % len(w)
            found[w[:at] + w[at + 1 :] if h % 97 == 0 else w] += n
    return {w: n for w, n in found.items() if n >= least and len(w) >= letters}


def brute(v):
    letters, out, form, near = {c for w in v for c in w}, set(), {}, {}
    for w in v:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        own = [x for x in edits - {w} if x in v]
        best = min(own, key=lambda x: (-v[x], x), default=None)
        near[w], form[w] = len(own), best if best is not None and v[best] >= 2 * v[w] else None
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, v[w], near[w], v[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_given_documents(spark, sf):
    want = counted([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert rows_of(spelling.query(spark, sf)) == brute(want) and any(n for *_, n, _ in brute(want))


@pytest.mark.parametrize("part", [20_000, 7])
def test_dense_words_of_few_letters(spark, monkeypatch, part):
    """Runs of equal letters, prefixes of each other, and tries cut into small parts."""
    monkeypatch.setattr(spelling, "WORDS_PER_PART", part)
    rng = random.Random(part)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"a" * i for i in range(1, 9)}
    vocab = {w: rng.choice((1, 1, 2, 4, 4, 9, 20, 50)) for w in words}
    assert rows_of(spelling.near_words(spark.createDataFrame(list(vocab.items()), "word string, n long"))) == brute(vocab)


def test_runs_and_deleted_letters(spark):
    rows = [(i, f"Straße STRASSE straße× naïve,naive;x́y cafés {'long' * 9}") for i in range(300)] + [(None, "Straße naïve"), (5, None), (6, ""), (7, "123 !?")] + [(9, "Copy copies copied")] * 40
    got = {(r.word, r.n) for r in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))).collect()}
    assert got == set(counted(rows).items())


def test_very_long_word_and_text(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STEP", 1 << 12)
    word = "abcdefghij" * 3000
    rows = [(i, f"{word} {word[:-1]} short words here " + "filler text of plain words " * 400) for i in range(4)]
    df = spelling.near_words(spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), modulus=2**31 - 1))
    got = {r.word: r for r in df.collect()}
    assert got[word].n_near == 1 and got[word[:-1]].n_near == 1 and got["filler"].n == 1600


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.near_words(spelling.vocabulary(none)).collect() == []
    assert spelling.near_words(spelling.vocabulary(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))).collect() == []


def test_links_are_followed_to_the_end(spark):
    vocab = {"aaaaa": 1000, "aaaab": 400, "aaabb": 150, "aabbb": 50, "abbbb": 20, "bbbbb": 5}
    got = {r.word: (r.form, r.root) for r in spelling.near_words(spark.createDataFrame(list(vocab.items()), "word string, n long")).collect()}
    assert got["bbbbb"] == ("abbbb", "aaaaa") and got["aaaaa"] == (None, "aaaaa")
