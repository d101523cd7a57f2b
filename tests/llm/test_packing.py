import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonoloom.llm import packing

SCHEMA = "doc_id long, text string, length string, sequence_id string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows):
    """Pieces agree with the tokenizer's own ids; sequences are gapless and hold 1024 tokens at most."""
    own = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc_id, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        first, start = (len(ids) - 1) % 1024 + 1, 0
        for piece, cut in enumerate([ids[:first], *(ids[i : i + 1024] for i in range(first, len(ids), 1024))]):
            expected[doc_id, piece, start, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())] += 1
            start += len(cut)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by), -(-sum(r.length for r in rows) // 1024)


def test_edge_cases(spark):
    rng = random.Random(2)
    docs = [(None, None), (1, ""), (1, ""), (2, "<|endoftext|> is text"), (3, "\n" * 1_000_000), (4, " é\U0001f600" * 900), (5, "word " * 60_000)]
    docs += [(9 + i, " ".join(rng.choice(["the", "thanedble", "Ñ", "42"]) for _ in range(rng.randint(1, 900)))) for i in range(200)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], SCHEMA)
    rows = packing.packed_documents(df).collect()
    bins, least = check(docs, rows)
    assert bins <= least * 1.02 + 1
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_texts_are_tokenised_once(spark):
    """A second Python stage in a task is a second worker with a coder of its own."""
    plan = packing.tokenise(spark.createDataFrame([(1, "a", "", "")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sequences_hold_the_ids(spark):
    docs = [(i, "some words here " * i) for i in range(60)]
    df = spark.createDataFrame([(i, t, "", "") for i, t in docs], SCHEMA)
    pieces = packing.tokenise(df)
    placed = packing.pack(pieces.cache(), ["doc_id", "piece"])
    n = placed.agg(F.countDistinct("sequence_id")).first()[0]
    got = packing.sequences(placed).collect()
    ids = Counter(x for r in got for x in np.frombuffer(r.ids, "<u4").tolist())
    own = Tokenizer.from_file(PATH)
    assert len(got) == n and ids == Counter(x for _, t in docs for x in [*own.encode(t, add_special_tokens=False).ids, 2])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40), st.integers(1, 12))
def test_plan_places_everything_once(counts, groups):
    runs = packing.plan(counts, 64, groups=groups)
    numbers, fill = Counter(), defaultdict(list)
    for length, start, count, first, offset in runs:
        for i in range(count):
            numbers[length, start + i] += 1
            fill[first + i].append((offset, length))
    assert numbers == Counter((n, i) for n, c in counts.items() for i in range(c))
    for held in fill.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(fill) == list(range(len(fill)))


def test_configurations_place_most_large_documents():
    """The histogram has the shape of the given documents' lengths: many short ones, a long tail, some pieces of full length."""
    rng = random.Random(5)
    counts = Counter(min(1024, 1 + int(rng.lognormvariate(5.7, 1.0))) for _ in range(60_000))
    placed = Counter()

    class Watched(packing._Plan):
        def best_fit(self, length, count):
            placed[length] += count
            super().best_fit(length, count)

    plain, packing._Plan = packing._Plan, Watched
    try:
        runs = packing.plan(dict(counts))
    finally:
        packing._Plan = plain
    bins, least = max(r[3] + r[2] for r in runs), -(-sum(n * c for n, c in counts.items()) // 1024)
    large = sum(c for n, c in counts.items() if 128 < n < 1024)
    assert sum(c for n, c in placed.items() if 128 < n < 1024) < large / 2 and bins <= least * 1.002 + 1


def test_a_file_that_says_more_is_left_to_its_library(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    assert packing._Coder(PATH).plain
    spec["model"]["ignore_merges"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    coder = packing._Coder(str(tmp_path / "other.json"))
    assert not coder.plain and list(coder("some words")) == Tokenizer.from_file(str(tmp_path / "other.json")).encode("some words", add_special_tokens=False).ids


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bins, least = check(docs, packing.query(spark, sf).collect())
    assert bins <= least * 1.01 + 1
