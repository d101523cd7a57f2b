import re
from collections import Counter

import pytest

import corpus_pipeline
from sonoloom.llm import packing, quality
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_packing import check
from tests.llm.test_secrets import slow_fixed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, SF).cache()
        out.append((name, docs, now))
        docs = now
    return out


def test_columns_stay(stages):
    assert [n for n, _, _ in stages] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_redaction", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_each_stage_against_brute_force(spark, stages):
    from tests.llm.test_similar import slow_kept  # it uses the stages of this module

    (_, docs, good), (_, _, single), (_, _, clean), (_, _, redacted), (_, _, packed) = stages
    scored = {r.doc_id: r.score for r in quality.query(spark, SF).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, s in scored.items() if s >= 0.3)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == slow_kept(rows)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in slow_hits([(r.doc_id, r.text) for r in single.collect()], items) if r[5]}
    assert hit and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if r.doc_id not in hit)
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in redacted.collect():
        assert r.n_chars == len(r.text) and not [s for s in slow_fixed(r.text) if s[1] > 1]
        assert r.text == before[r.doc_id] or "[SECRET]" in r.text
        if not slow_fixed(before[r.doc_id]) and not re.search(r"[A-Za-z0-9+/_-]{20,}", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    bins, least = check([(r.doc_id, r.text) for r in redacted.collect()], packed.collect())
    assert bins <= least * 1.01 + 1


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select(columns).collect())) == Counter(map(tuple, stages[-1][2].select(columns).collect()))


@pytest.mark.parametrize("index", range(5))
def test_nulls_repeats_and_empty_tables(spark, index):
    name, stage = corpus_pipeline.STAGES[index]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, spans string"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, "c", "c"), (1, "", "en", "s", 0, "c", "c"), (2, "Plain words in a row. " * 5000, None, "s", 9, "c", "c")]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    assert index == 4 or out.columns == docs.columns
    assert out.count() >= (0 if index == 0 else 1)
    assert stage(spark, docs.limit(0), SF).count() == 0
