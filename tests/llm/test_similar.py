import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from sonoloom.llm import similar, substring
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_pipeline import SF, stages  # noqa: F401

SCHEMA = "doc_id long, text string, kept_id string, root string"


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def slow_print(text):
    """128-bit fingerprint of the distinct words."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = {w for w in lowered.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w}
    h = ["".join(f"{b:08b}" for b in substring.word_hashes(w.encode())[0].tobytes()) for w in words]
    return int("0" + "".join(str(int(2 * sum(x[b] == "1" for x in h) > len(h))) for b in range(128)), 2)


def union_find(n, joined):
    lab = list(range(n))

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i in range(n):
        for j in range(i):
            if joined(i, j):
                lab[find(i)] = find(j)
    return [find(i) for i in range(n)]


def slow_kept(rows, near=True):
    """Ids kept by brute-force Jaccard over all pairs, with ``near`` those that a chain of near fingerprints joins (ids are distinct)."""
    sets, prints = [slow_set(t) for _, t in rows], [slow_print(t) for _, t in rows]
    group = union_find(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 15) if near else [0] * len(rows)
    alike = lambda i, j: 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))
    found = union_find(len(rows), lambda i, j: group[i] == group[j] and alike(i, j))
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[found[i]].append(doc)
    return sorted(min(g) for g in groups.values())


def cases():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "ß", "\U0001f600"]
    line = "terms and conditions of this page apply to all readers "
    rows = [(0, None), (1, ""), (2, " \n"), (3, "two words"), (4, "TWO\twords"), (5, "two word")]
    for k in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 100, 300]))]
        for c in range(6):
            copy = list(base)
            for _ in range(c * len(base) // 100 + (c > 0)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((100 + k * 6 + c, rng.choice([" ", "\n"]).join(copy)))
        rows.append((1000 + k, line * 40 + " ".join(rng.choice(vocab) for _ in range(60))))
    rng.shuffle(rows)
    return rows


def test_stage_against_brute_force_jaccard(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == slow_kept(rows)


def test_pieces_give_the_same_sets_and_prints():
    rng = random.Random(2)
    for text in (None, "", " a", "b c d e", "a b " * 50, " ".join(str(rng.randrange(300)) for _ in range(900)), "  x " * 4):
        whole, print_ = similar.shingles(text)
        for size in (1, 30, 400):
            cut, other = similar.shingles(text, size)
            assert cut.tolist() == whole.tolist() and other.tolist() == print_.tolist()
        assert len(whole) == len(slow_set(text))


def test_forest_connects_what_all_links_connect():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, 60)).astype(np.uint64) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.08], rng.integers(0, 2**63, 3).astype(np.uint64)])) for b in base for _ in range(12)]
    alike = lambda i, j: 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))
    want, edges = union_find(len(sets), alike), set(similar.linked(sets))
    got = union_find(len(sets), lambda i, j: (i, j) in edges or (j, i) in edges)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    assert len(edges) < len(sets) and all((want[i] == want[j]) == (got[i] == got[j]) for i, j in pairs)


def test_large_groups_are_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 2000)
    rows = cases()
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == slow_kept(rows)


def test_given_documents_lose_next_to_no_similar_pair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    every, found = slow_kept(rows, near=False), slow_kept(rows)
    assert set(every) <= set(found) and len(found) - len(every) <= 0.02 * (len(rows) - len(every))


def test_given_documents_and_the_stages_after(spark, stages):
    (_, _, good), (_, _, single), (_, _, clean), (_, _, redacted), _ = stages
    assert sorted(r.doc_id for r in single.collect()) == slow_kept([(r.doc_id, r.text) for r in good.collect()])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in slow_hits([(r.doc_id, r.text) for r in single.collect()], items) if r[5]}
    assert hit and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if r.doc_id not in hit)
    assert sorted(r.doc_id for r in redacted.collect()) == sorted(r.doc_id for r in clean.collect())
