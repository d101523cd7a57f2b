import hashlib
import random
import re
from collections import Counter

from sonoloom.llm import substring

SCHEMA = "doc_id long, text string, n_words string, block string"


def slow(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    found = substring.remove_repeats(docs, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found), key=str)


def test_levels():
    assert substring.levels(35) == [9, 18, 35]
    assert substring.levels(8) == [8]


def test_brute_force_with_edge_cases(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "É", "x y", "w"]) + str(rng.randrange(400))
    rows = [(None, None), (1, ""), (2, " \t\n\x0b "), (3, "one"), (4, "same " * 34), (5, "tic tac " * 60), (None, "tic tac " * 60), (5, "tic tac " * 60)]
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 90, 200)]
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += [word() for _ in range(rng.choice([0, 3, 40, 150]))] + rng.choice(passages)
        rows.append((10 + k, rng.choice([" ", "\n", "  "]).join(text)))
    rows.append((500, "solo " * 30 + " ".join(word() for _ in range(120_000))))
    assert result(spark, rows) == slow(rows)
    assert result(spark, rows, piece_bytes=500, block_bytes=900, window=12) == slow(rows, 12)
    assert result(spark, rows, piece_bytes=700, block_bytes=1) == slow(rows)


def test_pieces_hold_each_word_once_with_its_neighbours():
    rng = random.Random(3)
    for size in (1, 7, 40):
        for n in (1, 2, 5):
            text = "".join(rng.choice(["a", "bb", "ccccccccc", " ", "  ", "\n", "\t"]) for _ in range(200)).encode()
            words, at = text.split(), 0
            for piece, behind, own in substring._cut(text, n, size):
                assert piece.split() == words[at - behind : at + own + n - 1] and behind == min(at, n - 1)
                at += own
            assert at == len(words)


def test_word_hashes_tell_words_apart_wherever_they_stand():
    rng = random.Random(7)
    words = list({bytes(rng.choice(b"ab\x00\xc3") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40, 64, 65, 200]))) for _ in range(5000)})
    h, start, end = substring.word_hashes(b"  " + b" \n".join(words) + b"\t")
    text = b"  " + b" \n".join(words) + b"\t"
    assert [text[a:b] for a, b in zip(start, end)] == words
    assert len({r.tobytes() for r in h}) == len(words) and len(set(h[:, 0].tolist())) == len(set(h[:, 1].tolist())) == len(words)
    for i in rng.sample(range(len(words)), 50):
        assert substring.word_hashes(words[i])[0].tolist() == [h[i].tolist()]
    assert not len(substring.word_hashes(b"")[0]) and not len(substring.word_hashes(b" \n")[0])


def test_long_words_are_not_taken_for_others(spark):
    """A polynomial modulo 2^64 cannot tell these two words apart, whatever its base."""
    first = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = first.translate({97: "b", 98: "a"})
    rows = [(1, "same " * 34 + first), (2, "same " * 34 + other), (3, first * 3), (4, other * 3)]
    assert all(r[2] == 0 for r in result(spark, rows)) and result(spark, rows) == slow(rows)


def test_equal_rows_and_a_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(7, passage)] * 400 + [(i, f"{passage} own{i}") for i in range(300)]
    assert result(spark, rows, block_bytes=2000) == slow(rows)


def test_a_text_far_over_a_piece(spark):
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(700_000))
    rows = [(1, text), (2, " ".join(text.split()[400_000:400_060]))]
    assert [r[1:3] for r in result(spark, rows)] == [(700_000, 60), (60, 60)]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, substring.query(spark, sf).collect()), key=str) == slow(rows)
