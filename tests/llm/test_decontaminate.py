import hashlib
import random
import re

import duckdb

from sonoloom.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, item_id string, spans string", "item_id long, text string, doc_id string"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow(docs, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    return spark.createDataFrame([(*r, "clash", "clash") for r in docs], DOCS), spark.createDataFrame([(*r, "clash") for r in items], ITEMS)


def result(spark, docs, items, **kw):
    found = decontaminate.find_hits(*tables(spark, docs, items), **kw).collect()
    out = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in found]
    return sorted(out, key=str)


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["The", "é", "x1", "Of"]) + str(rng.randrange(60))
    items = [(i % 17, " ".join(word() for _ in range(rng.choice([1, 2, 9, 10, 11, 30])))) for i in range(25)]
    items += [(None, " ".join(word() for _ in range(12))), (90, ""), (91, None), (92, "again " * 14), (92, "again " * 14)]
    docs = [(None, None), (1, ""), (2, "... !!"), (3, "again " * 40), (3, "again " * 40)]
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 3)
            text += [word() for _ in range(rng.choice([0, 20]))] + w[a : len(w) - rng.randint(0, 3)]
        docs.append((10 + k, rng.choice([" ", "-", "\n"]).join(text).upper() if k % 3 else " ".join(text)))
    docs.append((500, "far " * 200_000 + (items[3][1])))
    return docs, items


def test_brute_force_with_edge_cases(spark):
    docs, items = cases()
    assert result(spark, docs, items) == slow(docs, items)


def test_more_blocks_give_the_same(spark):
    docs, items = cases()
    assert result(spark, docs, items, block_words=300) == slow(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert result(spark, [], items) == []
    assert result(spark, docs[:8], []) == slow(docs[:8], [])


def test_drop_contaminated_keeps_the_rest(spark):
    docs, items = cases()
    table, bench = tables(spark, docs, items)
    kept = decontaminate.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    clean = sorted(str(r[0]) for r in slow(docs, items) if not r[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = sorted(map(str, con.execute(decontaminate.SQL).fetchall()))
    df = decontaminate.query(spark, sf)
    assert df.columns == [c[0] for c in con.description]
    assert sorted(str(tuple(r)) for r in df.collect()) == expected
