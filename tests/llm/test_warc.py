import base64
import gzip
import hashlib
import io
import random

import duckdb
import pytest

from sonoloom.llm import warc
from sonoloom.plans.scratch import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, i string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def cases():
    rng = random.Random(9)
    odd = "WARC/1.1\r\n\r\n0\r\n\r\n€\x00\r\nContent-Length: 3\r\n\r\n"
    rows = [(None, None, None), (1, "http://a b\r\n/", ""), (2, "u", None), (3, "u", odd), (3, "u", odd), (9, "u", odd), (9, "u", odd), (None, "u", odd), (None, "n", "only null"), (None, "n", "only null"), (7, "u", "\U0001f600é" * 60_000)]
    return rows + [(20 + i, f"http://x/{i}", odd * rng.randint(0, 40) + str(i % 30)) for i in range(120)]


def test_round_trip_with_edge_cases(spark):
    rows, path = cases(), scratch_path(spark, "warc-test")
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    warc.write_archives(pages, path, segment_bytes=700, chunk_bytes=93)
    found = warc.read_archives(spark, path).collect()
    assert all(r.error is None for r in found)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    expected = sorted((str(i), digest(h), "response" if i == largest.get(h or "") else "revisit", str(None if i == largest.get(h or "") else largest[h or ""])) for i, _, h in rows)
    assert sorted((str(r.page_id), r.digest, r.record_type, str(r.refers_to)) for r in found) == expected
    texts = {digest(h): (h or "").encode() for _, _, h in rows}
    assert all(r.payload == (texts[r.digest] if r.record_type == "response" else b"") for r in found)


def test_records_are_cut_and_files_are_plain_archives(spark):
    rows, path = cases(), scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), path, segment_bytes=1000)
    records = [rec for f in spark.read.format("binaryFile").load(path).collect() for rec in warc.parse(io.BytesIO(gzip.decompress(f.content)))]
    kinds = {r["record_type"] for r in records}
    assert kinds == {"response", "revisit", "continuation"} and len({r["record_id"] for r in records}) == len(records)
    assert max(len(r["block"]) for r in records) == 1000
    assert all(r["segment"] > 1 and r["origin"] for r in records if r["record_type"] == "continuation")


def test_missing_segment_and_wrong_total_are_errors(spark):
    row = lambda of, seg, block, total=None: (f"id{of}" if seg == 1 else f"c{of}{seg}", "response" if seg == 1 else "continuation", of, None, None, None, None if seg == 1 else f"id{of}", seg, total, block, None, None)
    ok = b"HTTP/1.1 200 OK\r\n\r\nab"
    rows = [row(1, 1, ok), row(1, 2, b"c"), row(1, 3, b"d", len(ok) + 2), row(2, 1, ok), row(2, 3, b"d", len(ok) + 2), row(3, 1, ok), row(3, 2, b"d", 99), row(4, 2, b"d", 1)]
    found = {r.page_id: r for r in warc.reassemble(spark.createDataFrame(rows, warc.RECORD_DDL)).collect()}
    assert found[1].payload == b"abcd" and found[1].error is None and 4 not in found
    assert found[2].payload is None is found[3].payload and found[2].error and found[3].error


@pytest.mark.parametrize("body", [b"5\r\nabc", b"zz\r\nabc\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"", b"-1\r\n\r\n"])
def test_broken_framing_is_an_error(body):
    payload, error = warc.message_body(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body)
    assert payload is None and error


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet' UNION ALL SELECT page_id + 100000, url, html FROM '{sf}/pages.parquet' WHERE page_id < 20")
    folder = scratch_path(spark, "pages-test")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.union(pages.where("page_id < 20").selectExpr("page_id + 100000", "url", "html")).write.parquet(f"{folder}/pages.parquet")
    df = warc.query(spark, folder)
    expected = con.execute(warc.SQL)
    assert df.columns == [c[0] for c in expected.description]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected.fetchall()))


def test_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0
