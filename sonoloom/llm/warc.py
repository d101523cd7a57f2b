"""WARC archives: written with segmented, chunk-framed records, read back and put together again.

Writing: equal payloads (from ``least_revisit`` bytes) have one response, that with the largest page_id;
the others become revisit records without a payload. A response's block is an HTTP message with chunked
transfer framing; blocks over ``segment_bytes`` are cut into a first record and continuation records that
name its id, their segment number and, in the last, the total length. Spark's text writer puts records
into gzip files of a bounded number of records.

Reading: files are parsed by content length, never by searching for separators. Records of one segment
pass straight on; segments are grouped by origin id, ordered by segment number and joined; segment numbers
must be gapless and the joined length must equal the total length given; then chunk framing is decoded.

Defined results: a null payload is empty; a null page_id is written without its header field and read back
as null; it is never the largest unless all are null, and then every record is a response; rows that repeat
the response's page_id and payload are responses too; a record whose segments are incomplete or whose
framing is broken comes back with a null payload and ``error``; an empty table gives no records; a null url
is left out; other columns play no part.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sonoloom.plans.scratch import materialise, scratch_path

SEGMENT_BYTES, CHUNK_BYTES, LEAST_REVISIT, FILE_RECORDS, HOT = 32_768, 4096, 0, 2000, 10_000
CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MESSAGE = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()),
    ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary()), ("error", pa.string()),
])
RECORD_DDL = "record_id string, record_type string, page_id long, url string, digest string, refers_to long, origin string, segment int, total long, block binary, payload binary, error string"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1, 32 characters: 40 bits at a time in base 32."""
    digits = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _slices(data: Column, size: int) -> Column:
    """Array of a binary column's consecutive parts as strings of the same bytes."""
    at = F.sequence(F.lit(0), F.ceil(F.length(data) / size).cast("int") - 1)
    parts = F.transform(at, lambda i: data.substr(i * size + 1, F.lit(size)).cast("string"))
    return F.when(F.length(data) > 0, parts).otherwise(F.array().cast("array<string>"))


def _field(name: str, value: Column) -> Column:
    """A header line, left out for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def join_counted(left: DataFrame, right: DataFrame, key: str, value: str, total: int, slim: Callable[[Column], Column] | None = None) -> DataFrame:
    """``left`` with ``value`` and ``known`` of the written table ``right`` (key, value, n), as a left join.

    A key with at least 1/``HOT`` of ``total`` rows, of which there are ``HOT`` at most, comes by broadcast; such rows go
    on under keys of their own, so no task of the other join holds a hot key's rows. ``slim`` gives their payload.
    """
    large = F.col("n") * HOT >= F.lit(total)
    near = right.where(large).select(F.col(key).alias("_near"), F.col(value).alias("_a"))
    far = right.where(~large).select(F.col(key).alias("_far"), F.col(value).alias("_b"))
    found = left.join(F.broadcast(near), F.col(key) == F.col("_near"), "left")
    if slim:
        found = found.withColumn("payload", F.when(F.col("_near").isNotNull(), slim(F.col("_a"))).otherwise(F.col("payload")))
    spread = F.when(F.col("_near").isNull(), F.col(key)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string")))
    found = found.withColumn("_on", spread).join(far, F.col("_on") == F.col("_far"), "left")
    return found.withColumns({value: F.coalesce("_a", "_b"), "known": F.col("_near").isNotNull() | F.col("_far").isNotNull()}).drop("_near", "_far", "_a", "_b", "_on")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, least_revisit: int = LEAST_REVISIT) -> None:
    """One record for each row of ``pages`` (several if cut), as gzip files under ``path``."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    base = pages.select(F.col(id_col).alias("page_id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "").alias("url"), payload.alias("payload")).withColumns({"digest": sha1_base32(F.col("payload")), "length": F.length("payload")})
    copies = base.where(F.length("payload") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    own = F.length("payload") >= least_revisit
    joined = join_counted(base, materialise(copies, "copies"), "digest", "first", pages.count(), lambda first: F.when(own & ~F.col("page_id").eqNullSafe(first), F.lit(b"")).otherwise(F.col("payload")))
    joined = joined.withColumn("revisit", F.col("known") & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("length") >= least_revisit))
    framed = F.array_join(F.transform(_slices(F.col("payload"), chunk_bytes), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF))), "")
    message = F.when(F.col("revisit"), F.lit(MESSAGE + CRLF)).otherwise(F.concat(F.lit(f"{MESSAGE}Transfer-Encoding: chunked{CRLF}{CRLF}"), framed, F.lit(f"0{CRLF}{CRLF}")))
    cut = joined.withColumns({"id": F.expr("uuid()"), "block": message.cast("binary")}).select("*", F.posexplode(_slices(F.col("block"), segment_bytes)).alias("i", "part"), F.length("block").alias("total")).withColumn("last", (F.col("i") + 1) * segment_bytes >= F.col("total"))
    first, many = F.col("i") == 0, F.col("total") > segment_bytes
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    head = [
        _field("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", urn(F.when(first, F.col("id")).otherwise(F.expr("uuid()")))),
        _field("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("WARC-Profile", F.when(first & F.col("revisit"), F.lit(PROFILE))),
        _field("X-Page-ID", F.when(first, F.col("page_id"))),
        _field("X-Refers-To-Page-ID", F.when(first & F.col("revisit"), F.col("first"))),
        _field("WARC-Segment-Number", F.when(many, F.col("i") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~first, urn(F.col("id")))),
        _field("WARC-Segment-Total-Length", F.when(~first & F.col("last"), F.col("total"))),
        _field("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        _field("Content-Length", F.octet_length("part")),
    ]
    record = F.concat(F.lit(VERSION + CRLF), *head, F.lit(CRLF), F.col("part"))
    cut.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(file: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one archive, one after the other."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("an archive record must start with its version")
        head: dict[str, str] = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = file.read(int(head["content-length"]))
        number = lambda name: int(head[name]) if name in head else None
        yield {
            "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "page_id": number("x-page-id"), "url": head.get("warc-target-uri"),
            "digest": head["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in head else None, "refers_to": number("x-refers-to-page-id"),
            "origin": head.get("warc-segment-origin-id"), "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "block": block,
        }


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with their block if they are segments, else with their decoded payload."""
    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as file:
                for record in parse(io.BufferedReader(file, 1 << 16)):
                    size += len(record["block"])
                    if record["segment"] is None:
                        record["payload"], record["error"] = message_body(record.pop("block"))
                    held.append(record)
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, RECORD)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, RECORD)


def message_body(block: bytes | None) -> tuple[bytes | None, str | None]:
    """(body, error) of an HTTP message; chunked framing is decoded and must be whole."""
    if block is None:
        return None, "segments are missing or have another total length"
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "no end of the message head"
    if b"transfer-encoding: chunked" not in head.lower():
        return body, None
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None, "broken chunk size"
        at = end + 2
        if size == 0:
            return b"".join(out), None
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            return None, "broken chunk"
        out.append(body[at : at + size])
        at += size + 2


@F.arrow_udf(T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())]))
def _decoded(blocks: pa.Array) -> pa.Array:
    found = [message_body(b.as_py()) for b in blocks]
    return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], ["payload", "error"])


def reassemble(records: DataFrame) -> DataFrame:
    """(record_type, page_id, url, digest, refers_to, payload, error), one row for each record that is no continuation.

    Only records cut into segments are shuffled. A group is the segments of one record.
    """
    keep = ["record_type", "page_id", "url", "digest", "refers_to"]
    whole = records.where(F.col("segment").isNull()).select(*keep, "payload", "error")
    parts = records.where(F.col("segment").isNotNull()).withColumn("of", F.coalesce("origin", "record_id"))
    first = F.col("segment") == 1
    grouped = parts.groupBy("of").agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in keep), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("p"), F.max("total").alias("total"),
    )
    gapless = F.transform("p", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("p"))
    joined = F.array_join(F.transform("p", lambda x: x["block"].cast("string")), "").cast("binary")
    cut = grouped.where(F.col("record_type").isNotNull()).withColumn("joined", joined).select(*keep, F.when(gapless & (F.length("joined") == F.col("total")), F.col("joined")).alias("block"))
    return whole.unionByName(cut.withColumn("m", _decoded("block")).select(*keep, "m.payload", "m.error"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``, put together; see :func:`reassemble`."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return reassemble(files.mapInArrow(_parsed, RECORD_DDL))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = read_archives(spark, path)
    own = found.select("page_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.when(F.col("record_type") == "response", sha1_base32(F.col("payload"))).otherwise(F.col("digest")).alias("payload_digest"))
    own = materialise(own, "records")
    sizes = materialise(own.groupBy("payload_digest").agg(F.max(F.when(F.col("record_type") == "response", F.col("payload_bytes"))).alias("full"), F.count("*").alias("n")).where("n > 1"), "sizes")
    revisits = join_counted(own.where("record_type = 'revisit'"), sizes, "payload_digest", "full", own.count()).select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return own.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(revisits)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  translate(to_base(CAST('0x' || s[1:10] AS BIGINT), 32, 8) || to_base(CAST('0x' || s[11:20] AS BIGINT), 32, 8) || to_base(CAST('0x' || s[21:30] AS BIGINT), 32, 8) || to_base(CAST('0x' || s[31:40] AS BIGINT), 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM g
"""
