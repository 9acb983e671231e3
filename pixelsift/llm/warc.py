"""WARC archives: writing pages as captures, and assembling captures from what an archive holds.

Writing: every page becomes three records that stand together: a request, a response (or a revisit of a
response with the same payload) and metadata; request and metadata name the response in WARC-Concurrent-To.
Spark's text writer puts the bytes down, so tasks can be repeated and any file system will do.

Reading: archives are parsed record by record (by Content-Length, never by searching for a separator),
and transactions are assembled: request and metadata records are joined to the response or revisit that
they are concurrent to, and one nested row per capture is emitted.

Revisits: of the records with equal payloads of at least :data:`LEAST` bytes, that with the largest page_id
is the response and the others refer to it. Only (digest, length, largest id) of groups of two or more is
joined to the pages; groups of any size are aggregated before they are shuffled, and the joins on a
digest or a response are ones whose large partitions Spark can split.

Files are bounded in bytes, however large single pages are: captures of payloads up to :data:`SMALL` bytes
share files of :data:`FILE_RECORDS` records, larger ones have a file each.

Defined results: a null html is an empty payload; page ids may be of any type that can be compared and cast to
text; payloads may have any length that fits a row; a null page_id loses against any other (a group with
null ids only has responses only); rows that agree in page_id and payload are the same kind of record and
give a capture each; white space and controls in a URL are written as %20, a null URL is empty; an empty
table gives an empty archive and no captures; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsift.llm._store import keep

#: Shorter payloads are always stored in full.
LEAST = 1000
#: Records in one archive file, at most, and the payloads that share one.
FILE_RECORDS, SMALL = 3000, 1 << 16

RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "payload_digest string, payload_bytes long, payload binary, fields array<struct<name string, value string>>"
)
_ARROW = pa.schema([
    *[(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "warc_date", "payload_digest")],
    ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
])


def _id(kind: str, page: Column, digest: Column) -> Column:
    hashed = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hashed, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n")]
    for name, value in headers:  # a null value leaves its header out
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write gzipped WARC files under ``path``: three records for each row of (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"), html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    groups = keep(
        rows.where(F.col("bytes") >= LEAST).groupBy("digest", "bytes").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "payloads",
    )
    typed = rows.join(groups, ["digest", "bytes"], "left").withColumn("revisit", F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target")))
    capture = F.when(F.col("revisit"), _id("revisit", F.col("page_id"), F.col("digest"))).otherwise(_id("response", F.col("page_id"), F.col("digest")))
    typed = typed.withColumn("capture", capture)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    when = lambda c: F.when(F.col("revisit"), c)
    records = F.array(
        _record(F.lit("request"), [("WARC-Record-ID", _id("request", F.col("page_id"), F.col("digest"))), *common, ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))),
        _record(
            F.when(F.col("revisit"), "revisit").otherwise("response"),
            [
                ("WARC-Record-ID", F.col("capture")), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                ("WARC-Refers-To", when(_id("response", F.col("target"), F.col("digest")))), ("WARC-Profile", when(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                ("Content-Type", F.lit("application/http;msgtype=response")),
            ],
            F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("html"))),
        ),
        _record(F.lit("metadata"), [("WARC-Record-ID", _id("metadata", F.col("page_id"), F.col("digest"))), *common, ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/warc-fields"))], F.coalesce(F.concat(F.lit("pageId: "), F.url_encode(F.col("page_id").cast("string")), F.lit("\r\n")), F.lit(""))),
    )
    for rows, most in ((typed.where(F.col("bytes") <= SMALL), FILE_RECORDS), (typed.where(F.col("bytes") > SMALL), 3)):
        rows.select(F.explode(records).alias("value")).write.mode("append").option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", most).text(path)


def parse(data: bytes):
    """The records of an uncompressed archive: (headers with lower-cased names, block)."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[start:stop]
        at = stop + 4


def unzip(data: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(out) if out else data


def _row(headers: dict, block: bytes, with_payload: bool) -> dict:
    kind = headers.get("warc-type")
    row = {
        "record_id": headers.get("warc-record-id"), "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
        "target_uri": headers.get("warc-target-uri"), "warc_date": headers.get("warc-date"), "payload_digest": None, "payload_bytes": None, "payload": None, "fields": None,
    }
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            row |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload if with_payload else None}
        else:  # what the response it refers to held
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
            row |= {"payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2] or None, "payload_bytes": int(http["content-length"]) if "content-length" in http else None}
    elif kind == "metadata":
        row["fields"] = [{"name": k.strip(), "value": v.strip()} for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
    return row


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0):
                rows = [_row(h, b, with_payload) for h, b in parse(unzip(file.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame, id_type: str = "long") -> DataFrame:
    """One nested row per capture: the response or revisit with the request and metadata records concurrent to it.
    ``id_type``: that of the pages' ids."""
    side = records.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    item = F.struct("record_id", "target_uri", "warc_date", "fields")
    joined = side.groupBy("concurrent_to").agg(F.collect_set(F.when(F.col("record_type") == "request", item)).alias("requests"), F.collect_set(F.when(F.col("record_type") == "metadata", item)).alias("metadata"))
    main = records.where(F.col("record_type").isin("response", "revisit")).drop("concurrent_to", "fields")
    return main.join(joined.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left").withColumn(
        "page_id", F.url_decode(F.expr("get(filter(flatten(transform(metadata, m -> m.fields)), f -> f.name = 'pageId'), 0).value")).cast(id_type)
    )


def captures(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Per capture without its payload: page_id, payload_bytes, payload_digest, record_type and refers_to as a page_id."""
    rows = keep(assemble(keep(read_records(spark, path, with_payload=False).drop("payload"), "records"), id_type), "captures")
    targets = keep(rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("_target")), "responses")
    return rows.join(targets, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("_target").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS target FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> target THEN target END AS refers_to FROM g
"""
