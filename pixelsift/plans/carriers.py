"""Images, payloads and symbol reports derived from the relational test tables, by integer arithmetic only.

SQL twins of each derivation stand beside it, for checking against another engine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsift.operators import bars, code128, qr

#: Width of the carrier images made of ``events`` and ``orders``.
EVENTS_WIDTH, ORDERS_WIDTH = 100, 120
_M = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(F.lit("events").alias("image_id"), F.pmod(i, F.lit(EVENTS_WIDTH)).cast("int").alias("x"), F.floor(i / EVENTS_WIDTH).cast("int").alias("y"), F.pmod(i * 2654435761 + u * 40503 + 97, F.lit(_M)).alias("argb"))


EVENTS_SQL = "(SELECT 'events' AS image_id, CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, CAST((event_id * 2654435761 + user_id * 40503 + 97) % 4294967296 AS BIGINT) AS argb FROM events)"


def orders_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per order, placed by its key's rank in a dense range of keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("image_id"), F.pmod(k, F.lit(ORDERS_WIDTH)).cast("int").alias("x"), F.floor(k / ORDERS_WIDTH).cast("int").alias("y"), F.pmod(k * 1103515245 + c * 69069 + 12345, F.lit(_M)).alias("argb"))


ORDERS_SQL = "(SELECT 'orders' AS image_id, CAST(o_orderkey % 120 AS INTEGER) AS x, CAST(o_orderkey // 120 AS INTEGER) AS y, CAST((o_orderkey * 1103515245 + o_custkey * 69069 + 12345) % 4294967296 AS BIGINT) AS argb FROM orders)"


def periodic_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events carrier with a pattern that repeats every 20 columns."""
    px = events_px(spark, sf_dir)
    return px.withColumn("argb", F.pmod((F.col("x") % 20).cast("long") * 2654435761 + F.col("y").cast("long") * 97, F.lit(_M)))


PERIODIC_SQL = f"(SELECT image_id, x, y, CAST((CAST(x % 20 AS BIGINT) * 2654435761 + CAST(y AS BIGINT) * 97) % 4294967296 AS BIGINT) AS argb FROM {EVENTS_SQL})"


# Planted payloads (hex): signatures, flags, scripts, markup, base64 and noise that the text tables lack.
PLANTED = (
    "", "504B03041400", "377ABCAF271C0004", "526172211A0700", "1F8B0808AABBCCDD", "425A6839314159", "FD377A585A000004", "89504E470D0A1A0A0000000D49484452000000100000000C0802000000",
    "FFD8FFE000104A464946", "47494638396110000C00", "424D36000000000000003600", "424D3600000000000000360000002800", "524946460000000057454250", "255044462D312E370A", "7F454C4602010100000000000000000002003E00",
    "4D5A90000300", "CAFEBABE0000003D", "61616161616161", "666C61677B68656C6C6F7D", "00016B65797B616263647D02", "51554A4452455A4852306C4B5330784E54303951", "4142434445464748", "23212F62696E2F736800",
    "7B2261223A317D00", "3C3F786D6C20766572FF", "000102030405060708090A0B0C0D0E0F101112131415161718191A1B1C1D1E1F", "0102030401020304", "C3A9C3A8", "C3A9C328", "416263007F",
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload_id, data): texts of documents and pages as UTF-8, and the planted ones."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("payload_id"), F.col("text").cast("binary").alias("data"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("payload_id"), F.col("html").cast("binary").alias("data"))
    planted = spark.createDataFrame([(f"x{i}", bytes.fromhex(h)) for i, h in enumerate(PLANTED)], "payload_id string, data binary")
    return docs.unionByName(pages).unionByName(planted)


PAYLOADS_SQL = (
    "(SELECT 'd' || doc_id AS payload_id, encode(text) AS data FROM documents UNION ALL SELECT 'p' || page_id, encode(html) FROM pages UNION ALL SELECT 'x' || i, from_hex(h) FROM (VALUES "
    + ", ".join(f"({i}, '{h}')" for i, h in enumerate(PLANTED)) + ") v(i, h))"
)


def stego_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events carrier with a flag in the lowest bits of red, green and blue, row by row."""
    message = b"flag{bits-in-plain-sight}" + b" padded with readable words" * 2
    bits = "".join(f"{b:08b}" for b in message)
    px = events_px(spark, sf_dir)
    rank = F.col("y").cast("long") * EVENTS_WIDTH + F.col("x")

    def put(argb, k: int, shift: int):
        at = (rank * 3 + k).cast("int")
        bit = F.substring(F.lit(bits), at + 1, F.lit(1)).cast("long")
        return F.when(at < len(bits), argb.bitwiseAND(F.lit(_M - 1 - (1 << shift))).bitwiseOR(F.when(bit == 1, F.lit(1 << shift)).otherwise(F.lit(0)))).otherwise(argb)

    argb = F.col("argb")
    for k, shift in enumerate((16, 8, 0)):
        argb = put(argb, k, shift)
    return px.withColumn("argb", argb)


#: Bytes of drawn pictures in one batch on their way back, about.
_DRAWN = 4 << 20


def drawing(kind: str):
    """A function from batches of (image_id, text) to batches of packed images, of a few megabytes each. The symbols are QR
    ("qr"), Code 128 ("bars") or of a format of ``bars``."""

    def packed(made):
        ids, w, h, px = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array([False] * len(w)), pa.array(px, pa.binary())], names=["image_id", "width", "height", "has_alpha", "pixels"])

    def run(batches):
        for batch in batches:
            made, size = [], 0
            for image, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # one row after the other, each three times; all 30 of bars are equal
                rows = np.pad(qr.encode(text.encode()), 4) if kind == "qr" else np.pad(code128.encode(text) if kind == "bars" else bars.encode(kind, text), 10)[None]
                inks = np.where(np.repeat(rows, 3, 1), np.uint32(0xFF000000), np.uint32(0xFFFFFFFF)).astype(">u4")
                times = 3 if kind == "qr" else 90
                made.append((image, inks.shape[1], len(rows) * times, b"".join([row.tobytes() * times for row in inks])))
                size += len(made[-1][3])
                if size >= _DRAWN:
                    yield packed(made)
                    made, size = [], 0
            if made:
                yield packed(made)

    return run


def dealt(texts: DataFrame) -> DataFrame:
    """Rows of (image_id, text) dealt over tasks: a small file of short texts, one task by itself, makes many large pictures."""
    return texts.select("image_id", "text").repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "image_id")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as parts of sequences; every fifth conversation lacks its second part."""
    turns = table(spark, sf_dir, "conversations")
    totals = turns.groupBy("conv_id").agg(F.max("turn").alias("_top"), F.min("turn").alias("_low"))
    joined = turns.join(totals, "conv_id").where(~((F.col("conv_id") % 5 == 0) & (F.col("turn") == F.col("_low") + 1)))
    return joined.select(
        F.lit("conversations").alias("image_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("hit_no"), F.lit("QR_CODE").alias("format"), "text", F.col("text").cast("binary").alias("payload"),
        F.lit(False).alias("located"), F.lit(0.0).alias("bx"), F.lit(0.0).alias("by"),
        (F.col("turn") - F.col("_low")).cast("int").alias("append_index"), (F.col("_top") - F.col("_low") + 1).cast("int").alias("append_total"), F.col("conv_id").cast("int").alias("append_parity"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of symbols from events: place from the id, content from the type; every seventh isn't located."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("image_id"), i.cast("int").alias("hit_no"), F.lit("QR_CODE").alias("format"), F.col("event_type").alias("text"), F.lit(None).cast("binary").alias("payload"),
        (i % 7 != 0).alias("located"), (i % 61).cast("double").alias("bx"), (i % 53).cast("double").alias("by"),
        F.lit(None).cast("int").alias("append_index"), F.lit(None).cast("int").alias("append_total"), F.lit(None).cast("int").alias("append_parity"),
    )


HITS_SQL = "(SELECT 'u' || user_id AS image_id, CAST(event_id AS INTEGER) AS hit_no, event_type AS text, event_id % 7 <> 0 AS located, CAST(event_id % 61 AS DOUBLE) AS bx, CAST(event_id % 53 AS DOUBLE) AS by_ FROM events)"
