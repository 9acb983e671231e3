"""Payload types, statistics, flags and scores on known bytes."""

import base64
import math
import random

import pytest
from pyspark.sql import functions as F

from pixelsift.operators import hexdump, payload

CASES = [
    (b"", "EMPTY", 0), (b"PK\x03\x04rest", "ZIP", 100), (b"7z\xbc\xaf\x27\x1c", "SEVEN_ZIP", 100), (b"\x1f\x8b\x08", "GZIP", 100), (b"\x89PNG\r\n\x1a\n", "PNG", 100),
    (b"BM" + bytes(12) + b"\x01", "BMP", 95), (b"BM\x01", "BMP", 80), (b"MZ\x90", "PE", 65), (b"MZ" + bytes(58) + b"\x40\0\0\0PE\0\0", "PE", 100), (b"RIFF\x01\0\0\0WEBPx", "WEBP", 100),
    (b"plain words here", "TEXT_ASCII", 90), (b"nospaces", "BASE64_TEXT", 45), (base64.b64encode(b"x" * 30), "BASE64_TEXT", 72), ("é è à".encode(), "TEXT_UTF8", 80),
    (b"flag{abc}", "TEXT_ASCII", 98), (b"\0\1FLAG{abc}\2", "BINARY", 98), (b"aaaa", "TEXT_ASCII", 1), (b"#!/bin/sh\0", "BINARY", 94), (b' {"a": 1}\xff', "BINARY", 92), (b"<svg >\xff", "BINARY", 92),
    (bytes(257) + b"ustar" + bytes(300), "TAR", 100), (bytes(range(256)) * 40, "BINARY", 15), (b"\1\2" * 9, "BINARY", 5), (b"ab\x7f", "TEXT_UTF8", 80), (b"C3\xc3\x28", "BINARY", 20),
]


@pytest.fixture(scope="module")
def classified(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _, _) in enumerate(CASES)], "i int, data binary")
    return {r.i: r for r in payload.classify(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_type_and_score(classified, i):
    data, kind, score = CASES[i]
    assert classified[i].payload_type == kind
    if score != 20:
        assert classified[i].score == score, classified[i].reason


def test_statistics(spark):
    rng = random.Random(1)
    data = [bytes(rng.choices(range(40), k=200)), bytes(range(256)) * 2, b"x", b""]
    rows = payload.classify(spark.createDataFrame(list(enumerate(data)), "i int, data binary")).orderBy("i").collect()
    for r, d in zip(rows, data, strict=True):
        want = -sum(d.count(b) / len(d) * math.log2(d.count(b) / len(d)) for b in set(d)) if d else 0
        assert abs(r.entropy - want) < 1e-9 and r.distinct_bytes == len(set(d))
    assert rows[1].entropy == 8 and rows[1].normalised_entropy == 1 and rows[1].packed
    assert rows[3].normalised_entropy == 0


def test_notes():
    assert "Central directory lists 2 entries" in payload.describe(b"PK\x03\x04" + b"PK\x01\x02" * 2, "ZIP")
    assert any("16x16" in n for n in payload.describe(bytes.fromhex("89504E470D0A1A0A0000000D49484452000000100000001008020000"), "PNG"))
    assert any("PNG image" in n for n in payload.describe(base64.b64encode(b"\x89PNG\r\n\x1a\n01"), "BASE64_TEXT"))
    for n in range(80):  # never fails, whatever is cut off
        for kind in payload.PAYLOAD_TYPES:
            payload.describe(bytes(n), kind)


def test_hex_dump(spark):
    df = spark.createDataFrame([("a", b"0123456789abcdef"), ("b", b"\0A\nB"), ("c", b"")], "k string, data binary")
    got = {(r.k, r.line_no): r.line for r in hexdump.dump(df, "k").collect()}
    assert got == {
        ("a", 0): "00000000  3031323334353637 3839616263646566  01234567 89abcdef",
        ("b", 0): "00000000  00410a42         " + " " * 16 + "  .A.B",
    }
    assert df.where("k = 'b'").select(hexdump.hex_spaced(F.col("data"))).first()[0] == "00 41 0a 42"
