"""Symbols drawn here are found and read again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelsift.functions import regions
from pixelsift.operators import bars as others
from pixelsift.operators import code128, qr, symbols, symbolscan


def draw(dark, module=4, quiet=4):
    dark = np.pad(dark, quiet)
    return np.where(np.repeat(np.repeat(dark, module, 0), module, 1), np.uint32(0xFF000000), np.uint32(0xFFFFFFFF))


def bars(text, module=3):
    return np.where(np.tile(np.repeat(np.pad(code128.encode(text), 10), module), (90, 1)), np.uint32(0xFF000000), np.uint32(0xFFFFFFFF))


def test_correction():
    rng = random.Random(1)
    for _ in range(50):
        data, checks = [rng.randrange(256) for _ in range(rng.randint(1, 60))], rng.choice([7, 10, 18, 30])
        code = data + qr.rs_encode(data, checks)
        for i in rng.sample(range(len(code)), checks // 2):
            code[i] ^= rng.randrange(1, 256)
        assert qr.rs_decode(code, checks) == data


@pytest.mark.parametrize("version", [*range(1, 11), 14, 21, 26, 27, 32, 36, 40])
def test_modules(version):
    for level in "LMQH":
        data = bytes(random.Random(version).randbytes(5 * version))
        got = qr.decode_modules(qr.encode(data, version, level, mask=version % 8))
        assert (got.payload, got.version, got.level) == (data, version, level)


def test_tables():
    """Known capacities, and marks that are evenly spaced (only the first gap may differ)."""
    for level, words in zip("LMQH", (2956, 2334, 1666, 1276), strict=True):
        assert qr._raw_words(40) - qr._CHECKS[level][39] * qr._BLOCKS[level][39] == words
    for level in "LMQH":
        room = [qr._raw_words(v) - c * b for v, c, b in zip(range(1, 41), qr._CHECKS[level], qr._BLOCKS[level], strict=True)]
        assert room == sorted(set(room))
    assert qr._centres(32) == [6, 34, 60, 86, 112, 138] and qr._centres(40) == [6, 30, 58, 86, 114, 142, 170] and qr._centres(36) == [6, 24, 50, 76, 102, 128, 154]


@pytest.mark.parametrize("version", [12, 19, 28, 40])
def test_large_symbols(version):
    data = random.Random(version).randbytes(15 * version)
    picture = draw(qr.encode(data, version, "Q"), 3)
    for k in (0, 1):
        (hit,) = symbolscan.scan_image(np.rot90(picture, k).copy(), symbolscan.QUICK)
        assert hit[2] == data and hit[7][1:] == ([data], version, "Q") and hit[7][0]


def test_all_bytes_and_turns():
    data = bytes(range(256))
    picture = draw(qr.encode(data, level="L"))
    for k in range(4):
        (hit,) = symbolscan.scan_image(np.rot90(picture, k).copy())
        assert hit[0] == "QR_CODE" and hit[2] == data
    (hit,) = symbolscan.scan_image(picture ^ np.uint32(0xFFFFFF))
    assert hit[2] == data and hit[6]
    damaged = picture.copy()
    damaged[60:70, 100:110] ^= np.uint32(0xFFFFFF)
    assert symbolscan.scan_image(damaged)[0][2] == data
    assert symbolscan.scan_image(np.full((50, 50), 0xFFFFFFFF, np.uint32)) == []


def test_several_and_bars():
    a, b = draw(qr.encode(b"first")), draw(qr.encode(b"second one"))
    canvas = np.full((400, 400), 0xFFFFFFFF, np.uint32)
    canvas[20 : 20 + len(a), 10 : 10 + a.shape[1]] = a
    canvas[200 : 200 + len(b), 180 : 180 + b.shape[1]] = b
    assert sorted(h[2] for h in symbolscan.scan_image(canvas)) == [b"first", b"second one"]
    (hit,) = symbolscan.scan_image(bars("PIXEL-128"))
    assert hit[:2] == ("CODE_128", "PIXEL-128")
    assert symbolscan.scan_image(np.rot90(bars("turned")).copy())[0][1] == "turned"


def test_many_symbols_and_false_finders():
    """30 symbols below a strip of patterns that are finders of no symbol: all are read."""
    ring = np.pad(np.pad(np.ones((3, 3), bool), 1), 1, constant_values=True)
    canvas = np.full((130 + 5 * 116, 6 * 116), 0xFFFFFFFF, np.uint32)
    for k in range(66):
        y, x = 6 + 40 * (k // 22), 6 + 31 * (k % 22)
        canvas[y : y + 21, x : x + 21] = np.where(np.repeat(np.repeat(ring, 3, 0), 3, 1), np.uint32(0xFF000000), np.uint32(0xFFFFFFFF))
    want = []
    for k in range(30):
        symbol = draw(qr.encode(b"no %02d" % k, 1, "L"))
        y, x = 130 + 116 * (k // 6), 116 * (k % 6)
        canvas[y : y + len(symbol), x : x + symbol.shape[1]] = symbol
        want.append(b"no %02d" % k)
    assert sorted(h[2] for h in symbolscan.scan_image(canvas, symbolscan.QUICK)) == want


def test_low_bars_and_bars_side_by_side():
    low, left, right = bars("low")[:3], bars("left"), bars("right")
    canvas = np.full((600, left.shape[1] + right.shape[1]), 0xFFFFFFFF, np.uint32)
    canvas[11:14, : low.shape[1]] = low
    canvas[300:390] = np.concatenate([left, right], 1)
    assert sorted(h[1] for h in symbolscan.scan_image(canvas)) == ["left", "right"]
    assert sorted(h[1] for h in symbolscan.scan_image(canvas, symbolscan.THOROUGH)) == ["left", "low", "right"]


@pytest.mark.parametrize("kind", others.FORMATS)
def test_other_bars(kind):
    rng = random.Random(kind)
    for _ in range(40):
        number = "".join(rng.choice("0123456789") for _ in range(12))
        text, want = {
            "EAN_13": (t := str(rng.randint(1, 9)) + number[:11], t + others.check_digit(t)), "EAN_8": (number[:7], number[:7] + others.check_digit(number[:7])), "UPC_A": (number[:11], number[:11] + others.check_digit(number[:11])),
            "UPC_E": (t := rng.choice("01") + number[:6], t + others.check_digit(others.widened(t))), "CODE_39": ("A-1 $/+%." + number, "A-1 $/+%." + number), "ITF": (number, number), "CODABAR": ("C" + number + "-$:/.+D", number + "-$:/.+"),
        }[kind]
        row = np.repeat(others.encode(kind, text), rng.randint(1, 4))
        assert [g[:2] for g in others.decode_all(row)] == [(kind, want)]
        assert others.decode_all(np.concatenate([row, row]), (kind,))[1][1] == want
    picture = np.where(np.tile(np.repeat(others.encode(kind, text), 3), (60, 1)), np.uint32(0xFF000000), np.uint32(0xFFFFFFFF))
    assert [h[:2] for h in symbolscan.scan_image(np.rot90(picture).copy())] == [(kind, want)]


def test_noise_holds_no_bars():
    assert [others.decode_all(np.random.default_rng(k).random(400) < 0.5) for k in range(300)] == [[]] * 300


def test_uneven_light():
    """A shadow that is darker than other parts' bars: only the threshold by surroundings reads it, in deep scans."""
    picture = draw(qr.encode(b"in the shade", 1, "L"), 3)
    light = np.linspace(0.15, 1, picture.shape[1])
    grey = np.where(picture == 0xFFFFFFFF, 255 * light, 120 * light).astype(np.uint32)
    shaded = np.uint32(0xFF000000) | grey << np.uint32(16) | grey << np.uint32(8) | grey
    assert symbolscan.scan_image(shaded) == []
    assert [h[2] for h in symbolscan.scan_image(shaded, symbolscan.THOROUGH)] == [b"in the shade"]


def test_sequence_through_spark(spark):
    parity = 77
    rows = [(f"i{k}", draw(qr.encode(p, 3, "L", append=(k, 3, parity)))) for k, p in enumerate((b"one ", b"two ", b"three"))]
    images = spark.createDataFrame([(n, p.shape[1], p.shape[0], False, p.astype(">u4").tobytes()) for n, p in rows], "image_id string, width int, height int, has_alpha boolean, pixels binary")
    hits = symbolscan.scan(images)
    seen = hits.orderBy("image_id").first()
    assert [bytes(x) for x in seen.segments] == [b"one "] and seen.version == 3 and seen.level == "L" and seen.rotation == 0 and len(seen.points) == 3 and bytes(seen.raw)
    assert symbols.deduplicate(hits).count() == 3
    merged = symbols.merge_parts(hits).first()
    assert merged.complete and bytes(merged.payload) == b"one two three"


def test_regions(spark):
    r, w, h = regions.region(3, 4, 10, 5), F.lit(12), F.lit(20)
    row = spark.range(1).select(
        regions.clamp(r, w, h).alias("clamped"), regions.expand(r, 2, w, h).alias("expanded"), regions.scaled(r, 0.5).alias("scaled"), regions.from_corners(F.lit(5), F.lit(1), F.lit(2), F.lit(3)).alias("corners"),
        regions.contains(r, F.lit(12), F.lit(8)).alias("inside"), regions.contains(r, F.lit(13), F.lit(8)).alias("outside"), regions.is_empty(regions.intersect(r, regions.region(50, 50, 2, 2))).alias("empty"),
        regions.byte_size(F.lit(2048)).alias("bytes"), regions.snippet(F.lit("a  b\n" + "c" * 60)).alias("snippet"),
    ).first()
    assert tuple(row.clamped) == (3, 4, 9, 5) and tuple(row.expanded) == (1, 2, 11, 9) and tuple(row.scaled) == (1, 2, 6, 3) and tuple(row.corners) == (2, 1, 4, 3)
    assert row.inside and not row.outside and row.empty and row.bytes == "2.0 KiB" and len(row.snippet) == 32


def test_self_check_and_catalogue(spark):
    from pixelsift import selfcheck
    from pixelsift.operators import catalogue

    assert [r.step for r in selfcheck.run(spark).collect() if not r.passed] == []
    rows = {r.idx: r for r in catalogue.catalogue(spark).collect()}
    assert rows[41].next == 0 and rows[0].previous == 41 and rows[9].next_in_group == 2
    assert catalogue.groups(spark).orderBy("first_idx").first().idxs == [0]
