"""Bit extraction: hand vectors, an independent loop, prefixes, and the search built on it."""

import random
import zlib

import numpy as np

from pixelsift.operators import extract as X
from pixelsift.operators import lsbscan

SHIFT = {"A": 24, "R": 16, "G": 8, "B": 0}


def by_hand(px, w, h, cfg):
    places = [(x, y) for y in range(h) for x in range(w)] if cfg.row_first else [(x, y) for x in range(w) for y in range(h)]
    bits = []
    for x, y in places:
        for c in "A" + cfg.order:
            for p in range(8) if cfg.lsb_first else reversed(range(8)):
                if (c, p) in cfg.planes:
                    bits.append((px[x, y] >> (SHIFT[c] + p) & 1) ^ cfg.invert)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def grid(px, w, h):
    return np.array([[px[x, y] for x in range(w)] for y in range(h)], np.uint32)


def long(spark, px):
    return spark.createDataFrame([("a", x, y, v) for (x, y), v in px.items()], "image_id string, x int, y int, argb long")


def test_eight_pixels(spark):
    px = {(i, 0): b << 16 for i, b in enumerate((1, 0, 1, 1, 0, 0, 1, 0))}
    assert X.extract_packed(grid(px, 8, 1), X.config("R", [0]))[0] == b"\xb2"
    assert X.assemble(X.extract_bits(long(spark, px), X.config("R", [0]))).first().data == b"\xb2"


def test_against_a_loop_and_prefixes(spark):
    rng = random.Random(5)
    for turn in range(60):
        w, h = rng.randint(1, 9), rng.randint(1, 7)
        px = {(x, y): rng.getrandbits(32) for x in range(w) for y in range(h)}
        planes = frozenset((c, p) for c in "ARGB" for p in range(8) if rng.random() < 0.2)
        cfg = X.Config(planes, rng.choice(["RGB", "RBG", "GRB", "GBR", "BRG", "BGR"]), rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5)
        want = by_hand(px, w, h, cfg)
        full, total = X.extract_packed(grid(px, w, h), cfg)
        assert full == want and total == len(want)
        n = rng.randint(0, len(want) + 2)
        assert X.extract_packed(grid(px, w, h), cfg, n)[0] == want[:n]
        if turn < 4:
            got = X.assemble(X.extract_bits(long(spark, px), cfg, max_bytes=n)).collect()
            assert (got[0].data if got else b"") == want[:n]


def test_region(spark):
    rng = random.Random(6)
    px = {(x, y): rng.getrandbits(32) for x in range(12) for y in range(5)}
    cfg = X.config("GB", [1, 3], row_first=False)
    inner = {(x - 2, y - 1): px[x, y] for x in range(2, 9) for y in range(1, 4)}
    assert X.assemble(X.extract_bits(long(spark, px), cfg, (2, 1, 7, 3))).first().data == by_hand(inner, 7, 3, cfg)


def test_configuration_lists():
    for alpha, fast, deep in ((False, 118, 158), (True, 130, 170)):
        assert len(X.fast_configs(alpha)) == fast and len(set(X.fast_configs(alpha))) == fast
        assert len(X.deep_configs(alpha)) == deep and len(set(X.deep_configs(alpha))) == deep
    assert X.fast_configs(False)[0].label() == "RGB · b0 · Row · LSB"
    assert X.config("ARGB", [0], invert=True).label() == "A+RGB · b0 · Row · MSB · Inverted"
    assert X.Config().label() == "(none)"
    assert X.config("AB", [0]).mask() == 1 | 1 << 24


def test_search_finds_a_planted_archive(spark):
    rng = np.random.default_rng(3)
    argb = rng.integers(0, 1 << 32, (40, 60), dtype=np.uint64).astype(np.uint32) | np.uint32(0xFF000000)
    data = b"PK\x03\x04" + zlib.compress(rng.bytes(300))
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    flat = argb.ravel()
    for i, bit in enumerate(bits):
        shift = (16, 8, 0)[i % 3]
        flat[i // 3] = (int(flat[i // 3]) & ~(1 << shift)) | int(bit) << shift
    images = spark.createDataFrame([("a", 60, 40, False, flat.astype(">u4").tobytes())], "image_id string, width int, height int, has_alpha boolean, pixels binary")
    top = lsbscan.scan(images).where("rank = 1").first()
    assert (top.score, top.payload_type, top.opt_idx) == (100, "ZIP", 0)
    assert bytes(top.data).startswith(data)
    full = lsbscan.extract_full(images, X.fast_configs(False)[0]).first()
    assert bytes(full.data).startswith(data) and full.total_bytes == 900


def test_duplicates_keep_their_first_configuration(spark):
    black = spark.createDataFrame([("a", 40, 40, False, bytes(6400))], "image_id string, width int, height int, has_alpha boolean, pixels binary")
    rows = lsbscan.scan(black).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    assert len(rows) < 20 and all(r.score == 1 for r in rows)
