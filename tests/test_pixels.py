"""Transforms, blends, geometry and stereograms against plain Python, pixel by pixel."""

import random

import pytest
from pyspark.sql import functions as F

from pixelsift.functions import pixels as P
from pixelsift.model import CHANNELS, RANDOM_MAPS, RANDOM_SEED, transforms
from pixelsift.operators import grids

W, H = 11, 6


def image(seed, w=W, h=H):
    rng = random.Random(seed)
    return {(x, y): rng.getrandbits(32) for x in range(w) for y in range(h)}


def frame(spark, px, name="a"):
    return spark.createDataFrame([(name, x, y, v) for (x, y), v in px.items()], "image_id string, x int, y int, argb long")


def back(df):
    return {(r.x, r.y): r.argb for r in df.collect()}


def java_random(seed):
    state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
    while True:
        state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        yield (state >> 40) & 0xFF


def expected(p, kind, channel, number):
    a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
    black = 0xFF000000
    if kind == "original":
        return p
    if kind == "invert":
        return black | (~p & 0xFFFFFF)
    if kind == "plane":
        return 0xFFFFFFFF if p >> (CHANNELS[channel] + number) & 1 else black
    if kind == "full":
        return black | {"alpha": a << 16, "red": r << 16, "green": g << 8, "blue": b}[channel]
    if kind == "map":
        bm, ba, bx, gm, ga, gx, rm, ra, rx = RANDOM_MAPS[number]
        mapped = lambda c, m, add, x: ((c * m * m) ^ x) + add
        return black | ((mapped(r, rm, ra, rx) << 16) + (mapped(g, gm, ga, gx) << 8) + mapped(b, bm, ba, bx)) & 0xFFFFFF
    return 0xFFFFFFFF if r == g == b else black


def test_constants_of_the_random_maps():
    for k, values in RANDOM_MAPS.items():
        source = java_random(RANDOM_SEED + k - 1)
        assert tuple(next(source) for _ in range(9)) == values


def test_catalogue():
    assert [t[0] for t in transforms()] == list(range(42))


def test_all_transforms(spark):
    px = image(1) | {(0, 0): 0, (1, 0): 0xFFFFFFFF, (2, 0): 0x80808080}
    columns = [P.transform(F.col("argb"), i).alias(f"t{i}") for i in range(42)]
    rows = frame(spark, px).select("argb", *columns).collect()
    for r in rows:
        for i, kind, channel, number, _ in transforms():
            assert r[f"t{i}"] == expected(r.argb, kind, channel, number), (i, hex(r.argb))


def test_planes_by_bit(spark):
    with pytest.raises(ValueError):
        P.plane(F.lit(0), 32)


@pytest.mark.parametrize("mode", ["xor", "or", "and", "add", "sub", "mul", "add_ch", "sub_ch", "mul_ch", "light", "dark"])
def test_blend(spark, mode):
    a, b = image(2, 5, 3), image(3, 4, 6)
    whole = {"xor": lambda x, y: x ^ y, "or": lambda x, y: x | y, "and": lambda x, y: x & y, "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y}
    part = {"add_ch": lambda x, y: x + y, "sub_ch": lambda x, y: x - y, "mul_ch": lambda x, y: x * y, "light": max, "dark": min}
    want = {}
    for x in range(5):
        for y in range(6):
            p, q = a.get((x, y), 0) & 0xFFFFFF, b.get((x, y), 0) & 0xFFFFFF
            if mode in whole:
                v = whole[mode](p, q)
            else:
                v = sum((part[mode](p >> s & 255, q >> s & 255) & 255) << s for s in (0, 8, 16))
            want[x, y] = 0xFF000000 | v & 0xFFFFFF
    assert back(grids.blend(frame(spark, a), frame(spark, b, "b"), mode, "c")) == want


def test_interlace(spark):
    a, b = image(4, 5, 3), image(5, 4, 6)
    rows = back(grids.interlace(frame(spark, a), frame(spark, b, "b"), "y", "c"))
    assert set(rows) == {(x, y) for x in range(4) for y in range(6)}
    assert all(v == 0xFF000000 | ((a, b)[y % 2][x, y // 2] & 0xFFFFFF) for (x, y), v in rows.items())
    cols = back(grids.interlace(frame(spark, a), frame(spark, b, "b"), "x", "c"))
    assert all(v == 0xFF000000 | ((a, b)[x % 2][x // 2, y] & 0xFFFFFF) for (x, y), v in cols.items())


def test_stereo(spark):
    px = image(6)
    assert back(grids.stereo_xor(frame(spark, px), -4)) == {(x, y): 0xFF000000 | (v ^ px[(x - 4) % W, y]) & 0xFFFFFF for (x, y), v in px.items()}
    assert back(grids.stereo_edge_hold(frame(spark, px), 3)) == {(x, y): 0xFF000000 | (v ^ px[min(x + 3, W - 1), y]) & 0xFFFFFF for (x, y), v in px.items()}
    assert set(back(grids.stereo_xor(frame(spark, px), 0)).values()) == {0xFF000000}


def test_best_offset(spark):
    px = {(x, y): (x % 6) * 1000 + y for x in range(24) for y in range(8)}
    r = grids.stereo_best_offset(frame(spark, px), 1).first()
    assert (r.offset, r.matches) == (6, 18 * 8)
    assert grids.stereo_best_offset(frame(spark, {(0, 0): 1}), 4).first().offset == 0


def test_geometry(spark):
    px = image(7)
    df = frame(spark, px)
    assert back(grids.rotate(df, 1)) == {(x, y): px[W - 1 - y, x] for x in range(H) for y in range(W)}
    assert back(grids.rotate(grids.rotate(df, 1), 3)) == px == back(grids.rotate(df, 4))
    assert back(grids.rotate(df, 2)) == back(grids.rotate(grids.rotate(df, 1), 1))
    assert back(grids.scale(df, 2.0)) == {(x, y): px[x // 2, y // 2] for x in range(2 * W) for y in range(2 * H)}
    assert set(back(grids.scale(df, 0.01))) == {(0, 0)}
    assert back(grids.crop(df, 2, 1, 3, 2)) == {(x, y): px[x + 2, y + 1] for x in range(3) for y in range(2)}
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            grids.scale(df, bad)


def test_luminance(spark):
    px = image(8)

    def grey(p):
        a = p >> 24
        r, g, b = (((p >> s & 255) * a + (255 - a) * 255) // 255 for s in (16, 8, 0))
        return (306 * r + 601 * g + 117 * b) >> 10

    assert {(r.x, r.y): r.luminance for r in grids.luminance(frame(spark, px)).collect()} == {k: grey(v) for k, v in px.items()}


def test_palette_and_repeated_entries(spark):
    from pixelsift.operators.symbols import adjacent_equal

    palette = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 7, 7, 9])], "image_id string, pal_idx int, argb long")
    px = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 0, 99), ("a", 2, 0, -4)], "image_id string, x int, y int, pal_idx int")
    assert back(grids.palette_map(px, palette)) == {(0, 0): 7, (1, 0): 9, (2, 0): 5}
    assert [r.pal_idx for r in adjacent_equal(palette).collect()] == [2]


def test_several_images_with_holes(spark):
    """Pairs of images by their id; cells that one or both lack count as 0; packing fills them with 0."""
    from pixelsift.sources import images

    a, b, c, d = image(21, 4, 2), image(22, 2, 5), image(23, 3, 3), image(24, 3, 3)
    del c[(0, 1)], d[(0, 1)], d[(2, 2)]
    first, second = frame(spark, a, "p").union(frame(spark, c, "q")), frame(spark, b, "p").union(frame(spark, d, "q"))
    got = {(r.image_id, r.x, r.y): r.argb for r in grids.blend(first, second, "xor").collect()}
    low = lambda v: v & 0xFFFFFF
    want = {("p", x, y): 0xFF000000 | low(a.get((x, y), 0) ^ b.get((x, y), 0)) for x in range(4) for y in range(5)}
    want |= {("q", x, y): 0xFF000000 | low(c.get((x, y), 0) ^ d.get((x, y), 0)) for x in range(3) for y in range(3)}
    assert got == want
    rows = {(r.image_id, r.x, r.y): r.argb for r in grids.interlace(first, second, "y").collect()}
    assert rows == {(i, x, 2 * y + t): 0xFF000000 | low(v) for i, w, h, pair in (("p", 2, 2, (a, b)), ("q", 3, 3, (c, d))) for t, px in enumerate(pair) for (x, y), v in px.items() if x < w and y < h}
    packed = {r.image_id: r for r in images.to_packed(first).collect()}
    assert (packed["q"].width, packed["q"].height) == (3, 3) and len(packed) == 2
    assert bytes(packed["q"].pixels) == b"".join(c.get((x, y), 0).to_bytes(4, "big") for y in range(3) for x in range(3))


@pytest.mark.parametrize("factor", [0.3, 1 / 3, 0.5, 1.0, 1.7, 3.0])
def test_scale_by_hand(spark, factor):
    px = image(31, 13, 7)
    w, h = max(1, int(13 * factor + 0.5)), max(1, int(7 * factor + 0.5))
    assert back(grids.scale(frame(spark, px), factor)) == {(x, y): px[min(12, int(x / factor)), min(6, int(y / factor))] for x in range(w) for y in range(h)}


def test_thumbnail(spark):
    px = image(32, 20, 9)
    small = back(grids.thumbnail(frame(spark, px), 8))
    assert small == {(x, y): px[min(19, int(x / 0.4)), min(8, int(y / 0.4))] for x in range(8) for y in range(4)}
    assert back(grids.thumbnail(frame(spark, px), 32)) == px
    with pytest.raises(ValueError):
        grids.thumbnail(frame(spark, px), 513)
