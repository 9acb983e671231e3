"""Sequences and duplicate reports."""

import math
import random

from pixelsift.model import HITS
from pixelsift.operators import symbols


def hit(no, text, payload=None, located=True, x=0.0, y=0.0, append=(None, None, None)):
    return ("a", no, "QR_CODE", text, payload, located, x, y, *append)


def test_sequences(spark):
    rows = [
        hit(0, "B", b"b", append=(1, 2, 5)), hit(1, "A", b"a", append=(0, 2, 5)), hit(2, "A", b"a", append=(0, 2, 5)),  # complete, one part twice
        hit(3, "A", b"a", append=(0, 2, 6)),  # one missing
        hit(4, "A", b"a", append=(0, 1, 7)), hit(5, "Z", b"z", append=(0, 1, 7)),  # conflicting
        hit(6, "A", b"a", append=(3, 2, 8)), hit(7, "plain", b"p"),
    ]
    got = {r.append_parity: r for r in symbols.merge_parts(spark.createDataFrame(rows, HITS)).collect()}
    assert set(got) == {5, 6, 7, 8}
    assert got[5].complete and bytes(got[5].payload) == b"ab" and got[5].text == "AB" and got[5].n_parts == 3
    assert not got[6].complete and got[6].missing == 1 and got[6].payload is None
    assert not got[7].complete and got[7].conflicting == 1
    assert not got[8].complete


def test_duplicates(spark):
    rows = [hit(0, "t", located=False), hit(1, "t", x=5.0), hit(2, "t", x=10.0), hit(3, "t", x=100.0), hit(4, "u", x=5.0), hit(5, None)]
    df = spark.createDataFrame(rows, HITS)
    assert sorted(r.hit_no for r in symbols.deduplicate(df).collect()) == [1, 3, 4, 5]
    pairs = {(r.first, r.second) for r in symbols.same_symbol_pairs(df).collect()}
    assert pairs == {(0, 1), (0, 2), (0, 3), (1, 2)}


def test_duplicates_by_brute_force(spark):
    """Every report against all that were kept before it, one by one."""
    rng = random.Random(3)
    rows = [hit(k, rng.choice("ab"), located=rng.random() < 0.8, x=float(rng.randrange(60)), y=rng.randrange(120) / 2) for k in range(400)]
    rows += [hit(500, "c", located=False), hit(501, "c", located=False), hit(502, "d", x=None), hit(503, ""), hit(504, "")]
    kept: list = []
    for r in rows:
        same = [k for k in kept if r[3] and k[3] == r[3] and (not r[5] or not k[5] or r[6] is None or math.hypot(r[6] - k[6], r[7] - k[7]) <= 12)]
        if not same:
            kept.append(r)
        elif r[5] and not same[0][5]:
            kept[kept.index(same[0])] = r
    got = symbols.deduplicate(spark.createDataFrame(rows, HITS).repartition(5))
    assert got.columns == spark.createDataFrame([], HITS).columns
    assert sorted(r.hit_no for r in got.collect()) == sorted(k[1] for k in kept)
    assert symbols.deduplicate(spark.createDataFrame([], HITS)).collect() == []


def test_equal_payloads_are_one(spark):
    rows = [hit(0, "t", b"x"), hit(1, "t", b"x"), hit(2, "v", b"long")]
    assert sorted(r.hit_no for r in symbols.deduplicate(spark.createDataFrame(rows, HITS)).collect()) == [0, 2]


def test_box(spark):
    df = spark.createDataFrame([([(10.5, 4.0), (20.0, 2.0)], 22, 30), ([], 9, 8)], "points array<struct<x: double, y: double>>, width int, height int")
    assert [(r.x0, r.y0, r.x1, r.y1) for r in symbols.bounding_box(df).collect()] == [(7, 0, 22, 7), (0, 0, 9, 8)]
