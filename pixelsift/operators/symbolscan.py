"""Symbols in images: passes over packed images, hits as rows.

The passes of an image run one after another and stop when something is found, unless the scan is deep: as it
is, inverted, turned, then at another scale; a deep scan also tries three times the size and a threshold that
follows the surroundings of each pixel. Every image is one row of one Arrow batch, so a scan is a map.
Limits are numbers of passes, never seconds, so results don't depend on the machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelsift.model import HITS
from pixelsift.operators import bars, code128, qr

FORMATS = ("QR_CODE", "CODE_128", *bars.FORMATS)
#: Side of the squares whose mean is the threshold of their middle pixel.
AROUND = 41
#: Hits that leave in one batch: a batch for each picture costs as much as the scan of one with bars.
TOGETHER = 1024


@dataclass(frozen=True)
class Options:
    formats: tuple = FORMATS
    inverted: bool = True
    turns: bool = True
    rescale: bool = True
    deep: bool = False
    #: Rows in which bars are looked for; a deep scan reads all.
    rows: int = 24


QUICK = Options(turns=False, rescale=False)
THOROUGH = Options(deep=True)


def luminance(argb: np.ndarray) -> np.ndarray:
    a = argb >> np.uint32(24)
    white = (np.uint32(255) - a) * np.uint32(255)
    r, g, b = ((((argb >> np.uint32(s)) & np.uint32(255)) * a + white) // np.uint32(255) for s in (16, 8, 0))
    return ((np.uint32(306) * r + np.uint32(601) * g + np.uint32(117) * b) >> np.uint32(10)).astype(np.int32)


def _once(dark: np.ndarray, o: Options) -> list[tuple]:
    """(format, text, payload, points, append, (raw codewords, byte segments, version, level)) of one pass; bars have no last part."""
    out: list[tuple] = []
    if "QR_CODE" in o.formats:
        out += [("QR_CODE", s.text, s.payload, s.points, s.append, (s.raw, s.segments, s.version, s.level)) for s in qr.locate(dark)]
    lines = tuple(f for f in o.formats if f in bars.FORMATS)
    if "CODE_128" in o.formats or lines:
        rows = np.arange(len(dark)) if o.deep else np.unique(np.linspace(0, len(dark) - 1, o.rows + 2).astype(int)[1:-1])
        gap = max(12, 2 * int(np.diff(rows).max(initial=1)))
        alike = np.cumsum((dark[1:] != dark[:-1]).any(1), dtype=np.int64)
        alike = [0, *alike.tolist()]  # one number for equal rows that follow each other
        seen: list[list] = []  # format and text, first and last pixel, row it was last read in
        got, last = [], None
        for y in rows.tolist():
            if last is None or (alike[y] != alike[last] and not np.array_equal(dark[y], dark[last])):
                got, last = [("CODE_128", *g) for g in code128.decode_all(dark[y])] if "CODE_128" in o.formats else [], y
                got += bars.decode_all(dark[y], lines) if lines else []
            for kind, text, x0, x1 in got:
                same = [f for f in seen if f[0] == (kind, text) and f[1] < x1 and x0 < f[2] and y - f[3] <= gap]
                if same:
                    same[0][1:] = x0, x1, y
                else:
                    seen.append([(kind, text), x0, x1, y])
                    out.append((kind, text, None, [(float(x0), float(y)), (float(x1), float(y))], None, None))
    return out


def _uneven(grey: np.ndarray) -> np.ndarray:
    """Pixels darker than the mean of the square around them, by a margin; for pictures with uneven light."""
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(grey, 0), 1, out=total[1:, 1:])
    y0, y1 = (np.clip(np.arange(h) + k, 0, h) for k in (-(AROUND // 2), AROUND // 2 + 1))
    x0, x1 = (np.clip(np.arange(w) + k, 0, w) for k in (-(AROUND // 2), AROUND // 2 + 1))
    inside = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return (grey + 8) * ((y1 - y0)[:, None] * (x1 - x0)) < inside


def _back(x: float, y: float, turns: int, w: int, h: int) -> tuple[float, float]:
    """A point of the picture after quarter turns, in the picture before them."""
    return {0: (x, y), 1: (w - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, h - 1 - x)}[turns]


def scan_image(argb: np.ndarray, o: Options = Options()) -> list[tuple]:
    """Hits of one image: (format, text, payload, points in the image, append, turns, inverted, the rest of :func:`_once`)."""
    # of equal rows that follow each other, as bars have many, the first is worked out
    first = np.concatenate([[True], (argb[1:] != argb[:-1]).any(1)])
    grey = luminance(argb if first.all() else argb[first])
    dark = grey < (int(grey.min()) + int(grey.max()) + 1) // 2 if grey.min() < grey.max() else np.zeros_like(grey, bool)
    if len(dark) < len(argb):
        dark, grey = (x[np.cumsum(first) - 1] for x in (dark, grey))
    h, w = dark.shape
    found: list[tuple] = []

    def add(hits: list[tuple], turns: int, inverted: bool, scale: float = 1.0) -> None:
        for kind, text, payload, points, append, more in hits:
            there = [_back(x, y, turns, round(w * scale), round(h * scale)) for x, y in points]
            there = [(x / scale, y / scale) for x, y in there]
            same = [f for f in found if f[:3] == (kind, text, payload) and f[4] == append and np.hypot(f[3][0][0] - there[0][0], f[3][0][1] - there[0][1]) <= 12]
            if not same:
                found.append((kind, text, payload, there, append, turns, inverted, more))

    add(_once(dark, o), 0, False)
    if o.inverted and (o.deep or not found):
        add(_once(~dark, o), 0, True)
    if o.turns and (o.deep or not found):
        for k in (1, 2, 3):
            add(_once(np.rot90(dark, k), o), k, False)
    if o.rescale and (o.deep or not found):
        if max(h, w) < 400:
            add(_once(np.repeat(np.repeat(dark, 2, 0), 2, 1), o), 0, False, 2.0)
        elif max(h, w) > 2600:
            add(_once(dark[::2, ::2], o), 0, False, 0.5)
    if o.deep:
        if o.rescale and max(h, w) < 400:
            add(_once(np.repeat(np.repeat(dark, 3, 0), 3, 1), o), 0, False, 3.0)
        add(_once(_uneven(grey), o), 0, False)
    return found


#: What a scan adds to a hit: how the picture was seen, and what a QR symbol holds besides payload and text.
SEEN = "rotation int, inverted boolean, points array<struct<x: double, y: double>>, raw binary, segments array<binary>, version int, level string"


_POINT = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_FOUND = pa.schema([
    ("image_id", pa.string()), ("hit_no", pa.int32()), ("format", pa.string()), ("text", pa.string()), ("payload", pa.binary()), ("located", pa.bool_()), ("bx", pa.float64()), ("by", pa.float64()),
    *[(f"append_{n}", pa.int32()) for n in ("index", "total", "parity")], ("rotation", pa.int32()), ("inverted", pa.bool_()),
    ("points", _POINT), ("raw", pa.binary()), ("segments", pa.list_(pa.binary())), ("version", pa.int32()), ("level", pa.string()),
])


def hits(batches: Iterable[pa.RecordBatch], options: Options = Options()) -> Iterable[pa.RecordBatch]:
    """Hits of batches of (image_id, width, height, ..., pixels), for use in a step that makes the pictures itself."""
    rows: list[dict] = []
    for batch in batches:
        for image, w, h, data in zip(*(batch.column(k).to_pylist() for k in ("image_id", "width", "height", "pixels")), strict=True):
            for no, (kind, text, payload, points, append, turns, inverted, more) in enumerate(scan_image(np.frombuffer(data, ">u4").astype(np.uint32).reshape(h, w), options)):
                corner, places = (min(x for x, _ in points), min(y for _, y in points)), [{"x": x, "y": y} for x, y in points]
                rows.append(dict(zip(_FOUND.names, (image, no, kind, text, payload, True, *corner, *(append or (None,) * 3), 90 * turns, inverted, places, *(more or (None,) * 4)), strict=True)))
            if len(rows) >= TOGETHER:
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)


def scan(images: DataFrame, options: Options = Options()) -> DataFrame:
    """Hits of packed images, in the layout of :data:`~pixelsift.model.HITS`, with the columns of :data:`SEEN`: ``rotation`` in
    degrees, ``points`` of the symbol in the image, and of QR symbols the codewords after correction (``raw``), the byte
    ``segments`` that make up the payload, ``version`` and ``level``."""
    return images.select("image_id", "width", "height", "pixels").mapInArrow(lambda batches: hits(batches, options), f"{HITS}, {SEEN}")


def scan_made(rows: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], options: Options = Options()) -> DataFrame:
    """The same for pictures that ``make`` draws from batches of rows: drawn and scanned in one step, so that a picture is in
    memory only while it is looked at. Spark would gather thousands of them in one batch on their way."""
    return rows.mapInArrow(lambda batches: hits(make(batches), options), f"{HITS}, {SEEN}")
