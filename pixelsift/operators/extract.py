"""Bits of chosen planes, pixel by pixel, as bytes.

A configuration says which planes are taken (alpha first, then the colours in some order; each channel's planes
from 7 down or from 0 up), whether pixels are visited by rows or columns, and whether bits are inverted.
The place of every bit has a closed form: a pixel makes at most five bytes, the first and last of which it may share
with its neighbours, so extraction over long pixels is one projection and one aggregation, without window or sort (none
if pixels fill whole bytes), and a bound on the bytes becomes a filter before it.
The packed form does the same with numpy for one image at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsift.model import RGB_ORDERS
from pixelsift.operators.grids import crop, size

_SHIFT = {"A": 24, "R": 16, "G": 8, "B": 0}
_RANK = {"A": 0, "R": 1, "G": 2, "B": 3}


@dataclass(frozen=True)
class Config:
    """planes: (channel letter, plane) pairs; order: of the colours, such as "BGR"."""

    planes: frozenset = frozenset()
    order: str = "RGB"
    lsb_first: bool = False
    row_first: bool = True
    invert: bool = False

    def bits(self) -> list[int]:
        """Bit positions within a pixel, in the order in which they are taken."""
        planes = range(8) if self.lsb_first else range(7, -1, -1)
        return [_SHIFT[c] + p for c in "A" + self.order for p in planes if (c, p) in self.planes]

    def mask(self) -> int:
        return sum(1 << (_RANK[c] * 8 + p) for c, p in self.planes)

    def argb_mask(self) -> int:
        return sum(1 << (_SHIFT[c] + p) for c, p in self.planes)

    def output_size(self, pixels: int) -> int:
        return (pixels * len(self.planes) + 7) // 8

    def label(self) -> str:
        """For people: channels, planes, traversal, bit order, inversion."""
        if not self.planes:
            return "(none)"
        used = {c for c, _ in self.planes}
        colours = "".join(c for c in self.order if c in used)
        name = ("A" + "+" * (len(colours) == 3) if "A" in used else "") + colours
        planes = ",".join(map(str, sorted({p for _, p in self.planes})))
        return " · ".join([name, f"b{planes}", "Row" if self.row_first else "Col", "LSB" if self.lsb_first else "MSB", *["Inverted"] * self.invert])


def config(channels: str, planes, **rest) -> Config:
    return Config(frozenset((c, p) for c in channels for p in planes), **rest)


ALL_PLANES = config("ARGB", range(8))
RGB_LSB = config("RGB", [0])


def extract_bits(px: DataFrame, cfg: Config, roi: tuple[int, int, int, int] | None = None, max_bytes: int | None = None) -> DataFrame:
    """(image_id, byte_idx, value) of each image; the last byte is padded with zeros."""
    px = crop(px, *roi) if roi else px
    bits = cfg.bits()
    k = len(bits)
    if k == 0 or max_bytes == 0:
        return px.select("image_id", F.lit(0).cast("long").alias("byte_idx"), F.lit(0).alias("value")).where("false")
    sized = px.join(size(px), "image_id")
    rank = F.col("y").cast("long") * F.col("w") + F.col("x") if cfg.row_first else F.col("x").cast("long") * F.col("h") + F.col("y")
    ranked = sized.select("image_id", rank.alias("rank"), (F.lit((1 << 32) - 1) - F.col("argb") if cfg.invert else F.col("argb")).alias("argb"))
    if max_bytes is not None:  # pixels whose first bit is beyond the bound aren't looked at
        ranked = ranked.where(F.col("rank") * k < 8 * max_bytes)
    # the pixel's bits as one number; bits that follow each other in the pixel move together
    taken, i = F.lit(0).cast("long"), 0
    while i < k:
        n = 1
        while i + n < k and bits[i + n] == bits[i] - n:
            n += 1
        part = F.shiftrightunsigned(F.col("argb"), bits[i] - n + 1).bitwiseAND(F.lit((1 << n) - 1))
        taken, i = taken + F.shiftleft(part, k - i - n), i + n
    start = F.col("rank") * k
    n_bytes = F.shiftright(F.pmod(start, F.lit(8)) + k + 7, 3).cast("int")
    number = ranked.select("image_id", F.shiftright(start, 3).alias("_first"), n_bytes.alias("_n"), taken.alias("_v"), F.pmod(start, F.lit(8)).cast("int").alias("_off"))
    shifted = number.withColumn("_v", F.expr(f"shiftleft(_v, _n * 8 - _off - {k})"))
    byte = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct((F.col("_first") + j).alias("byte_idx"), j.alias("j")))
    flat = shifted.select("image_id", "_v", "_n", F.explode(byte).alias("_b")).select("image_id", F.col("_b.byte_idx").alias("byte_idx"), F.expr("cast(shiftright(_v, 8 * (_n - 1 - _b.j)) & 255 as int)").alias("value"))
    if max_bytes is not None:
        flat = flat.where(F.col("byte_idx") < max_bytes)
    return flat if k % 8 == 0 else flat.groupBy("image_id", "byte_idx").agg(F.sum("value").cast("int").alias("value"))


def assemble(extracted: DataFrame) -> DataFrame:
    """Bytes in order, one row per image. Meant for bounded extracts: the bytes of an image meet in one row."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("byte_idx", "value"))), lambda e: F.lpad(F.hex(e["value"]), 2, "0"))
    return extracted.groupBy("image_id").agg(F.unhex(F.array_join(ordered, "")).alias("data"))


def extract_packed(argb: np.ndarray, cfg: Config, max_bytes: int | None = None) -> tuple[bytes, int]:
    """Bytes of one image (a height by width array of uint32), and how many there are without the bound."""
    bits = cfg.bits()
    total = cfg.output_size(argb.size)
    if not bits or max_bytes == 0:
        return b"", total
    flat = (argb if cfg.row_first else argb.T).ravel()
    if max_bytes is not None:
        flat = flat[: -(-8 * max_bytes // len(bits))]
    if cfg.invert:
        flat = ~flat
    taken = np.stack([(flat >> np.uint32(b)).astype(np.uint8) & 1 for b in bits], axis=1)
    data = np.packbits(taken.ravel()).tobytes()
    return (data if max_bytes is None else data[:max_bytes]), total


_ORDERS = list(RGB_ORDERS.values())


def fast_configs(has_alpha: bool) -> list[Config]:
    """The usual suspects: 118 configurations, 130 with alpha."""
    ways = (True, False)
    flips = (False, True)
    out = [config("RGB", [0], order=o, row_first=r, lsb_first=True, invert=i) for o in _ORDERS for r in ways for i in flips]
    for plane in (1, 2):
        out += [config("RGB", [plane], order=o, row_first=r, lsb_first=True) for o in ("RGB", "BGR") for r in ways]
    out += [config("RGB", [0, 1], order=o, row_first=r, lsb_first=first, invert=i) for o in _ORDERS for r in ways for first in ways for i in flips]
    out += [config("RGB", [0, 1, 2], order=o, row_first=r, lsb_first=first) for o in ("RGB", "BGR") for r in ways for first in ways]
    for c in "RGB":
        for r in ways:
            one = [config(c, [0], row_first=r, lsb_first=True, invert=i) for i in flips]
            out += [*one, config(c, [1], row_first=r, lsb_first=True), *[config(c, [0, 1], row_first=r, lsb_first=first) for first in ways]]
    if has_alpha:
        out += [config("A", [0], row_first=r, lsb_first=True, invert=i) for r in ways for i in flips]
        out += [config("ARGB", [0], order=o, row_first=r, lsb_first=True, invert=i) for o in ("RGB", "BGR") for r in ways for i in flips]
    return out


def deep_configs(has_alpha: bool) -> list[Config]:
    """The fast ones and 40 more."""
    ways = (True, False)
    out = fast_configs(has_alpha)
    out += [config("RGB", [0, 1, 2], order=o, row_first=r, lsb_first=first) for o in ("RBG", "GRB", "GBR", "BRG") for r in ways for first in ways]
    out += [config("RGB", [0, 1, 2, 3], order=o, row_first=r, lsb_first=first) for o in ("RGB", "BGR") for r in ways for first in ways]
    out += [config("RGB", [7], order=o, row_first=r, lsb_first=False) for o in ("RGB", "BGR") for r in ways]
    for c in "RGB":
        out += [cfg for r in ways for cfg in (config(c, [2], row_first=r, lsb_first=True), config(c, [7], row_first=r, lsb_first=False))]
    return out


def with_plane(cfg: Config, channel: str, plane: int, on: bool = True) -> Config:
    return replace(cfg, planes=cfg.planes | {(channel, plane)} if on else cfg.planes - {(channel, plane)})
