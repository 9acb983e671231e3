"""Operators on long pixels: combining, stereograms, geometry, regions. Each is a projection or an equi-join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsift.functions import pixels as P


def size(px: DataFrame) -> DataFrame:
    """Width and height of each image."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def apply(px: DataFrame, index: int) -> DataFrame:
    """Transform 0..41 of the catalogue."""
    return px.withColumn("argb", P.transform(F.col("argb"), index))


def palette_map(indices: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels that hold palette indices, through a palette (image_id, pal_idx, argb); indices beyond it count as its last.

    Palettes have at most 256 rows an image; whether they are broadcast is left to Spark's check of their size.
    """
    last = palette.groupBy("image_id").agg(F.max("pal_idx").alias("_last"))
    clamped = indices.join(last, "image_id").withColumn("pal_idx", F.greatest(F.lit(0), F.least("pal_idx", "_last")))
    return clamped.join(palette, ["image_id", "pal_idx"]).select("image_id", "x", "y", "argb")


def _named(px: DataFrame, image_id: str | None) -> DataFrame:
    return px if image_id is None else px.withColumn("image_id", F.lit(image_id))


def _beyond(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cells of each pair's larger width and height that neither image may have: the corner outside two full
    rectangles, or all cells where one of them has holes. Rows are dealt out before their cells are made."""
    full = lambda s: F.col(f"n{s}") == F.col(f"w{s}").cast("long") * F.col(f"h{s}")
    a, b = (
        px.groupBy("image_id").agg((F.max("x") + 1).alias(f"w{n}"), (F.max("y") + 1).alias(f"h{n}"), F.count(F.lit(1)).alias(f"n{n}"))
        for px, n in ((first, 1), (second, 2))
    )
    both = a.join(b, "image_id", "full").na.fill(0)
    whole = full(1) & full(2)
    corner = whole & (((F.col("w1") < F.col("w2")) & (F.col("h2") < F.col("h1"))) | ((F.col("w2") < F.col("w1")) & (F.col("h1") < F.col("h2"))))
    sized = both.where(corner | ~whole).select(
        "image_id", F.greatest("w1", "w2").alias("w"), F.greatest("h1", "h2").alias("h"),
        F.when(whole, F.least("w1", "w2")).otherwise(0).alias("x0"), F.when(whole, F.least("h1", "h2")).otherwise(0).alias("y0"),
    )
    rows = sized.select("image_id", "x0", "w", F.explode(F.sequence("y0", F.col("h") - 1)).alias("y")).repartition("image_id", "y")
    return rows.select("image_id", F.explode(F.sequence("x0", F.col("w") - 1)).alias("x"), "y")


def blend(first: DataFrame, second: DataFrame, mode: str, image_id: str | None = None) -> DataFrame:
    """Images with the same id, pixel by pixel, on the larger width and height; a pixel that one of them lacks is 0.
    With ``image_id``, each side is one image and the result has this name.

    One aggregation by cell, with map-side halves; cells that neither has are added to it.
    """
    first, second = _named(first, image_id), _named(second, image_id)
    none = F.lit(None).cast("long")
    sides = (
        first.select("image_id", "x", "y", F.col("argb").alias("_a"), none.alias("_b"))
        .unionByName(second.select("image_id", "x", "y", none.alias("_a"), F.col("argb").alias("_b")))
        .unionByName(_beyond(first, second).select("image_id", "x", "y", none.alias("_a"), none.alias("_b")))
    )
    zero = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c)
    cells = sides.groupBy("image_id", "x", "y").agg(zero("_a"), zero("_b"))
    return cells.select("image_id", "x", "y", P.combine(F.col("_a"), F.col("_b"), mode).alias("argb"))


def interlace(first: DataFrame, second: DataFrame, axis: str, image_id: str | None = None) -> DataFrame:
    """Rows (axis "y") or columns ("x") of two images with the same id in turn, over their common area; the first has
    the even ones. With ``image_id``, each side is one image and the result has this name."""
    first, second = _named(first, image_id), _named(second, image_id)
    a, b = (size(p).select("image_id", F.col("w").alias(f"w{n}"), F.col("h").alias(f"h{n}")) for p, n in ((first, 1), (second, 2)))
    common = a.join(b, "image_id").select("image_id", F.least("w1", "w2").alias("_w"), F.least("h1", "h2").alias("_h"))
    out = []
    for turn, px in enumerate((first, second)):
        inside = px.join(common, "image_id").where((F.col("x") < F.col("_w")) & (F.col("y") < F.col("_h")))
        place = [(F.col(c) * 2 + turn if c == axis else F.col(c)).alias(c) for c in ("x", "y")]
        out.append(inside.select("image_id", *place, P.opaque(F.col("argb")).alias("argb")))
    return out[0].unionByName(out[1])


def _shifted(px: DataFrame, offset: int, source: Column) -> DataFrame:
    """Each pixel with the one of its row at ``source`` (an expression of x and w)."""
    left = px.join(size(px).select("image_id", "w"), "image_id").withColumn("_x", source)
    right = px.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x2"), F.col("argb").alias("_other"))
    return left.join(right, (left["image_id"] == right["image_id"]) & (F.col("y") == F.col("_y")) & (F.col("_x") == F.col("_x2"))).select(left["image_id"], "x", "y", "argb", "_other")


def stereo_xor(px: DataFrame, offset: int) -> DataFrame:
    """A stereogram against itself, shifted around the edge; offset 0 is black."""
    both = _shifted(px, offset, F.pmod(F.col("x") + offset, F.col("w")))
    return both.select("image_id", "x", "y", P.opaque(F.col("argb").bitwiseXOR(F.col("_other"))).alias("argb"))


def stereo_edge_hold(px: DataFrame, offset: int) -> DataFrame:
    """The same, but beyond the edge the last pixel of the row is used."""
    both = _shifted(px, offset, F.least(F.col("x") + offset, F.col("w") - 1))
    return both.select("image_id", "x", "y", P.opaque(F.col("argb").bitwiseXOR(F.col("_other"))).alias("argb"))


def stereo_matches(px: DataFrame, step: int = 4) -> DataFrame:
    """For every offset from 1 to half the width: equal pairs on every step-th row and column.

    Rows of images are gathered, shifted against themselves in numpy and summed by offset, so what moves is each pixel
    of the sampled rows once, and a count per task and offset.
    """
    step = max(1, step)
    cells = px.where(F.col("y") % step == 0).groupBy("image_id", "y").agg(F.collect_list("x").alias("xs"), F.collect_list("argb").alias("values"))
    rows = cells.join(size(px).select("image_id", "w"), "image_id").where("w >= 2").select("image_id", "w", "xs", "values")

    def run(batches):
        for batch in batches:
            lines: dict = {}
            for i, (image, w) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                line = np.full(w, -1, np.int64)
                line[batch.column(2)[i].values.to_numpy(zero_copy_only=False)] = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                lines.setdefault((image, w), []).append(line)
            for (image, w), own in lines.items():
                grid, most = np.stack(own), max(1, w // 2)
                n = []
                for offset in range(1, most + 1):
                    left = grid[:, : w - offset : step]
                    n.append(int(((left == grid[:, offset::step][:, : left.shape[1]]) & (left >= 0)).sum()))
                found = [pa.array([image] * most), pa.array(np.arange(1, most + 1, dtype=np.int32)), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(found, names=["image_id", "offset", "n"])

    counted = rows.mapInArrow(run, "image_id string, offset int, n long")
    return counted.groupBy("image_id", "offset").agg(F.sum("n").alias("matches"))


def stereo_best_offset(px: DataFrame, step: int = 4) -> DataFrame:
    """The offset with most equal pairs; of equals the smallest. Images narrower than two pixels have offset 0."""
    best = stereo_matches(px, step).groupBy("image_id").agg(F.max(F.struct(F.col("matches").alias("m"), (-F.col("offset")).alias("o"))).alias("b"))
    return size(px).select("image_id").join(best, "image_id", "left").select("image_id", F.coalesce(-F.col("b.o"), F.lit(0)).cast("int").alias("offset"), F.coalesce(F.col("b.m"), F.lit(0)).cast("long").alias("matches"))


def crop(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A region, moved to the origin."""
    if width <= 0 or height <= 0:
        raise ValueError("the region is empty")
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return px.where(inside).select("image_id", (F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), "argb")


def rotate(px: DataFrame, turns: int) -> DataFrame:
    """Quarter turns counter-clockwise."""
    turns %= 4
    if turns == 0:
        return px
    with_size = px.join(size(px), "image_id")
    x, y, right, bottom = F.col("x"), F.col("y"), F.col("w") - 1, F.col("h") - 1
    nx, ny = {1: (y, right - x), 2: (right - x, bottom - y), 3: (bottom - y, x)}[turns]
    return with_size.select("image_id", nx.alias("x"), ny.alias("y"), "argb")


def _scaled(sized: DataFrame) -> DataFrame:
    """Pixels with w, h and the factor ``_f`` of their image: each computes the target places that it fills."""

    def filled(at: str, most: str, name: str):
        # a few places around the product are tried with the rule itself: the source of n is n / factor
        last = F.greatest(F.lit(1), F.floor(F.col(most) * F.col("_f") + 0.5).cast("int")) - 1
        low = F.greatest(F.lit(0), F.floor(F.col(at) * F.col("_f")).cast("int") - 1)
        high = F.when(F.col(at) == F.col(most) - 1, last).otherwise(F.least(last, F.floor((F.col(at) + 1) * F.col("_f")).cast("int") + 1))
        near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        takes = lambda n: F.least(F.col(most) - 1, F.floor(n / F.col("_f")).cast("int")) == F.col(at)
        return F.explode(F.filter(near, takes)).alias(name)

    wide = sized.select("image_id", "y", "h", "_f", "argb", filled("x", "w", "_x"))
    return wide.select("image_id", "_x", "argb", filled("y", "h", "_y")).select("image_id", F.col("_x").alias("x"), F.col("_y").alias("y"), "argb")


def scale(px: DataFrame, factor: float) -> DataFrame:
    """Nearest neighbour: every target pixel takes the one at its coordinates divided by the factor. Nothing but the
    sizes is joined."""
    if not factor > 0:
        raise ValueError("the factor must be positive")
    return _scaled(px.join(size(px), "image_id").withColumn("_f", F.lit(float(factor))))


def thumbnail(px: DataFrame, most: int) -> DataFrame:
    """Every image, nearest neighbour, so that its longer side has ``most`` pixels (1 to 512); smaller images stay."""
    if not 1 <= most <= 512:
        raise ValueError("a thumbnail has 1 to 512 pixels")
    return _scaled(px.join(size(px), "image_id").withColumn("_f", F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("w", "h"))))


def luminance(px: DataFrame, inverted: bool = False) -> DataFrame:
    grey = P.luminance(F.col("argb"))
    return px.select("image_id", "x", "y", (F.lit(255) - grey if inverted else grey).cast("int").alias("luminance"))
