"""Regions, coordinates and texts for people, as column expressions. A region is a struct of x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def region(x, y, width, height) -> Column:
    as_int = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(as_int(x).alias("x"), as_int(y).alias("y"), as_int(width).alias("width"), as_int(height).alias("height"))


def _edges(r: Column) -> tuple[Column, Column, Column, Column]:
    return r["x"], r["y"], r["x"] + r["width"], r["y"] + r["height"]


def _of_edges(x0, y0, x1, y1) -> Column:
    return region(x0, y0, F.greatest(F.lit(0), x1 - x0), F.greatest(F.lit(0), y1 - y0))


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The region between two corners in any order, both included."""
    return region(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0) + 1, F.abs(y1 - y0) + 1)


def intersect(a: Column, b: Column) -> Column:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = _edges(a), _edges(b)
    return _of_edges(F.greatest(ax0, bx0), F.greatest(ay0, by0), F.least(ax1, bx1), F.least(ay1, by1))


def clamp(r: Column, width: Column, height: Column) -> Column:
    """The part of a region inside an image."""
    return intersect(r, region(0, 0, width, height))


def is_empty(r: Column) -> Column:
    return (r["width"] <= 0) | (r["height"] <= 0)


def contains(r: Column, x: Column, y: Column) -> Column:
    x0, y0, x1, y1 = _edges(r)
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def expand(r: Column, by: int, width: Column, height: Column) -> Column:
    """Larger on every side, inside the image."""
    x0, y0, x1, y1 = _edges(r)
    return clamp(_of_edges(x0 - by, y0 - by, x1 + by, y1 + by), width, height)


def scaled(r: Column, factor: float) -> Column:
    """Multiplied, outward to whole pixels."""
    x0, y0, x1, y1 = _edges(r)
    return _of_edges(F.floor(x0 * factor), F.floor(y0 * factor), F.ceil(x1 * factor), F.ceil(y1 * factor))


def turn_back(x: Column, y: Column, turns: int, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of an image after counter-clockwise quarter turns, in the image (width by height) before them."""
    return {0: (x, y), 1: (width - 1 - y, x), 2: (width - 1 - x, height - 1 - y), 3: (y, height - 1 - x)}[turns % 4]


def scale_back(v: Column, factor: float) -> Column:
    return v / F.lit(float(factor))


def zoom_to_image(v: Column, pan: Column, zoom: Column) -> Column:
    """A place in a zoomed and panned view, in the image."""
    return (v - pan) / zoom


def byte_size(n: Column) -> Column:
    """Bytes, KiB or MiB."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KiB", n / 1024.0)).otherwise(F.format_string("%.1f MiB", n / 1048576.0))


def percent(share: Column) -> Column:
    return F.format_string("%.1f %%", share * 100)


def snippet(text: Column, most: int = 32) -> Column:
    """One line of a text, at most so long."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def selection_text(r: Column) -> Column:
    return F.format_string("%d × %d at %d, %d", r["width"], r["height"], r["x"], r["y"])


def device_rectangle(x: Column, y: Column, width: Column, height: Column, scale_x: Column, scale_y: Column) -> Column:
    """A rectangle of a screen in its device's pixels; scales that aren't positive count as 1. Empty ones are null."""
    sx, sy = (F.when(s <= 0, F.lit(1.0)).otherwise(s) for s in (scale_x, scale_y))
    made = region(F.floor(x * sx), F.floor(y * sy), F.greatest(F.lit(1), F.ceil(width * sx)), F.greatest(F.lit(1), F.ceil(height * sy)))
    return F.when((width > 0) & (height > 0), made)


def step_offset(offset: Column, width: Column, by: int = 1) -> Column:
    """The next (1) or previous (-1) offset of a stereogram, around the width."""
    return F.pmod(F.pmod(offset, width) + by, width).cast("int")
