"""Relational work on decoded symbols: joining parts of a sequence, finding and removing duplicate reports."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelsift.operators import payload

#: Reports of one symbol are at most so many pixels apart.
NEAR = 12.0
#: A sequence has at most so many parts.
MOST_PARTS = 16


def merge_parts(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Parts of sequences, grouped by parity and total: one row per sequence.

    ``complete`` sequences (every index once, or repeated with the same content) have a ``payload`` and ``text`` of their
    parts in order; others have none, as nothing is guessed. Columns: keys, append_parity, append_total, n_parts,
    missing, conflicting, complete, payload, text, first_seen (the smallest hit_no). At most 16 distinct parts
    take part in the ordered aggregate, whatever the number of reports.
    """
    keys = keys or []
    group = [*keys, "append_parity", "append_total"]
    parts = hits.where(F.col("append_total").isNotNull())
    text = F.coalesce(F.col("text"), F.lit("\0"))
    slots = parts.groupBy(*group, "append_index").agg(
        F.first("payload").alias("payload"), F.first("text").alias("text"), F.min("hit_no").alias("seen"),
        (F.min("payload").eqNullSafe(F.max("payload")) & (F.min(text) == F.max(text))).alias("same"), F.count(F.lit(1)).alias("n"),
    )
    inside = (F.col("append_index") >= 0) & (F.col("append_index") < F.col("append_total"))
    item = F.struct("append_index", "payload", "text")
    merged = slots.groupBy(*group).agg(
        F.sum("n").alias("n_parts"), F.count_if(inside).alias("_have"), F.count_if(~inside).alias("_outside"), F.count_if(~F.col("same")).alias("conflicting"), F.min("seen").alias("first_seen"),
        F.sort_array(F.collect_list(F.when(inside & (F.col("append_index") < MOST_PARTS), item))).alias("_parts"),
    )
    complete = (F.col("_have") == F.col("append_total")) & (F.col("_outside") == 0) & (F.col("conflicting") == 0) & (F.col("append_total") <= MOST_PARTS)
    joined = F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(F.coalesce(p["payload"], F.lit(b"")))), ""))
    words = F.array_join(F.transform("_parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return merged.select(*group, "n_parts", (F.col("append_total") - F.col("_have")).alias("missing"), "conflicting", complete.alias("complete"), F.when(complete, joined).alias("payload"), F.when(complete, words).alias("text"), "first_seen")


def merge_available(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What there is of each sequence, complete or not: of every index the first report, in order. Columns: keys,
    append_parity, append_total, have, missing (the indexes that are, up to :data:`MOST_PARTS`), payload and text."""
    keys = keys or []
    group = [*keys, "append_parity", "append_total"]
    inside = F.col("append_total").isNotNull() & (F.col("append_index") >= 0) & (F.col("append_index") < F.least(F.col("append_total"), F.lit(MOST_PARTS)))
    first = F.min(F.struct("hit_no", "payload", "text"))
    slots = hits.where(inside).groupBy(*group, "append_index").agg(first.alias("_p"))
    merged = slots.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("append_index", "_p.payload", "_p.text"))).alias("_parts"))
    wanted = F.sequence(F.lit(0), F.least(F.col("append_total"), F.lit(MOST_PARTS)) - 1)
    return merged.select(
        *group, F.size("_parts").alias("have"), F.array_except(wanted, F.transform("_parts", lambda p: p["append_index"])).alias("missing"),
        F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(F.coalesce(p["payload"], F.lit(b"")))), "")).alias("payload"),
        F.array_join(F.transform("_parts", lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"),
    )


def join_segments(segments: Column) -> Column:
    """Byte segments of a symbol as one payload; null when there is nothing."""
    joined = F.unhex(F.array_join(F.transform(segments, lambda s: F.hex(s)), ""))
    return F.when(F.octet_length(joined) > 0, joined)


def label(hits: DataFrame) -> DataFrame:
    """Add ``text_only``, ``label`` (format and kind of content) and ``list_label`` (also size or text, part and turn)."""
    binary = F.coalesce(F.octet_length("payload") > 0, F.lit(False))
    only = ~binary & F.coalesce(F.col("text") != "", F.lit(False))
    kind = payload.type_field(payload.payload_type(F.col("payload")), 2)
    words = F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("…"))).otherwise(F.col("text"))
    what = F.when(binary, F.concat(F.octet_length("payload").cast("string"), F.lit(" bytes, "), kind)).when(only, F.concat(F.lit("text "), words))
    part = F.when(F.col("append_total").isNotNull(), F.concat(F.lit("part "), (F.col("append_index") + 1).cast("string"), F.lit(" of "), F.col("append_total").cast("string")))
    turned = F.when(F.col("rotation") != 0, F.concat(F.lit("turned "), F.col("rotation").cast("string"))) if "rotation" in hits.columns else F.lit(None)
    dark = F.when(F.col("inverted"), F.lit("inverted")) if "inverted" in hits.columns else F.lit(None)
    return hits.select(
        "*", only.alias("text_only"), F.concat_ws(": ", "format", F.when(binary, kind).when(only, F.lit("text only")).otherwise(F.lit("empty"))).alias("label"),
        F.concat_ws("; ", "format", what, part, turned, dark).alias("list_label"),
    )


def summary(hits: DataFrame) -> DataFrame:
    """Per image: symbols, those with a binary payload, and parts of sequences."""
    return hits.groupBy("image_id").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.octet_length("payload") > 0).alias("binary"), F.count_if(F.col("append_total").isNotNull()).alias("parts"))


def content_key(df: DataFrame) -> DataFrame:
    """Add ``content``: the digest of the payload if there is one, else the text."""
    return df.withColumn("content", F.when(F.octet_length("payload") > 0, F.sha2("payload", 256)).otherwise(F.coalesce("text", F.lit(""))))


def same_symbol_pairs(hits: DataFrame) -> DataFrame:
    """(image_id, first, second) of reports that describe one symbol: equal format, text, content and sequence, and near
    each other, unless one of them isn't located.

    Located reports meet those in the cells around their own only; one that isn't located is a pair with every other
    of its content, so that join makes nothing but results."""
    key = F.xxhash64("format", "text", "content", "append_index", "append_total", "append_parity")
    cell = lambda c: F.floor(F.col(c) / NEAR)
    keyed = content_key(hits).where("content != ''").select("image_id", key.alias("_k"), "format", "content", F.coalesce("text", F.lit("\0")).alias("_t"), "hit_no", "located", "bx", "by")
    on = ["image_id", "_k", "format", "content", "_t"]
    one, other = (keyed.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in ("hit_no", "located", "bx", "by")]) for s in "ab")
    here = one.where("located_a").withColumn("_cx", cell("bx_a")).withColumn("_cy", cell("by_a"))
    ways = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = other.where("located_b").withColumn("_w", ways).withColumn("_cx", cell("bx_b") + F.col("_w.x")).withColumn("_cy", cell("by_b") + F.col("_w.y"))
    near = here.join(around, [*on, "_cx", "_cy"]).where((F.col("hit_no_a") < F.col("hit_no_b")) & (F.hypot(F.col("bx_a") - F.col("bx_b"), F.col("by_a") - F.col("by_b")) <= NEAR))
    loose = one.where("NOT located_a").join(other, on).where("located_b OR hit_no_a < hit_no_b").where("hit_no_a != hit_no_b")
    pair = [F.least("hit_no_a", "hit_no_b").alias("first"), F.greatest("hit_no_a", "hit_no_b").alias("second")]
    return near.select("image_id", *pair).unionByName(loose.select("image_id", *pair))


def deduplicate(hits: DataFrame) -> DataFrame:
    """One report per symbol, in order of hit_no: a report is dropped for an earlier one of its content that is kept and near.

    Reports without content all stay. Those that aren't located (or have no place) stay only if none of their image and
    content is, and then the first does. "Near" isn't transitive, so located reports of one content are taken in
    order; of those at one place only the first can stay, so the order is walked over distinct places and their
    hit_no alone. Kept places are more than :data:`NEAR` apart, so each looks at the few in the cells around it.
    """
    names = hits.columns
    group = ["image_id", "content", "format", "text", "append_index", "append_total", "append_parity"]
    placed = F.coalesce(F.col("located"), F.lit(False)) & F.col("bx").isNotNull() & F.col("by").isNotNull()
    keyed = content_key(hits).withColumn("_placed", placed)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    some = keyed.where("content != ''")
    places = some.groupBy(*group, "_placed", F.when(placed, F.col("bx")).alias("_x"), F.when(placed, F.col("by")).alias("_y")).agg(F.min_by(row, "hit_no").alias("_row"), F.min("hit_no").alias("_no"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        located = pdf[pdf["_placed"]].sort_values(["_no", "_x", "_y"])
        if located.empty:
            return pdf[["_row"]]
        cells: dict = {}
        stay = []
        for x, y in zip(located["_x"].tolist(), located["_y"].tolist(), strict=True):
            cx, cy = math.floor(x / NEAR), math.floor(y / NEAR)
            around = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in cells.get((cx + i, cy + j), ()))
            stay.append(all(math.hypot(x - a, y - b) > NEAR for a, b in around))
            if stay[-1]:
                cells.setdefault((cx, cy), []).append((x, y))
        return located.loc[stay, ["_row"]]

    kept = places.groupBy(*group).applyInPandas(walk, places.select("_row").schema)
    return kept.select("_row.*").unionByName(keyed.where("content = ''").select(*names))


def bounding_box(points: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Add x0, y0, x1, y1 around ``points`` (array of x, y), 3 pixels wider, inside the image; no points: all of it."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    some = F.size("points") > 0
    low = lambda a: F.greatest(F.lit(0), (F.floor(F.array_min(a)) - 3).cast("int"))
    high = lambda a, most: F.least(F.col(most), (F.ceil(F.array_max(a)) + 3).cast("int"))
    return points.select("*", F.when(some, low(xs)).otherwise(0).alias("x0"), F.when(some, low(ys)).otherwise(0).alias("y0"), F.when(some, high(xs, width)).otherwise(F.col(width)).alias("x1"), F.when(some, high(ys, height)).otherwise(F.col(height)).alias("y1"))


def adjacent_equal(palette: DataFrame) -> DataFrame:
    """Palette entries that equal the one before them."""
    before = F.lag("argb").over(Window.partitionBy("image_id").orderBy("pal_idx"))
    return palette.withColumn("_b", before).where("argb = _b").drop("_b")
