"""The transform catalogue as a table: neighbours in it and in a group, and groups in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelsift.model import transforms


def group_of(kind: Column, channel: Column) -> Column:
    return F.when(kind == "plane", F.concat(channel, F.lit(" planes"))).when(kind == "map", F.lit("random maps")).otherwise(kind)


def catalogue(spark: SparkSession) -> DataFrame:
    """42 rows: idx, kind, channel, number, label, group, and the next and previous idx, around the end, in all and in the group."""
    rows = spark.createDataFrame(transforms(), "idx int, kind string, channel string, number int, label string")
    grouped = rows.withColumn("group", group_of(F.col("kind"), F.col("channel")))
    every, own = Window.partitionBy(F.lit(0)), Window.partitionBy("group")
    out = grouped
    for name, w in (("", every), ("_in_group", own)):
        o = w.orderBy("idx")
        out = out.withColumn(f"next{name}", F.coalesce(F.lead("idx").over(o), F.min("idx").over(w))).withColumn(f"previous{name}", F.coalesce(F.lag("idx").over(o), F.max("idx").over(w)))
    return out


def groups(spark: SparkSession) -> DataFrame:
    """Each group with its transforms, in the order of the catalogue."""
    return catalogue(spark).groupBy("group").agg(F.min("idx").alias("first_idx"), F.sort_array(F.collect_list("idx")).alias("idxs"))


def random_palette(spark: SparkSession, seed: int, entries: int) -> DataFrame:
    """(pal_idx, argb) of a seeded palette of at most 256 entries: red, green and blue of each are the next three draws of
    a 48-bit linear congruential generator."""
    if not 0 <= entries <= 256:
        raise ValueError("a palette has at most 256 entries")
    state, rows = (seed ^ 0x5DEECE66D) % (1 << 48), []
    for i in range(entries):
        argb = 0xFF
        for _ in range(3):
            state = (state * 0x5DEECE66D + 0xB) % (1 << 48)
            argb = argb << 8 | state >> 40
        rows.append((i, argb))
    return spark.createDataFrame(rows, "pal_idx int, argb long")
