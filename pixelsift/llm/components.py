"""Connected components of a graph held as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsift.llm._store import keep


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: (v, comp) for every vertex, comp being the smallest vertex it reaches.

    Each step aggregates before it shuffles and joins on keys whose large partitions Spark can split; the
    edges are written after each step, so the lineage stays short. Nothing is collected but counts.
    """
    now = keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = keep(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        now = keep(small, "edges")
        # done when every vertex points at one root and no root points anywhere
        roots = now.select(F.col("b").alias("a")).distinct()
        n = now.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("v")).first()
        if n.n == n.v and now.join(roots, "a", "left_semi").limit(1).count() == 0:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())
