"""Mixing sources to target weights.

Words are aggregated per source; targets give each source's repetition rate; every document is emitted
floor(rate) times, plus one copy drawn by a hash-seeded Bernoulli trial whose probability is the fraction.

The seed of each source's trials is chosen among :data:`SEEDS` fixed ones as the one whose total comes
nearest the target. All candidates are summed in one aggregation with map-side combine, so a source that
holds a third of all rows costs one row per task.

Targets: sources in order of their code points, null last, weigh 1, 2, 3, 1, 2, 3 ... and share all words;
a target stops at 3 times its source's size and the excess is reshared by weight until none is above, by
aggregations over the sources whose result is one row. Sources may be many (hosts): their places in the order come
from a distributed sort and the counts of its partitions, without a window over all sources, and their rates
reach the documents by a broadcast up to :data:`SMALL` sources, by a join that Spark can split beyond.

Words are counted once; the rows that move besides are narrow.

Defined results: null text has size 0; a null source is a source of its own; null ids and rows that agree in id,
source and text (these share their draw) are rows like others; sources without words have target 0 and rate 0, so
none of their documents is taken; a text of any length is one size; an empty table gives an empty table; extra
columns are ignored by :func:`mix_plan` and carried by :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsift.llm._store import keep

SEEDS = 32
MOST = 3
#: Sources that are broadcast, at most.
SMALL = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: the tokens that white space leaves, counted without building them."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def weighed(per_source: DataFrame) -> DataFrame:
    """(source, source_size, weight): 1, 2, 3, 1, ... in order of the sources, null last."""
    spark = per_source.sparkSession
    ordered = keep(per_source.select("source", "source_size").orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id()), "sources")
    parts = ordered.groupBy(F.shiftright("_m", 33).cast("int").alias("_p")).count().orderBy("_p").collect()  # a row for each partition of the sort
    at, offsets = 0, []
    for r in parts:
        offsets.append((r._p, at))
        at += r["count"]
    start = F.broadcast(spark.createDataFrame(offsets, "_p int, _at long"))
    rank = F.col("_at") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("_p", F.shiftright("_m", 33).cast("int")).join(start, "_p").select("source", "source_size", (F.pmod(rank, F.lit(3)) + 1).cast("double").alias("weight"))


def targets(per_source: DataFrame) -> DataFrame:
    """From (source, source_size): target and rate of each source."""
    table = keep(weighed(per_source), "weights")
    most = F.col("source_size") * float(MOST)
    whole = table.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    level, capped = (whole.s or 0) / (whole.w or 1.0), -1
    while True:  # a level only rises, and with it the number of sources that are at their most
        over = most < F.lit(level) * F.col("weight")
        got = table.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most)).alias("s"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if got.n == capped or not got.w:
            break
        level, capped = (whole.s - (got.s or 0.0)) / got.w, got.n
    target = F.least(most, F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0).alias("rate"))


def _draw(seed: Column, frac: Column) -> Column:
    return (F.pmod(F.xxhash64("_id", "_crc", seed), F.lit(1 << 30)) / F.lit(float(1 << 30)) < frac).cast("int")


def _beside(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with what ``plan`` holds for their ``source``."""
    named = plan.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _narrow(id_col: str, text_col: str, source_col: str) -> list:
    return [F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("_crc")]


def _copies() -> Column:
    base = F.floor("rate")
    return (base + _draw(F.col("_seed"), F.col("rate") - base)).cast("long")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """Narrow rows (_id, source, _crc, size); per source its size, target, rate and seed; whether the sources are few."""
    rows = keep(docs.select(*_narrow(id_col, text_col, source_col), word_count(F.col(text_col)).alias("size")), "mix")
    rates = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "rates")
    few = rates.count() <= SMALL
    base = F.floor("rate")
    tried = _beside(rows, rates, few).groupBy("source").agg(*[F.sum(F.col("size") * (base + _draw(F.lit(k), F.col("rate") - base))).alias(f"_t{k}") for k in range(SEEDS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_t{k}") - F.col("target")).alias("d"), F.lit(k).alias("k")) for k in range(SEEDS)]))["k"]
    return rows, keep(_beside(tried, rates, few).select("source", "source_size", "target", "rate", best.alias("_seed")), "seeds"), few


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source, source_size, target (its source's), copies and taken (size * copies)."""
    rows, plan, few = _planned(docs, id_col, text_col, source_col)
    joined = _beside(rows, plan, few).withColumn("copies", _copies())
    return joined.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as the plan says."""
    _, plan, few = _planned(docs, id_col, text_col, source_col)
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), *_narrow(id_col, text_col, source_col))
    return (
        _beside(rows, plan.select("source", "rate", "_seed"), few).withColumn("copies", _copies()).where("copies > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
        .select(*[F.col("_row").getField(c).alias(c) for c in cols])
    )
