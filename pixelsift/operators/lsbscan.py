"""Automatic search for hidden payloads: every configuration on every image, classified, ranked.

Images are packed, one row each; the extraction of all configurations runs in one Arrow batch per image and
emits prefixes, bounded unless asked for whole, which are then classified by column expressions like any payload. Duplicates
are found by content. Long images don't shuffle: only what was extracted does, at most :data:`PREFIX` bytes a candidate by default.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelsift.operators import payload
from pixelsift.operators.extract import Config, deep_configs, extract_packed, fast_configs

#: Bytes of a candidate that are looked at.
PREFIX = 64 << 10
#: Candidates in one batch on their way back, at most.
_AT_ONCE = 64


def config_table(spark: SparkSession, configs: list[Config]) -> DataFrame:
    """The configurations as a dimension table, in their order."""
    rows = [(i, c.mask(), c.order, c.lsb_first, c.row_first, c.invert, c.label()) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, "opt_idx int, plane_mask long, rgb_order string, lsb_first boolean, row_first boolean, invert_bits boolean, label string")


def unpack(width: int, height: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(height, width)


def candidates(images: DataFrame, configs: list[Config] | None = None, deep: bool = False, max_bytes: int | None = PREFIX) -> DataFrame:
    """(image_id, opt_idx, data, total_bytes, truncated) for each image and configuration.

    Without ``configs`` each image gets the fast or deep list, longer if it has alpha. With ``max_bytes`` None extracts
    are whole, and leave one by one."""
    at_once = 1 if max_bytes is None else _AT_ONCE

    def run(batches: Iterable[pa.RecordBatch]):
        lists = {a: configs or (deep_configs(a) if deep else fast_configs(a)) for a in (False, True)}
        names = ["image_id", "opt_idx", "data", "total_bytes", "truncated"]
        for batch in batches:
            for i in range(batch.num_rows):
                image, w, h, alpha, data = (batch.column(k)[i].as_py() for k in range(5))
                argb, todo = unpack(w, h, data), lists[bool(alpha)]
                for lo in range(0, len(todo), at_once):
                    got = [extract_packed(argb, c, max_bytes) for c in todo[lo : lo + at_once]]
                    n = len(got)
                    yield pa.RecordBatch.from_arrays([pa.array([image] * n, pa.string()), pa.array(range(lo, lo + n), pa.int32()), pa.array([d for d, _ in got], pa.binary()), pa.array([t for _, t in got], pa.int64()), pa.array([len(d) < t for d, t in got])], names=names)

    rows = images.select("image_id", "width", "height", "has_alpha", "pixels")
    return rows.mapInArrow(run, "image_id string, opt_idx int, data binary, total_bytes long, truncated boolean")


def ranked(found: DataFrame) -> DataFrame:
    """Classify candidates, keep one of each content and rank by score; equal scores by configuration.

    Complete extracts are one if their bytes are; truncated ones also need the same configuration.
    """
    scored = payload.classify(found)
    key = F.concat_ws(":", "sha256", F.col("total_bytes").cast("string"), F.when(F.col("truncated"), F.col("opt_idx").cast("string")))
    same = Window.partitionBy("image_id", "_key").orderBy(F.col("score").desc(), "opt_idx")
    first = Window.partitionBy("image_id", "_key")
    one = scored.withColumn("_key", key).withColumn("_n", F.row_number().over(same)).withColumn("_first", F.min("opt_idx").over(first)).where("_n = 1")
    order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "_first")
    return one.withColumn("rank", F.row_number().over(order)).drop("_key", "_n", "_first")


def scan(images: DataFrame, deep: bool = False, configs: list[Config] | None = None, max_bytes: int | None = PREFIX) -> DataFrame:
    return ranked(candidates(images, configs, deep, max_bytes))


def extract_full(images: DataFrame, cfg: Config) -> DataFrame:
    """The whole extract of one configuration: (image_id, data, total_bytes)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            got = [extract_packed(unpack(w, h, d), cfg) for w, h, d in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in got], pa.binary()), pa.array([t for _, t in got], pa.int64())], names=["image_id", "data", "total_bytes"])

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id string, data binary, total_bytes long")
