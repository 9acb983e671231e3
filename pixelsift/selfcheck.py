"""A quick check that transforms, extraction, search and files work here; ``python -m pixelsift --self-test``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsift.operators import extract as X
from pixelsift.operators import grids, lsbscan
from pixelsift.sinks import writers
from pixelsift.sources import images, structure

WIDTH, HEIGHT, PERIOD, SEED = 512, 384, 48, 20250101
MESSAGE = b"steg{the check image says hello}"


def check_image() -> np.ndarray:
    """A pattern that repeats every 48 columns, with a message in the lowest bit of red."""
    rng = np.random.default_rng(SEED)
    strip = rng.integers(0, 1 << 24, (HEIGHT, PERIOD)).astype(np.uint32) & np.uint32(0xFEFFFF)
    argb = np.tile(strip, (1, -(-WIDTH // PERIOD)))[:, :WIDTH] | np.uint32(0xFF000000)
    bits = np.unpackbits(np.frombuffer(MESSAGE, np.uint8)).astype(np.uint32)
    flat = argb.ravel()
    flat[: len(bits)] |= bits << np.uint32(16)
    return flat.reshape(HEIGHT, WIDTH)


def run(spark: SparkSession) -> DataFrame:
    """One row per step: step, passed, detail."""
    argb = check_image()
    packed = spark.createDataFrame([("check", WIDTH, HEIGHT, False, argb.astype(">u4").tobytes())], "image_id string, width int, height int, has_alpha boolean, pixels binary")
    steps = []

    def step(name: str, test) -> None:
        try:
            ok, detail = test()
        except Exception as e:  # a step that breaks is a step that failed
            ok, detail = False, str(e)[:200]
        steps.append((name, bool(ok), str(detail)))

    px = images.to_long(packed)
    step("pixels", lambda: ((n := px.count()) == WIDTH * HEIGHT, n))
    step("inversion", lambda: (grids.apply(grids.apply(px, 1), 1).join(px.withColumnRenamed("argb", "b"), ["image_id", "x", "y"]).where("argb != b").count() == 0, "twice is the original"))
    step("period", lambda: ((r := grids.stereo_best_offset(px, 8).first()).offset == PERIOD, r.offset))
    cfg = X.config("R", [0])
    step("extraction", lambda: ((d := bytes(X.assemble(X.extract_bits(px, cfg, max_bytes=len(MESSAGE))).first().data)) == MESSAGE, d))
    step("search", lambda: ((r := lsbscan.scan(packed, configs=[cfg]).where("rank = 1").first()).score == 98, r.reason))
    step("png", lambda: ((images.decode_png(writers.encode_png(argb, False)).argb == argb).all(), "read back"))
    step("structure", lambda: (not [r for r in structure.analyse(writers.encode_png(argb, False)) if r[2] == "warn"], "no warnings"))
    return spark.createDataFrame(steps, "step string, passed boolean, detail string").withColumn("no", F.monotonically_increasing_id())
