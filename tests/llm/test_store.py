"""Intermediate tables: files for their size, not for the number of tasks that made them."""

from pyspark.sql import functions as F

from pixelsift.llm import _store, line_dedup


def test_small_steps_write_few_files(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 5000, 1, 3).write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in").repartition(211, "id")
    kept = _store.keep(rows, "few")
    assert len(kept.inputFiles()) <= 2 * cores
    assert kept.agg(F.sum("id"), F.count_distinct("id")).first() == (5000 * 4999 // 2, 5000)


def test_large_or_unknown_steps_keep_their_tasks(spark, tmp_path, monkeypatch):
    spark.range(0, 5000, 1, 3).write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in").repartition(50, "id")
    monkeypatch.setattr(_store, "TASK_BYTES", 1)
    assert _store.fewer(rows).rdd.getNumPartitions() == 50
    monkeypatch.undo()
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(k,) for k in range(100)], 40), "id long")
    assert _store.fewer(unknown).rdd.getNumPartitions() == 40


def test_reports_are_few_files(spark, docs, tmp_path):
    docs(*[(k, f"{k} " * 60) for k in range(50)]).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        line_dedup.report(spark.read.parquet(f"{tmp_path}/docs")).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 50 and len(out.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
