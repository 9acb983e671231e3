"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelsift.llm import byte_bpe, exact_dedup, jaccard_join, line_dedup, maxent_lm, media, mixing, sharding, toxicity, warc
from pixelsift.llm._store import shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 40, map_path=shared_path(spark, "slotmap"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = shared_path(spark, "warc"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write_archive(pages, path)
    return warc.captures(spark, path, pages.schema["page_id"].dataType.simpleString())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.with_media(_documents(spark, sf_dir)))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_warc, op3_line_dedup, op4_byte_bpe, op5_maxent_lm, op6_mixing, op7_media, op8_jaccard_join, op9_toxicity, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
