"""From documents to token ids: five stages, each calling one operator of ``pixelsift.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. Between stages the rows are written as Parquet in the shared folder and read again.

Every stage takes an empty table (it gives an empty one), null ids and texts, texts of any length, repeated
rows and columns of any name; what becomes of them is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsift.llm import byte_bpe, jaccard_join, line_dedup, mixing, toxicity
from pixelsift.llm._store import keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled rows of ``docs``, rejects go.

    Null, empty and blank texts and, without labels of both kinds, all documents stay; of a long text every
    window is looked at; repeated rows are judged alike; all columns are carried."""
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of lines are cut out, and documents that lose all their words go with
    them: their whole text stands elsewhere. n_chars follows the text.

    Null texts and texts without words stay as they are; null ids come before all others; rows that agree in id
    and text are one document, so none of them is cut for another; all other columns are carried."""
    left = line_dedup.delete_repeated_runs(docs, drop_emptied=True)
    return left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType)) if "n_chars" in left.columns else left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that with the smallest id.

    Texts without words are linked with nothing and stay; a null id loses against any other; of rows that agree
    in id and text one stays; all columns are carried."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is emitted as often as its source's target asks for.

    A null source is a source; documents of sources without words aren't emitted (their target is 0); rows that
    agree in id, source and text share their draw; all columns are carried."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to.

    A null text is the empty one; all columns but the text are carried, except those named like a new column."""
    import public_tokenizers

    kept = [c for c in docs.columns if c != "text"]
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=kept, with_decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The first stage's model and the fifth's tokens can't be written in SQL; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
