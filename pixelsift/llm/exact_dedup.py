"""Exact duplicates: group by a 128-bit content hash, keep the smallest id, compare bytes inside the groups.

Two texts are equal when they agree after every run of white space ``[\\x20\\x09-\\x0D]+`` has become one
space. A null text counts as the empty text.

Plan: one aggregation keyed by (MD5, normalised text). Its hash table compares the bytes of the key, so
texts that merely share an MD5 never meet; its map-side half sends each distinct text once per task, so a
group of copies of any size costs one row per task. Ids then find their group by (MD5, SHA-256) over narrow
rows, in a join whose large partitions Spark can split.

Defined results: null ids lose against any id and a group of null ids only has a null ``keep_id``; rows that
agree in id and text are reported alike (all of them ``kept`` if theirs is the smallest id), while
:func:`deduplicate` returns one of them; an empty table gives an empty table; columns other than the id and
the text are ignored by :func:`duplicate_groups` and carried by :func:`deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    keyed = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm")).withColumn("_md5", F.md5("_norm"))
    groups = (
        keyed.groupBy("_md5", "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_md5", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = keyed.select("_id", "_md5", F.sha2("_norm", 256).alias("text_sha256"))
    return rows.join(groups, ["_md5", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    # the surviving row is found by a per-group minimum, so only narrow rows are grouped
    keep = duplicate_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("keep"), "text_sha256").distinct()
    sha = "__text_sha256__"
    marked = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    kept = marked.join(keep, marked[id_col].eqNullSafe(keep["keep"]) & (marked[sha] == keep["text_sha256"]), "left_semi")
    # repeated rows (same id, same text) are left: one of each
    return kept.dropDuplicates([id_col, sha]).drop(sha)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
