"""Repeated runs of lines: winnowing over line hashes, joined positions, matches extended both ways.

A line's identity is its words, one space between them; blank lines have none. A run is a series of
consecutive non-blank lines. A line is deleted if it belongs to a run of at least :data:`LEAST_WORDS` words
that already occurred at a smaller place (document id, then line). A run may overlap its earlier occurrence: of one line many times in a row the first stays.

Plan, in DataFrame functions only:

1. Lines are hashed. From every line the shortest window of lines that holds :data:`LEAST_WORDS` words is
   taken, forwards and backwards. Any run worth deleting is a union of such windows.
2. Winnowing: each window's fingerprint is its smallest line hash, at that line's position. Two equal
   windows have the same fingerprint, so a repeat can't be missed. Fingerprints seen at one position only
   are dropped, and with them the windows of all text that isn't repeated.
3. The positions left are joined on the 128-bit digest of the window's lines: the smallest place of each
   window is found by aggregation (one row per task and window, however often it occurs), and windows
   at any other place are repeats.
4. Extension both ways: overlapping and adjoining repeats of a document merge to maximal runs, which are
   cut out of its text.

Only hashes and positions are shuffled until the last join, which brings the runs to their documents.
Joins are on keys that may be hot (a very common line), so they are salted: a key's rows are dealt over
:data:`SALTS` tasks, beside copies of its one row of the other side. No group of a fingerprint or window is ever
gathered.

Defined results: null texts stay null and empty ones empty; null ids come before all others; rows that agree in
id and text are one document and get the same result; texts of one id that differ are ordered by their hash;
an emptied document stays, with an empty text, unless ``drop_emptied``; texts of any length are taken whole; an empty
table gives an empty table; other columns are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelsift.llm._store import fewer, keep, release
from pixelsift.llm.mixing import word_count

#: A repeated run of fewer words stays.
LEAST_WORDS = 50
#: Tasks that the rows of one fingerprint or window are dealt over.
SALTS = 16


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Windows of lines: _id, _th, first and last line, fingerprint with its place, and the digest of their lines."""
    text = F.col(text_col)
    # white space inside lines is squeezed once, before the text is cut
    squeezed = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")
    raw = docs.select(F.col(id_col).alias("_id"), _key(text).alias("_th"), F.posexplode(F.split(squeezed, "\n")).alias("_pos", "_line"))
    lines = raw.select("_id", "_th", "_pos", F.trim("_line").alias("_line")).where("_line != ''")
    words = F.length("_line") - F.length(F.replace("_line", F.lit(" "), F.lit(""))) + 1
    lines = lines.select("_id", "_th", "_pos", F.xxhash64("_line").alias("_lh"), F.unhex(F.md5("_line")).alias("_ld"), words.cast("long").alias("_words")).distinct()
    doc = Window.partitionBy("_id", "_th")
    lines = lines.withColumn("_sum", F.sum("_words").over(doc.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.col("_sum") - F.col("_words"))
    ahead = doc.orderBy("_before").rangeBetween(0, least - 1)
    back = doc.orderBy("_sum").rangeBetween(1 - least, 0)
    mark = F.struct("_lh", "_pos")
    both = lines.select(
        "_id", "_th",
        F.struct(F.col("_pos").alias("a"), F.max("_pos").over(ahead).alias("z"), F.sum("_words").over(ahead).alias("n"), F.min(mark).over(ahead).alias("fp"), F.collect_list("_ld").over(ahead).alias("d")).alias("_f"),
        F.struct(F.min("_pos").over(back).alias("a"), F.col("_pos").alias("z"), F.sum("_words").over(back).alias("n"), F.min(mark).over(back).alias("fp"), F.collect_list("_ld").over(back).alias("d")).alias("_b"),
    )
    each = both.select("_id", "_th", F.explode(F.array("_f", "_b")).alias("w")).where(F.col("w.n") >= least)
    return each.select(
        "_id", "_th", F.col("w.a").alias("a"), F.col("w.z").alias("z"), F.col("w.fp._lh").alias("fp"), F.xxhash64("_id", "_th", "w.fp._pos").alias("at"),
        F.unhex(F.md5(F.concat_ws("", F.transform("w.d", lambda x: F.hex(x))).cast("binary"))).alias("dg"),
    )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Per document with repeats: _id, _th and ``runs``, an array of (a, z), the first and last line of each."""
    every = keep(windows(docs, id_col, text_col, least), "windows")
    again = every.groupBy("fp").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi")).where("_lo != _hi").select("fp")
    salt = F.pmod(F.xxhash64("_id", "_th", "a"), F.lit(SALTS)).cast("int").alias("_salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    left = keep(every.select("*", salt).join(again.select("fp", salts), ["fp", "_salt"], "left_semi").select("_id", "_th", "a", "z", "dg"), "candidates")
    place = F.struct("_id", "_th", "a")
    first = left.groupBy("dg").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first != _last").select("dg", "_first")
    repeats = left.select("*", salt).join(keep(first, "firsts").select("dg", "_first", salts), ["dg", "_salt"]).where(place != F.col("_first")).select("_id", "_th", "a", "z").distinct()
    by = Window.partitionBy("_id", "_th").orderBy("a", "z")
    reach = F.max("z").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = repeats.withColumn("_new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("_id", "_th", "_run").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    return runs.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("runs"))


def delete_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, drop_emptied: bool = False) -> DataFrame:
    """``docs`` without the later occurrences of repeated runs; all columns are kept. With ``drop_emptied``,
    documents that lose all their words go; those that had none before stay."""
    # texts are dealt by their key at any size, so a larger corpus costs no more for each of its bytes
    runs = keep(repeated_runs(docs, id_col, text_col, least), "runs")
    release(docs.sparkSession)
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(id_col).alias("_i"), _key(F.col(text_col)).alias("_t"))
    joined = rows.join(runs.hint("merge"), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left")
    text = F.col("_row").getField(text_col)
    cut = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.exists("runs", lambda r: (i >= r["a"]) & (i <= r["z"]))), "\n")
    if drop_emptied:
        joined = joined.where(F.col("runs").isNull() | cut.rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*[(F.when(F.col("runs").isNull(), text).otherwise(cut) if c == text_col else F.col("_row").getField(c)).alias(c) for c in cols])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words left, and the SHA-256 of the text that is left."""
    left = delete_repeated_runs(docs.select(id_col, text_col), id_col, text_col)
    return fewer(left).select(F.col(id_col), word_count(F.col(text_col)).alias("kept_words"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
s AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM n),
b AS (SELECT *, upto - words AS before FROM s),
w AS (
  SELECT doc_id, pos AS a, max(pos) OVER f AS z, sum(words) OVER f AS total, list(norm) OVER f AS content FROM b
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER f AS a, pos AS z, sum(words) OVER f AS total, list(norm) OVER f AS content FROM b
  WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT doc_id, a, z FROM w WHERE total >= 50 QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, a, z) > 1),
k AS (SELECT doc_id, pos, line FROM raw WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = raw.doc_id AND raw.pos BETWEEN r.a AND r.z)),
t AS (SELECT d.doc_id, coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM k WHERE k.doc_id = d.doc_id), '') AS text FROM documents d)
SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS kept_words, sha256(text) AS text_sha256 FROM t
"""
