"""Hex dumps as rows: 16 bytes a line, address, hex in two groups, printable characters in two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def printable(data: Column) -> Column:
    """ISO-8859-1 text with a dot for every byte that isn't printable ASCII."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7E]", ".")


def hex_compact(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_spaced(data: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "))


def dump(df: DataFrame, key: str, data: str = "data", with_hex: bool = True) -> DataFrame:
    """(key, line_no, line) for each 16 bytes of a BINARY column; no bytes, no lines."""
    d = F.col(data)
    lines = F.ceil(F.octet_length(d) / 16).cast("int")
    starts = df.where(F.octet_length(d) > 0).select(F.col(key), d.alias("_d"), F.explode(F.sequence(F.lit(0), lines - 1)).alias("line_no"))
    part = starts.select(key, "line_no", F.substring("_d", F.col("line_no") * 16 + 1, F.lit(16)).alias("_p"))
    digits = F.rpad(F.lower(F.hex("_p")), 32, " ")
    text = printable(F.col("_p"))
    address = F.lpad(F.lower(F.hex(F.col("line_no").cast("long") * 16)), 8, "0")
    spaced = F.regexp_replace(text, r"^(?s)(.{8})", "$1 ")
    columns = [address, F.lit("  ")]
    if with_hex:
        columns += [F.substring(digits, 1, 16), F.lit(" "), F.substring(digits, 17, 16), F.lit("  ")]
    return part.select(key, "line_no", F.concat(*columns, spaced).alias("line"))
