"""The library's functions under names for SQL: scalar functions over payloads and table functions over files and bytes.

``register(spark)`` makes them known to a session:

    SELECT sift_entropy(data), sift_notes(data, 'ZIP') FROM payloads
    SELECT f.path, r.* FROM files f, LATERAL sift_structure(f.content) r
    SELECT p.id, l.* FROM payloads p, LATERAL sift_hex_dump(p.data) l
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelsift.operators import payload
from pixelsift.sources import structure


@F.pandas_udf(T.DoubleType())
def entropy(data: pd.Series) -> pd.Series:
    return payload.byte_stats.func(data)["entropy"]


class Structure:
    """Rows of the structure report of one file."""

    def eval(self, content: bytes):
        for seq, row in enumerate(structure.analyse(bytes(content)) if content else []):
            yield (seq, *row)


class HexDump:
    """Lines of sixteen bytes: offset, bytes and printable characters."""

    def eval(self, data: bytes):
        data = bytes(data or b"")
        for at in range(0, len(data), 16):
            part = data[at : at + 16]
            shown = "".join(chr(b) if 32 <= b <= 126 else "." for b in part)
            yield at // 16, f"{at:08x}", part.hex(), shown


def register(spark: SparkSession) -> None:
    spark.udf.register("sift_entropy", entropy)
    spark.udf.register("sift_notes", payload.payload_notes)
    spark.udf.register("sift_stats", payload.byte_stats)
    spark.udtf.register("sift_structure", F.udtf(Structure, returnType="seq int, section_no int, section string, kind string, label string, value string"))
    spark.udtf.register("sift_hex_dump", F.udtf(HexDump, returnType="line_no int, offset string, hex string, shown string"))
