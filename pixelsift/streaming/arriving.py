"""Files and symbol parts that arrive over time, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelsift.sources.structure import report

_FILE = "path string, modificationTime timestamp, length long, content binary"

#: Parts of one sequence that are remembered, at most; the newest stay.
RETAINED = 256


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", per_trigger).load(folder)


def arriving_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Structure reports of files as they arrive."""
    return report(arriving_files(spark, folder))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``handle`` on every micro-batch, such as a scan that appends its ranking to a table."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected_parts(parts: DataFrame) -> DataFrame:
    """Complete sequences from a stream of (append_parity, append_total, append_index, payload).

    State is one small map per sequence: an index seen twice with other content spoils the sequence, which is then
    never emitted; a complete sequence is emitted once.
    """
    out = "append_parity int, append_total int, payload binary"
    state = "indexes array<int>, payloads array<binary>, spoilt boolean, done boolean"

    def update(key: tuple, frames, held: GroupState):
        indexes, payloads, spoilt, done = held.get if held.exists else ([], [], False, False)
        have = dict(zip(indexes, payloads, strict=True))
        for frame in frames:
            for i, data in zip(frame["append_index"], frame["payload"], strict=True):
                spoilt = spoilt or (i in have and bytes(have[i]) != bytes(data)) or not 0 <= i < key[1]
                have.setdefault(int(i), bytes(data))
        have = dict(list(have.items())[-RETAINED:])
        ready = not spoilt and not done and len(have) == key[1]
        held.update((list(have), list(have.values()), bool(spoilt), bool(done or ready)))
        if ready:
            yield pd.DataFrame({"append_parity": [key[0]], "append_total": [key[1]], "payload": [b"".join(have[i] for i in sorted(have))]})

    return parts.groupBy("append_parity", "append_total").applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout)
