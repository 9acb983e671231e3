"""Queries on tables that are larger than one batch, one prefix or one task was made for."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pixelsift import queries
from pixelsift.operators import symbolscan
from pixelsift.plans import carriers


def test_a_search_by_sql_reads_whole_extracts(spark, tmp_path):
    """An extract of more than a prefix's 64 KiB is hashed, counted and classified whole."""
    n = 200_000
    pq.write_table(pa.table({"event_id": np.arange(n), "user_id": np.arange(n) % 977}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = queries.queries()["lsb_scan_few"](spark, str(tmp_path)).collect()
    want = con.execute(queries.oracle_sql()["lsb_scan_few"]).fetchall()
    assert max(r.total_bytes for r in got) > 64 << 10
    assert sorted((r["rank"], r.opt_idx, r.score, r.sha256, r.total_bytes) for r in got) == sorted(want)


def test_pictures_leave_in_small_batches():
    texts = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(60)]), pa.array([f"SUPPLIER-{k:09d}" for k in range(60)])], names=["image_id", "text"])
    made = list(carriers.drawing("CODE_39")([texts]))
    assert len(made) > 1 and max(b.nbytes for b in made) < 2 * carriers._DRAWN
    assert [x for b in made for x in b.column("image_id").to_pylist()] == texts.column(0).to_pylist()
    assert sum(b.num_rows for b in symbolscan.hits(made)) == 60


@pytest.mark.parametrize("name", ["bars_ean_13", "bars_ean_8", "bars_upc_a", "bars_itf", "bars_codabar", "bars_code_39"])
def test_bars_are_drawn_and_read_in_many_tasks(spark, tmp_path, name):
    """One small file of suppliers doesn't leave all its pictures to one task, and none of them passes through the JVM."""
    pq.write_table(pa.table({"s_suppkey": np.arange(300), "s_name": [f"Supplier#{k:09d}" for k in range(300)], "s_nationkey": pa.array(np.arange(300) % 25, pa.int32())}), tmp_path / "supplier.parquet")
    df = queries.queries()[name](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert df.count() == 300


@pytest.mark.parametrize("kind", ["EAN_8", "ITF", "UPC_A"])
def test_bars_cost_one_row_and_leave_together(monkeypatch, kind):
    """Of rows that equal their neighbours one is worked out, no column of such a picture is searched, and hits share a batch."""
    looked = []
    luminance = symbolscan.luminance
    monkeypatch.setattr(symbolscan, "luminance", lambda argb: looked.append(len(argb)) or luminance(argb))
    texts = [f"{k:0{ {'EAN_8': 7, 'ITF': 8, 'UPC_A': 11}[kind] }d}" for k in range(100)]
    rows = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(100)]), pa.array(texts)], names=["image_id", "text"])
    (found,) = symbolscan.hits(carriers.drawing(kind)([rows]))
    assert looked == [1] * 100
    assert [t[: len(s)] for t, s in zip(found.column("text").to_pylist(), texts)] == texts
