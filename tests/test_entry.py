"""The entry points: every SQL twin agrees with its query on the smallest tables."""

import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_own_queries_agree_with_sql(spark):
    import duckdb

    from pixelsift import queries

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    quick = [n for n in queries.oracle_sql() if not n.startswith(("transform_plane", "combine_"))] + ["transform_plane_red_3", "combine_mul_ch"]
    for name in quick:
        got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name

        def shown(v):
            if v is None or pd.isna(v):
                return "-"
            return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

        rows = lambda df: sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
        assert rows(got) == rows(want), name


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
