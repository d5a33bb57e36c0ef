"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from riskgrid import plans


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, (bool, str)) or not hasattr(v, "__float__"):
            return str(v)
        return f"{float(v):.6f}"

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    ours, theirs = plans.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_stream_decides_as_the_batch_fold(spark, sf_dir):
    batch, stream = (plans.QUERIES[q](spark, sf_dir).toPandas() for q in ("replan_triggers", "replan_stream"))
    assert len(batch) and rows(batch) == rows(stream)


def test_entry_and_query_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
