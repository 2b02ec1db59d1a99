"""Every query against its SQL in DuckDB, over the smallest driver tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as driver
from idiomill.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A cell as both engines give it: nulls alike, whole numbers as integers, others rounded."""
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 9)
    return v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = driver.queries()[name](spark, sf_dir)
    frame = got.toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows_of(frame) == rows_of(want)


def test_entry(spark):
    got = driver.entry(spark)
    assert got.columns == ["idiom", "doc_count"]
    assert got.count() > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
