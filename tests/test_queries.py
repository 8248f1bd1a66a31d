"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = {"louvain_plain", "shortest_path_joins", "cell_polygons_json", "union_images", "cell_gene_counts"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    names = sorted(a.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
    for c in names:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


OWN = sorted(n for n in entry._own.QUERIES if n not in SLOW)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        _same(got, duck.sql(sql).df())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names_of_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())
