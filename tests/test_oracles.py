"""Every query with SQL gives DuckDB's rows; the others run and keep their schema."""

from __future__ import annotations

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def one(v):
    """A value as both engines' frames can hold it: whole columns with nulls become floats in one of them."""
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    return float(v) if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else v


def plain(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(map(one, r)) for r in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(name, spark, sf_dir, duck):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(name, spark, sf_dir):
    rows = registry.queries()[name](spark, sf_dir)
    assert rows.columns and rows.count() > 0
