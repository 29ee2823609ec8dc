"""Every query of the catalogue against its DuckDB twin."""

import math

import duckdb
import pytest

from graphloom.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    # a nullable integer column is one of floats in pandas
    shown = lambda v: str(v) if not isinstance(v, float) or math.isnan(v) else f"{v:.6g}" if v % 1 or abs(v) > 1e15 else str(int(v))
    return sorted(tuple(map(shown, r)) for r in plain.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    got, expected = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
