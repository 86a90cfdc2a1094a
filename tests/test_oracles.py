"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(frame, cols):
    def cell(v):
        if v is None or v != v:
            return None
        return repr(float(v)) if isinstance(v, float) else str(v).removesuffix(".0") if not hasattr(v, "year") else str(v)[:26].removesuffix(" 00:00:00")

    return sorted((tuple(cell(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_give_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert os.path.isdir("/root/testdata/sf0.001")
    assert __spark_entry__.entry(spark).count() > 0
