"""Each query of the library gives the rows that its SQL gives."""

import decimal
import math
import os

import duckdb
import pytest

from viastrata.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    result = duck.execute(ORACLES[name])
    heads = [x[0] for x in result.description]
    assert sorted(heads) == columns
    wanted = sorted((tuple(plain(r[heads.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert len(frame.columns) == len(set(frame.columns))
    frame.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
