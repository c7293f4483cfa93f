"""Every registered query against its SQL on DuckDB, over the small tables."""

import os
from decimal import Decimal
from glob import glob

import duckdb
import pytest
from evidex.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def oracle(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return f"{v:.9g}" if isinstance(v, (float, Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    got = [r.asDict() for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        cursor = oracle.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        want = [dict(zip(columns, r)) for r in cursor.fetchall()]
        order = sorted(columns)
        assert sorted([plain(r[c]) for c in order] for r in got) == sorted([plain(r[c]) for c in order] for r in want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
