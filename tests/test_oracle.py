"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from conftest import TABLES
from panelkit.queries import ORACLES, QUERIES

DUCK_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _sort_key(row):
    return tuple((v is None, str(v)) for v in row)


def _plain(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf_dir, duck, key):
    df = QUERIES[key](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=_sort_key)
    spark.catalog.clearCache()
    if key not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[key])
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    assert sorted(names) == cols
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=_sort_key)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
