"""Every query of the catalogue against its SQL in DuckDB, on the small tables."""

import math
from datetime import datetime

import duckdb
import pytest

from marlstone.plans import catalog

DATA = "/root/testdata/sf0.001"
#: Queries that find nothing in so small a table.
EMPTY = {"bm25_kind_filter", "fingerprint_sample_spans"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((str(tuple(plain(r[i]) for i in order)) for r in values))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(catalog.ORACLES[name])
    assert got == rows(rel.columns, rel.fetchall())
    assert got[1] or name in EMPTY


def test_every_query_is_checked():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
