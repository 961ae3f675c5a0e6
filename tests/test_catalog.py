"""Every query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quiverlake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "embeddings events"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


def test_only_the_fitted_recall_has_no_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"refined_recall"}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_of_the_refined_search(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    rows = catalog.refined_recall(spark, sf).collect()
    assert rows and sum(r.recall for r in rows) / len(rows) >= 0.9 and min(r.recall for r in rows) >= 0.8


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
