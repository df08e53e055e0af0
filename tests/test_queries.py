"""Every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lorekeep import catalog, catalog_extra, catalog_index, catalog_more  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    found = con.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([plain(r[c]) for c in columns]) for r in rows) == sorted(str([plain(x) for x in r]) for r in found.fetchall())
