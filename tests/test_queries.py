"""Every registered frame query against its DuckDB twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from nightloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return repr(float(v)) if hasattr(v, "as_tuple") else repr(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) & set(catalogue.ORACLE)))
def test_same_as_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert rows and all(v is not None for v in rows[0][:2])
