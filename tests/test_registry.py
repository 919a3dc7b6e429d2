"""Every registered query of the library against its SQL on the smallest tables."""

import os

import pytest

from attesta.plans import ORACLE_SQL, QUERIES
from attesta.plans.adapters import TABLES

DATA = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([rounded(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([rounded(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_names_match():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_nothing_runs_python(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    for name in ("latent_traits", "noise_ocr", "noise_phonetic", "coverage_nway", "address_decode", "attribute_drift"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
