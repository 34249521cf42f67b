"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import trailhead.plans.catalog as catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_equals_oracle(spark, oracle, name):
    df = catalog.queries()[name](spark, DIR)
    found = oracle.execute(catalog.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    columns = sorted(df.columns)
    places = [list(kinds).index(c) for c in columns]
    assert sorted([text(r[c]) for c in columns] for r in df.collect()) == sorted([text(r[i]) for i in places] for r in found.fetchall())


def test_entry():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())
