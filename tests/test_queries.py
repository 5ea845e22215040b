"""Every query with SQL gives the same rows as the SQL."""

import math

import duckdb
import pytest

from gleanery.plans import all_queries
from gleanery.session import TABLES

SHOWN = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


#: Queries that find nothing in the smallest tables.
EMPTY = ("evidence_pack",)


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(all_queries.SQL))
def test_sql(spark, sf, duck, name):
    df = all_queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = duck.execute(all_queries.SQL[name])
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    place = [list(kinds).index(c) for c in columns]
    want = sorted(tuple(shown(r[i]) for i in place) for r in cursor.fetchall())
    assert sorted(kinds) == columns
    assert {c: SHOWN[df.schema[c].dataType.simpleString()] for c in columns} == kinds
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want
    assert want or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.SQL)))
def test_rows(spark, sf, name):
    assert all_queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
