"""Registered corpus queries: with their SQL where there is one, complete for every table."""

import duckdb
import pytest

from gleanery.llm import queries as Q
from gleanery.session import TABLES


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, duck, name):
    df = Q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    cursor = duck.execute(Q.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in place) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_every_document(spark, sf, name):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in Q.queries()[name](spark, sf).collect()} == ids


def test_names():
    assert [int(n[2:].split("_")[0]) for n in Q.queries()] == list(range(1, 11))
