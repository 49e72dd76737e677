"""Every registered query of the library against its SQL twin in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from colsieve.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, records):
    """Rows as sortable text, columns by name; NaN as null."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    theirs = duck.sql(catalogue.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    got = rows(ours.columns, [tuple(r) for r in ours.collect()])
    assert got == rows(theirs.columns, theirs.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
