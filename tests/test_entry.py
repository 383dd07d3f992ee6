"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from tidewater import queries as core  # noqa: E402

SMALL = entry.SMALL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as from '{SMALL}/{t}.parquet'")
    want = db.sql(core.oracle_sql()[name])
    got = core.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SMALL)
