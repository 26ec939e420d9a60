"""Every registered query against its SQL, on the smallest test tables where they exist."""

from __future__ import annotations

import collections
import glob
import os

import pytest

from veriledger import dossier_queries, queries  # noqa: F401  they enter their queries
from veriledger.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def _bag(rows, names):
    def plain(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    relation = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert _bag([tuple(r) for r in frame.collect()], frame.columns) == _bag(relation.fetchall(), relation.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
