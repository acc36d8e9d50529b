"""Every registered query against its SQL, over whole tables, without cross joins."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from corpusmill.checks.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def by_column(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows),
                  key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window.*\n.*Sort.*\n.*SinglePartition", plan)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = by_column(names, cursor.fetchall())
    assert want and by_column(df.columns, map(tuple, df.collect())) == want


def test_every_query_of_the_engine_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["file_id", "hash", "old_hash"]
