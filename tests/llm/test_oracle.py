"""Queries that SQL can express give the same rows in a second engine."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from lexicarta.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, folder, name):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, folder)
    cursor = connection.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(columns).collect())) == Counter(cursor.fetchall())


def test_all_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLE_SQL) <= set(driver.oracle_sql())
