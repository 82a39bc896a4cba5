"""Every registered query runs, and those with an SQL twin give the same rows as DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans import catalog


def norm(v) -> str:
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(records, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in records)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    got = rows(df.collect(), df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(found.fetchall(), names)
