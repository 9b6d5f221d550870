"""Every query with SQL gives what DuckDB gives on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from plumbline.queries import ORACLE_SQL, QUERIES


def plain(v):
    """A value with its type's family, so that whole and floating numbers differ and nulls are nulls in either engine."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0,)
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, (list, tuple)):
        return (6, *map(plain, v))
    if isinstance(v, dict):
        return (7, *((k, plain(x)) for k, x in sorted(v.items())))
    families = ((2, int), (3, float), (4, str), (5, datetime.datetime))
    return next(((n, v) for n, kind in families if isinstance(v, kind)), (8, str(v)))


def rows(table: pa.Table) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in zip(*(table[c].to_pylist() for c in sorted(table.column_names)), strict=True))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    got, want = QUERIES[name](spark, sf_dir).toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
