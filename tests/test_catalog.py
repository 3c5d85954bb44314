"""Every registered query against DuckDB, by rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from psephos.plans import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


def same(a, b):
    return (a is None and b is None) or a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, name):
    df = queries()[name](spark, DATA)
    got = df.collect()
    if name not in oracle_sql():
        assert len(got) >= 1
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cursor = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got, "a query that shows nothing cannot show that it is right"
    order = sorted(columns)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall()), key=key)
    have = sorted((tuple(r[c] for c in order) for r in got), key=key)
    assert len(want) == len(have)
    assert all(same(x, y) for a, b in zip(have, want) for x, y in zip(a, b)), next((a, b) for a, b in zip(have, want) if not all(map(same, a, b)))


def test_broken_grids_are_told(spark):
    """The printed grid of the queries breaks both rules, so that equality with SQL does not hold for no rows."""
    assert {r["rule"] for r in queries()["corrections_unreconciled"](spark, DATA).collect()} == {"split", "appointed"}
