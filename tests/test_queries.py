"""Every registered query of the library against its SQL in DuckDB, on the same Parquet tables."""

import math
import os

import duckdb
import pytest

from platewise.plans import event_log, extended, further, imports, packaging, press, registry, streams  # noqa: F401


#: Queries without SQL; tests/test_rules.py holds them against brute force.
WITHOUT_SQL = {"a16_u2_replay_score"}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.QUERIES) - set(registry.ORACLES) == WITHOUT_SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(f"SELECT * FROM ({registry.ORACLES[name]})")
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
