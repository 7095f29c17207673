"""Queries that SQL can express give what DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from pitchfold.llm import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name, sf):
    where = f"/root/testdata/{sf}"
    got = queries.QUERIES[name](spark, where)
    columns = sorted(got.columns)
    with duckdb.connect() as con:
        for t in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet')")
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(expected, key=repr)
