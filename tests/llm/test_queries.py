"""The registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from citeweld.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = db.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    plain = lambda rows: sorted(repr([str(v) for v in r]) for r in rows)
    assert plain(tuple(r[c] for c in order) for r in got.collect()) == plain(want.project(", ".join(f'"{c}"' for c in order)).fetchall())


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
