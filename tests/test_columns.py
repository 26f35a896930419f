"""The catalogue against its SQL, on the smallest tables, and rules on columns."""

from __future__ import annotations

from pathlib import Path

import pytest

from citeweld.functions import normal
from citeweld.functions.columns import lifted
from citeweld.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_rules_on_columns(spark):
    df = spark.createDataFrame([("A Title: of (Things) [x].", "b"), ("Łódź — ½ é", None)], "s string, o string")
    got = df.select(lifted(normal.title, "string")(df.s).alias("t"), lifted(normal.author, "struct<a:string,b:string,c:boolean>")(df.s).alias("a"), lifted(lambda x, y: f"{x[:1]}{y}", "string")(df.s, df.o).alias("two")).collect()
    assert [r.t for r in got] == [normal.title("A Title: of (Things) [x]."), normal.title("Łódź — ½ é")] and [r.two for r in got] == ["Ab", "ŁNone"]
    assert tuple(got[0].a) == normal.author("A Title: of (Things) [x].")


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue_agrees_with_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    plain = lambda rows: sorted([repr([str(v) if not isinstance(v, float) else round(v, 6) for v in r]) for r in rows])
    assert plain(tuple(r[c] for c in order) for r in got.collect()) == plain(want.project(", ".join(f'"{c}"' for c in order)).fetchall())
