"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

from fathomdex.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = catalog.queries()[name](spark, SF)
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    spell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(spell(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(spell(r[k]) for k in at) for r in rel.fetchall())
