"""The SQL of operators against their queries, as the core's test does for the core's queries."""

import glob
import os

import duckdb
import pytest

from textkiln.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in out.description]
    want = [tuple(dict(zip(cols, r, strict=True))[c] for c in sorted(cols)) for r in out.fetchall()]
    assert sorted(cols) == sorted(df.columns) and len(got) > 0
    assert sorted(map(repr, got)) == sorted(map(repr, want))
