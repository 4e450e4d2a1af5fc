"""Every query with SQL against DuckDB on the small tables; the others run."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__
from textkiln.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", [k for k in QUERIES if not re.match(r"op\d|pipeline", k)])
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = con.execute(SQL[name])
    cols = [c[0] for c in out.description]
    want = [tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)) for r in out.fetchall()]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["dedup_ledger", "run_log", "run_pipeline", "tee_outputs"])
def test_repeats_far_apart(spark, tmp_path, name):
    """Repeats with over 10,000 other texts, or over 604,800 seconds, between them. The first of a kind isn't cut by
    its command, make all; the repeat's command, git log, cuts."""
    long = ["\n".join(f"{s} {i}" for i in range(300)) for s in ("a", "b")]
    n = len(catalogue.COMMANDS)
    rows = [(n - 1, long[0], "en"), *((i, f"text {i}", "en") for i in range(n, 10_100)), (n * 2_000 + 1, long[0], "en")]
    rows += [(n * 2_001 - 1, long[1], "fr"), (n * 100_000 + 1, long[1], "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = con.execute(SQL[name])
    cols = [c[0] for c in out.description]
    want = out.fetchall()
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, want))
