"""Every registered query equals its DuckDB oracle on the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

from .conftest import SF_SMALL  # noqa: E402

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got_cols, "query without oracle must still produce a schema"
        return
    res = con.execute(ORACLES[name])
    want, want_cols = rows_of([d[0] for d in res.description], res.fetchall())
    assert got_cols == want_cols
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["repo_url", "author_name", "author_email", "commit_id", "programming_language",
                          "file_path", "blob_id", "added_lines_num", "deleted_lines_num"]
