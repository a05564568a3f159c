"""Checks for the user-function surface."""

from __future__ import annotations


from ..operators.apply import apply_isolated, apply_per_repo, apply_status, cogroup_apply, map_rows
from ..sources.fixtures import changes_view, oracle_ctes
from ..sources.tables import load_table
from . import register

CH = oracle_ctes("v_changes")
def grid_cell(width, origin, value):
    """Number of the cell of ``width`` that a value falls into, counted from ``origin``."""
    return (value - origin) // width


@register("map_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((l_partkey - 3) / 10.0) AS BIGINT) AS cell FROM lineitem""")
def map_rows_q(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return map_rows(li, grid_cell, "l_partkey", "cell", "long", width=10, origin=3, value=None)


def change_summary(repo_url, frames):
    n = deleted = 0
    for pdf in frames:
        n += len(pdf)
        deleted += int(pdf["new_blob_id"].isna().sum())
    yield {"repo_url": repo_url, "n_changes": n, "n_deleted": deleted}


@register("apply_per_repo", f"""{CH}
SELECT repo_url, count(*) AS n_changes, count(*) - count(new_blob_id) AS n_deleted FROM v_changes GROUP BY repo_url""")
def apply_per_repo_q(spark, sf_dir):
    c = changes_view(spark, sf_dir).select("repo_url", "new_blob_id")
    return apply_per_repo(c, change_summary, "repo_url string, n_changes long, n_deleted long")


def two_records(repo_url, frames):
    """The number of changes, then of deletions; a repository that deleted a ``.bin`` file fails in between."""
    n = deleted = 0
    bad = False
    for pdf in frames:
        gone = pdf["new_blob_id"].isna()
        n, deleted = n + len(pdf), deleted + int(gone.sum())
        bad |= bool((gone & pdf["file_path"].str.endswith("src/d3/f39.bin")).any())
    yield {"repo_url": repo_url, "what": "changes", "n": n}
    if bad:
        raise ValueError(f"a binary file is gone from {repo_url}")
    yield {"repo_url": repo_url, "what": "deletions", "n": deleted}


ISOLATED_SQL = f"""{CH},
r AS (SELECT repo_url, count(*) AS n, count(*) - count(new_blob_id) AS d,
             count(*) FILTER (new_blob_id IS NULL AND file_path LIKE '%src/d3/f39.bin') > 0 AS bad FROM v_changes GROUP BY repo_url)"""


@register("apply_status", f"""{ISOLATED_SQL}
SELECT repo_url, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN bad THEN 'ValueError: a binary file is gone from ' || repo_url END AS error, CASE WHEN bad THEN 1 ELSE 2 END::BIGINT AS n_rows FROM r""")
def apply_status_q(spark, sf_dir):
    c = changes_view(spark, sf_dir).select("repo_url", "file_path", "new_blob_id")
    return apply_status(c, two_records)


@register("apply_isolated_records", f"""{ISOLATED_SQL}
SELECT repo_url, 'changes' AS what, n FROM r UNION ALL SELECT repo_url, 'deletions' AS what, d AS n FROM r WHERE NOT bad""")
def apply_isolated_records(spark, sf_dir):
    """A repository that fails halfway keeps the record it gave before."""
    c = changes_view(spark, sf_dir).select("repo_url", "file_path", "new_blob_id")
    return apply_isolated(c, two_records, "repo_url string, what string, n bigint")[0]


def changes_and_paths(left, right):
    import pandas as pd
    key = left["repo_url"].iloc[0] if len(left) else right["repo_url"].iloc[0]
    return pd.DataFrame([{"repo_url": key, "n_changes": len(left), "n_paths": int(right["file_path"].nunique())}])


@register("cogroup_apply", f"""{CH}
SELECT repo_url, count(*) AS n_changes, count(DISTINCT file_path) AS n_paths FROM v_changes GROUP BY repo_url""")
def cogroup_apply_q(spark, sf_dir):
    c = changes_view(spark, sf_dir)
    paths = c.select("repo_url", "file_path").distinct()
    return cogroup_apply(c.select("repo_url", "commit_id"), paths, changes_and_paths,
                         "repo_url string, n_changes long, n_paths long")
