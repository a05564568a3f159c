"""Checks for batching, resume, pending work, prefix matching and incremental streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import repo_slug
from ..operators.batching import batch_assign, pending_repos, repo_prefix_match, resume_from_batch
from ..operators.stars import star_counts, top_repos
from ..session import scratch_path
from ..sources.fixtures import changes_view, oracle_ctes, stars_view
from ..streaming.incremental import append_to_table, process_available
from . import register

STARS = oracle_ctes("v_stars")
BOTH = oracle_ctes("v_stars", "v_changes")
BATCH_SIZE = 10
START_BATCH = 3

TOP_BATCH_SQL = f"""{STARS},
top AS (SELECT repo_full_name, count(*) AS stars FROM v_stars GROUP BY repo_full_name ORDER BY stars DESC, repo_full_name LIMIT 150),
b AS (SELECT repo_full_name, CAST(floor((row_number() OVER (ORDER BY stars DESC, repo_full_name) - 1) / {BATCH_SIZE}) AS BIGINT) AS batch_id FROM top)"""


def _top_batches(spark, sf_dir):
    top = top_repos(stars_view(spark, sf_dir), 150)
    return batch_assign(top, BATCH_SIZE, (("stars", False), ("repo_full_name", True))).select("repo_full_name", "batch_id")


@register("batch_assign", f"{TOP_BATCH_SQL}\nSELECT * FROM b")
def batch_assign_q(spark, sf_dir):
    return _top_batches(spark, sf_dir)


@register("batch_assign_all", f"""{STARS}
SELECT repo_full_name, CAST(floor((row_number() OVER (ORDER BY repo_full_name) - 1) / {BATCH_SIZE}) AS BIGINT) AS batch_id
FROM (SELECT DISTINCT repo_full_name FROM v_stars)""")
def batch_assign_all(spark, sf_dir):
    names = stars_view(spark, sf_dir).select("repo_full_name").distinct()
    return batch_assign(names, BATCH_SIZE, (("repo_full_name", True),))


@register("resume_from_batch", f"{TOP_BATCH_SQL}\nSELECT * FROM b WHERE batch_id >= {START_BATCH}")
def resume_from_batch_q(spark, sf_dir):
    return resume_from_batch(_top_batches(spark, sf_dir), START_BATCH)


@register("pending_repos", f"""{BOTH}
SELECT DISTINCT repo_full_name FROM v_stars
WHERE replace(repo_full_name, '/', '_') NOT IN
  (SELECT replace(regexp_extract(repo_url, '([^/]+/[^/]+)$', 1), '/', '_') FROM v_changes)""")
def pending_repos_q(spark, sf_dir):
    wanted = stars_view(spark, sf_dir).select("repo_full_name").distinct()
    return pending_repos(wanted, changes_view(spark, sf_dir).select("repo_url"))


@register("repo_prefix_match", f"""{BOTH},
keys AS (SELECT DISTINCT replace(repo_full_name, '/', '_') AS key FROM v_stars),
entries AS (SELECT DISTINCT replace(regexp_extract(repo_url, '([^/]+/[^/]+)$', 1), '/', '_') || '_' ||
                   CAST(year(commit_time) AS VARCHAR) AS entry FROM v_changes)
SELECT k.key, e.entry FROM keys k JOIN entries e ON starts_with(e.entry, k.key)""")
def repo_prefix_match_q(spark, sf_dir):
    keys = stars_view(spark, sf_dir).select(repo_slug("repo_full_name").alias("key"))
    c = changes_view(spark, sf_dir)
    entries = c.select(F.concat(repo_slug("repo_url"), F.lit("_"), F.year("commit_time").cast("string")).alias("entry"))
    return repo_prefix_match(keys, entries)


@register("incremental_star_counts", f"""{STARS}
SELECT repo_full_name, count(*) AS stars FROM v_stars GROUP BY repo_full_name""")
def incremental_star_counts(spark, sf_dir):
    """Two arrivals of star files (before / from 1998), each processed once by an availableNow stream."""
    stars = stars_view(spark, sf_dir).select("user_id", "repo_full_name", "starred_at")
    src, sink, ckpt = (scratch_path(spark, n) for n in ("stars_src", "stars_sink", "stars_ckpt"))
    schema = "user_id long, repo_full_name string, starred_at timestamp"
    stars.where(F.col("starred_at") < F.lit("1998-01-01").cast("timestamp")).write.parquet(f"{src}/arrival=1")
    process_available(spark, src, schema, ckpt, append_to_table(sink))
    stars.where(F.col("starred_at") >= F.lit("1998-01-01").cast("timestamp")).write.parquet(f"{src}/arrival=2")
    process_available(spark, src, schema, ckpt, append_to_table(sink))
    return star_counts(spark.read.parquet(sink))
