"""Checks for star-list sources/sinks, counts, ranking and co-starred repositories."""

from __future__ import annotations


from ..operators.stars import cap_stars_per_user, co_starred_repos, star_counts, top_repos
from ..session import scratch_path
from ..sources.fixtures import FIXTURE_STAR_ORDER, oracle_ctes, stars_view
from ..sources.star_list import read_star_list, write_star_list
from . import register

STAR_CTE = oracle_ctes("v_stars")
# parity with the reference's loop bounds (index > limit): 1000 -> 1001 users, 300 -> 301 stars
MAX_USERS = 1001
MAX_STARS = 301
STARS_PER_USER_CAP = 10


@register("star_list_write", f"""{STAR_CTE}
SELECT repo_full_name FROM v_stars""")
def star_list_write(spark, sf_dir):
    path = scratch_path(spark, "star_list")
    write_star_list(stars_view(spark, sf_dir), path)
    return read_star_list(spark, path).select("repo_full_name")


@register("star_list_scan", f"""{STAR_CTE}
SELECT repo_full_name, count(*) AS stars FROM v_stars WHERE repo_full_name <> '' GROUP BY repo_full_name""")
def star_list_scan(spark, sf_dir):
    path = scratch_path(spark, "star_list")
    write_star_list(stars_view(spark, sf_dir), path)
    return star_counts(read_star_list(spark, path))


@register("repo_star_counts", f"""{STAR_CTE}
SELECT repo_full_name, count(*) AS stars FROM v_stars GROUP BY repo_full_name""")
def repo_star_counts(spark, sf_dir):
    return star_counts(stars_view(spark, sf_dir))


@register("top_repos", f"""{STAR_CTE}
SELECT repo_full_name, count(*) AS stars FROM v_stars GROUP BY repo_full_name
ORDER BY stars DESC, repo_full_name LIMIT 150""")
def top_repos_q(spark, sf_dir):
    return top_repos(stars_view(spark, sf_dir), 150)


@register("stars_capped_per_user", f"""{STAR_CTE}
SELECT user_id, repo_full_name, k1, k2, k3, k4 FROM v_stars
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY starred_at DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) <= {STARS_PER_USER_CAP}""")
def stars_capped_per_user(spark, sf_dir):
    capped = cap_stars_per_user(stars_view(spark, sf_dir), STARS_PER_USER_CAP, FIXTURE_STAR_ORDER)
    return capped.select("user_id", "repo_full_name", "k1", "k2", "k3", "k4")


@register("co_starred_repos", f"""{STAR_CTE},
seed AS (SELECT repo_full_name FROM v_stars GROUP BY repo_full_name ORDER BY count(*) DESC, repo_full_name LIMIT 1),
users AS (
  SELECT user_id FROM v_stars WHERE repo_full_name IN (SELECT repo_full_name FROM seed)
  GROUP BY user_id
  ORDER BY min(struct_pack(a := starred_at, b := k1, c := k2, d := k3, e := k4)), user_id
  LIMIT {MAX_USERS})
SELECT user_id, repo_full_name, k1, k2, k3, k4 FROM v_stars
WHERE user_id IN (SELECT user_id FROM users)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY starred_at DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) <= {MAX_STARS}""")
def co_starred(spark, sf_dir):
    stars = stars_view(spark, sf_dir)
    seed = top_repos(stars, 1).select("repo_full_name")
    out = co_starred_repos(stars, seed, MAX_USERS, MAX_STARS, FIXTURE_STAR_ORDER)
    return out.select("user_id", "repo_full_name", "k1", "k2", "k3", "k4")


@register("co_starred_top_repos", f"""{STAR_CTE},
seed AS (SELECT repo_full_name FROM v_stars GROUP BY repo_full_name ORDER BY count(*) DESC, repo_full_name LIMIT 1),
users AS (
  SELECT user_id FROM v_stars WHERE repo_full_name IN (SELECT repo_full_name FROM seed)
  GROUP BY user_id
  ORDER BY min(struct_pack(a := starred_at, b := k1, c := k2, d := k3, e := k4)), user_id
  LIMIT {MAX_USERS}),
picked AS (SELECT repo_full_name FROM v_stars WHERE user_id IN (SELECT user_id FROM users)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY starred_at DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) <= {MAX_STARS})
SELECT repo_full_name, count(*) AS stars FROM picked GROUP BY repo_full_name
ORDER BY stars DESC, repo_full_name LIMIT 150""")
def co_starred_top(spark, sf_dir):
    """Q1 feeding Q2's first step: the top 150 of the co-starred list."""
    stars = stars_view(spark, sf_dir)
    seed = top_repos(stars, 1).select("repo_full_name")
    return top_repos(co_starred_repos(stars, seed, MAX_USERS, MAX_STARS, FIXTURE_STAR_ORDER), 150)
