"""Star-table operators: counts, ranking, per-user caps, co-starred repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_n_per_group


def star_counts(stars: DataFrame, name_col: str = "repo_full_name") -> DataFrame:
    """Stars per repository: partial + final hash aggregation, safe for hot repositories."""
    return stars.groupBy(name_col).agg(F.count(F.lit(1)).alias("stars"))


def top_repos(stars: DataFrame, n: int = 100, name_col: str = "repo_full_name", seq_col: str | None = None) -> DataFrame:
    """The ``n`` most starred repositories; ties broken by name (a total order).

    ``orderBy().limit(n)``: every task keeps its own top ``n`` and only those are merged; for an ``n``
    that is large itself Spark sorts in a distributed way.  With ``seq_col`` ties go to the name seen first
    (smallest sequence number), then to the name.
    """
    if seq_col is None:
        return star_counts(stars, name_col).orderBy(F.col("stars").desc(), F.col(name_col).asc()).limit(n)
    counts = stars.groupBy(name_col).agg(F.count(F.lit(1)).alias("stars"), F.min(seq_col).alias("_first"))
    return counts.orderBy(F.col("stars").desc(), F.col("_first").asc(), F.col(name_col).asc()).limit(n).drop("_first")


def _chron(order: Sequence[str], newest_first: bool) -> list[Column]:
    return [F.col(c).desc() if newest_first else F.col(c).asc() for c in order]


def cap_stars_per_user(stars: DataFrame, max_stars: int | None, order: Sequence[str] = ("starred_at", "seq"),
                       newest_first: bool = True, user_col: str = "user_id") -> DataFrame:
    """At most ``max_stars`` stars per user, newest first by default (the starred list order)."""
    spec = [(c, not newest_first) for c in order]
    return first_n_per_group(stars, [user_col], spec, max_stars)


def stargazers(stars: DataFrame, seed: str | DataFrame, max_users: int | None,
               order: Sequence[str] = ("starred_at", "seq"), user_col: str = "user_id",
               name_col: str = "repo_full_name") -> DataFrame:
    """Users who starred ``seed``, in the order they first starred it; at most ``max_users``."""
    if isinstance(seed, str):
        seed_stars = stars.where(F.col(name_col) == F.lit(seed))
    else:
        seed_stars = stars.join(seed.select(name_col), name_col, "left_semi")
    first = seed_stars.groupBy(user_col).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
    if max_users is None or max_users < 0:
        return first.select(user_col)
    return first.orderBy(F.col("_first").asc(), F.col(user_col).asc()).limit(max_users).select(user_col)


def co_starred_repos(stars: DataFrame, seed: str | DataFrame, max_users: int | None = 1000,
                     max_stars: int | None = 300, order: Sequence[str] = ("starred_at", "seq"),
                     user_col: str = "user_id", name_col: str = "repo_full_name") -> DataFrame:
    """Star list of the seed's stargazers: first ``max_users`` users, ``max_stars`` stars each.

    One row per (user, star), duplicates kept, like the reference's flat name list.
    The planner broadcasts the user list if it measures small.
    """
    users = stargazers(stars, seed, max_users, order, user_col, name_col)
    picked = stars.join(users, user_col, "left_semi")
    return cap_stars_per_user(picked, max_stars, order, True, user_col)
