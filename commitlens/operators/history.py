"""History operators over flat change rows.

A *walk order* lists the newest change of a repository first and must be total
inside a repository (commit time ties are common), e.g.
``[("commit_time", False), ("walk_index", True), ("change_index", True)]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import Order, as_of, first_n_per_group, lag_over_group, latest_per_key

DEFAULT_WALK_ORDER: Order = (("commit_time", False), ("walk_index", True), ("change_index", True))


def reverse_order(order: Order) -> Order:
    return tuple((c, not asc) for c, asc in order)


def drop_deletions(changes: DataFrame, new_blob_col: str = "new_blob_id") -> DataFrame:
    """Deleted files carry no new blob (pushed down to the scan as ``IsNotNull``)."""
    return changes.where(F.col(new_blob_col).isNotNull())


def walk_order(changes: DataFrame, order: Order = DEFAULT_WALK_ORDER) -> Order:
    """``order`` made total for merges: a change has one row per parent where ``parent_index`` is given."""
    if "parent_index" in changes.columns and all(c != "parent_index" for c, _ in order):
        return (*order, ("parent_index", True))
    return order


def restrict_to_repos(changes: DataFrame, repos: DataFrame, key: str = "repo_url") -> DataFrame:
    """Left semi join to a repository list of any length; the planner broadcasts the list if it measures small."""
    return changes.join(repos.select(key), key, "left_semi")


def first_n_changes(changes: DataFrame, n: int | None, order: Order = DEFAULT_WALK_ORDER,
                    repo_col: str = "repo_url") -> DataFrame:
    """First ``n`` change records per repository in walk order (W1); ``n`` < 0 keeps all."""
    return first_n_per_group(changes, [repo_col], walk_order(changes, order), n)


def newest_commits(changes: DataFrame, n: int | None, commit_order: Order,
                   commit_cols: Sequence[str] = ("repo_url", "commit_id"), repo_col: str = "repo_url") -> DataFrame:
    """The ``n`` newest commits per repository (W3): one row per commit, ranked on commits,
    not on changes.  ``commit_order`` columns must be commit attributes."""
    cols = list(dict.fromkeys([*commit_cols, *[c for c, _ in commit_order]]))
    commits = changes.select(*cols).dropDuplicates(list(commit_cols))
    return first_n_per_group(commits, [repo_col], commit_order, n)


def latest_file_version(changes: DataFrame, order: Order = DEFAULT_WALK_ORDER,
                        keys: Sequence[str] = ("repo_url", "file_path"),
                        new_blob_col: str = "new_blob_id") -> DataFrame:
    """Newest surviving version of every path (W2): deletions dropped, then first per key."""
    return latest_per_key(drop_deletions(changes, new_blob_col), list(keys), walk_order(changes, order))


def version_pairs(changes: DataFrame, order: Order = DEFAULT_WALK_ORDER,
                  keys: Sequence[str] = ("repo_url", "file_path"), new_blob_col: str = "new_blob_id",
                  old_blob_col: str = "old_blob_id") -> DataFrame:
    """Old side of every change (W7): the previous (older) version's blob of the same path.

    Uses the skew-safe lag, so a path changed in a third of all commits is still
    spread over many tasks.  A deletion is a version with a null blob.
    """
    return lag_over_group(changes, list(keys), reverse_order(walk_order(changes, order)), [new_blob_col], [old_blob_col])


def previous_versions(kept: DataFrame, changes: DataFrame, order: Order = DEFAULT_WALK_ORDER,
                      keys: Sequence[str] = ("repo_url", "file_path"), new_blob_col: str = "new_blob_id",
                      old_blob_col: str = "old_blob_id", screen: bool = True) -> DataFrame:
    """``version_pairs`` for the rows of ``kept`` alone: an as-of lookup among the changes of their paths.

    Changes of other paths are screened by key and never sorted (``screen`` false: ``kept`` has nearly all paths); the rows of
    ``kept`` are rows of ``changes``.
    """
    order = walk_order(kept, order)
    versions = changes.select(*dict.fromkeys([*keys, *[c for c, _ in order], new_blob_col]))
    return as_of(kept, versions, list(keys), reverse_order(order), [new_blob_col], [old_blob_col], screen=screen)
