"""History sources (S3): parquet history tables or plain-git log exports.

Tables::

    commits(repo_url, commit_id, author_raw, commit_time, walk_index)
    changes(repo_url, commit_id, change_index, old_path, old_blob_id, new_path, new_blob_id)

``read_history`` joins them into flat change rows.  ``read_git_log`` reads text
produced per repository by::

    git -c core.quotePath=false log -c --raw --no-abbrev --no-renames --root \\
        --format='%x1e%H%x1f%P%x1f%an <%ae>%x1f%ct'

Spark splits records on the ``\\x1e`` separator (one row per commit), the header on
``\\x1f``, and explodes the ``:``-prefixed raw lines; a merge line (``::``) gives one
change per parent, an all-zero id means the side is absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZERO_ID = "0" * 40


def read_history(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Flat change rows: commit attributes joined onto every change (equi join on repo + commit)."""
    c = commits.select("repo_url", "commit_id", "author_raw", "commit_time", "walk_index")
    out = changes.join(c, ["repo_url", "commit_id"], "inner")
    return out.withColumn("file_path", F.coalesce(F.col("new_path"), F.col("old_path")))


def read_history_tables(spark: SparkSession, commits_path: str, changes_path: str) -> DataFrame:
    return read_history(spark.read.parquet(commits_path), spark.read.parquet(changes_path))


def write_history_tables(flat: DataFrame, commits_path: str, changes_path: str, mode: str = "overwrite") -> None:
    """Split flat change rows into the two tables (commits de-duplicated)."""
    (flat.select("repo_url", "commit_id", "author_raw", "commit_time", "walk_index")
     .dropDuplicates(["repo_url", "commit_id"]).write.mode(mode).parquet(commits_path))
    (flat.select("repo_url", "commit_id", "change_index", "old_path", "old_blob_id", "new_path", "new_blob_id")
     .write.mode(mode).parquet(changes_path))


def _null_if_zero(c):
    return F.when(~c.rlike("^0+$"), c)


def _unquote_path(c):
    """Undo git's C-style quoting of unusual paths (``"we\\"ird\\tname"``); plain paths pass through."""
    inner = F.regexp_replace(c, r'^"(.*)"$', "$1")
    inner = F.regexp_replace(inner, r"\\\\", "\u0000")  # escaped backslash, kept aside
    for esc, ch in ((r'\\"', '"'), (r"\\t", "\t"), (r"\\n", "\n")):
        inner = F.regexp_replace(inner, esc, ch)
    inner = F.regexp_replace(inner, "\u0000", r"\\")  # Java replacement: one literal backslash
    return F.when(c.rlike(r'^".*"$'), inner).otherwise(c)


def read_git_log(spark: SparkSession, path: str, repo_url: str | None = None) -> DataFrame:
    """Flat change rows from git log exports (one file per repository).

    ``repo_url`` defaults to the file's base name without extension.  ``walk_index``
    follows the file order (git prints newest first), so the walk order is
    ``commit_time DESC, walk_index``.  Each parent of a merge gives its own row.
    """
    raw = (spark.read.option("lineSep", "\x1e").text(path)
           .where(F.length(F.trim(F.col("value"))) > 0)
           .withColumn("walk_index", F.monotonically_increasing_id())
           .withColumn("_file", F.input_file_name()))
    lines = F.split(F.col("value"), "\n")
    header = F.split(F.element_at(lines, 1), "\x1f")
    if repo_url:
        repo = F.lit(repo_url)
    elif "repo_url" in raw.columns:  # folders written as repo_url=<escaped url>
        repo = F.col("repo_url").cast("string")
    else:
        repo = F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1)
    commits = raw.select(
        repo.alias("repo_url"),
        F.element_at(header, 1).alias("commit_id"),
        F.element_at(header, 3).alias("author_raw"),
        F.timestamp_seconds(F.element_at(header, 4).cast("long")).alias("commit_time"),
        "walk_index",
        F.filter(lines, lambda x: x.startswith(":")).alias("_raw"),
    )
    ch = commits.select("*", F.posexplode("_raw").alias("change_index", "_line")).drop("_raw")
    m = F.regexp_extract("_line", r"^(:+)", 1)
    meta = F.split(F.regexp_extract("_line", r"^:+([^\t]*)\t", 1), " ")
    path_col = _unquote_path(F.regexp_extract("_line", r"^[^\t]*\t(.*)$", 1))
    n_par = F.length(m)
    # fields: n+1 modes, n old ids, 1 new id, status
    ch = ch.select(
        "repo_url", "commit_id", "author_raw", "commit_time", "walk_index", "change_index",
        F.slice(meta, n_par + 2, n_par).alias("_olds"),
        F.element_at(meta, n_par * 2 + 2).alias("_new"),
        F.element_at(meta, n_par * 2 + 3).alias("status"),
        path_col.alias("_path"),
    )
    ch = ch.select("*", F.posexplode("_olds").alias("parent_index", "_old")).drop("_olds")
    old_id = _null_if_zero(F.col("_old"))
    new_id = _null_if_zero(F.col("_new"))
    return ch.select(
        "repo_url", "commit_id", "author_raw", "commit_time", "walk_index", "change_index", "parent_index", "status",
        F.when(old_id.isNotNull(), F.col("_path")).alias("old_path"), old_id.alias("old_blob_id"),
        F.when(new_id.isNotNull(), F.col("_path")).alias("new_path"), new_id.alias("new_blob_id"),
        F.col("_path").alias("file_path"),
    )


def write_git_log(flat: DataFrame, path: str) -> None:
    """Render flat change rows (with ``old_blob_id``) as git log export text, one commit per record,
    partitioned by repository folder.  For building test inputs from tables.

    Dealt by repository before the commits are grouped, so the rows move once and a repository has one file, compressed."""
    zero = F.lit(ZERO_ID)
    status = (F.when(F.col("old_blob_id").isNull(), "A").when(F.col("new_blob_id").isNull(), "D").otherwise("M"))
    line = F.concat(F.lit(":100644 100644 "), F.coalesce("old_blob_id", zero), F.lit(" "),
                    F.coalesce("new_blob_id", zero), F.lit(" "), status, F.lit("\t"), F.col("file_path"))
    per_commit = (flat.select("repo_url", "commit_id", "author_raw", "commit_time", "change_index",
                              line.alias("_l"))
                  .repartition("repo_url")
                  .groupBy("repo_url", "commit_id", "author_raw", "commit_time")
                  .agg(F.array_sort(F.collect_list(F.struct("change_index", "_l"))).alias("_ls")))
    record = F.concat(
        F.lit("\x1e"), F.col("commit_id"), F.lit("\x1f\x1f"), F.col("author_raw"), F.lit("\x1f"),
        F.unix_timestamp("commit_time").cast("string"), F.lit("\n\n"),
        F.array_join(F.transform("_ls", lambda s: s["_l"]), "\n"), F.lit("\n"))
    per_commit.select("repo_url", record.alias("value")).write.mode("overwrite").partitionBy("repo_url").text(path, compression="gzip")
