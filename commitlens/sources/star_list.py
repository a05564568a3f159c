"""Star list as text: one ``owner/name`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_star_list(spark: SparkSession, path: str, seq_col: str | None = None) -> DataFrame:
    """One row per non-empty line; only the line break is stripped (``\\r\\n`` too).

    ``seq_col`` adds numbers that grow with the place of a line in its file (and file by file), so that
    ``top_repos(..., seq_col=...)`` breaks ties by the name seen first.
    """
    cols = [F.col("value").alias("repo_full_name")]
    if seq_col:
        file = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("no"))
        cols.append(file.alias(seq_col))
    return spark.read.text(path).select(*cols).where(F.col("repo_full_name") != F.lit(""))


def write_star_list(stars: DataFrame, path: str, name_col: str = "repo_full_name", mode: str = "append") -> None:
    """Append the names as text lines (distributed write, one file per task)."""
    stars.select(F.col(name_col).alias("value")).write.mode(mode).text(path)
