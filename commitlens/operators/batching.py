"""Batches, resume and repository matching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import repo_slug
from ..session import ensure_checkpoint_dir
from .windows import Order, global_row_number


def batch_assign(items: DataFrame, size: int, order: Order, name: str = "batch_id") -> DataFrame:
    """Batch number of every row in ``order``: ``ceil(n / size)`` batches, the last one short.

    Uses a distributed global row number (sort + per-partition offsets), so the
    list is never funnelled through one partition.
    """
    if size <= 0:
        raise ValueError("batch size must be positive")
    numbered = global_row_number(items, order, "_pos")
    return numbered.withColumn(name, F.floor((F.col("_pos") - 1) / F.lit(size)).cast("bigint")).drop("_pos")


def resume_from_batch(batched: DataFrame, start_batch: int, name: str = "batch_id") -> DataFrame:
    """Skip batches before ``start_batch`` (restart after a failed batch)."""
    return batched.where(F.col(name) >= F.lit(start_batch))


def write_batches(batched: DataFrame, path: str, name: str = "batch_id") -> None:
    """One folder per batch; a batch that is written again replaces its folder, other batches stay."""
    batched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def pending_repos(wanted: DataFrame, done: DataFrame, wanted_col: str = "repo_full_name",
                  done_col: str = "repo_url") -> DataFrame:
    """Wanted repositories not yet in the output: anti join on the folder-safe slug (B2)."""
    w = wanted.withColumn("_slug", repo_slug(wanted_col))
    d = done.select(repo_slug(done_col).alias("_slug")).distinct()
    return w.join(d, "_slug", "left_anti").drop("_slug")


def repo_prefix_match(keys: DataFrame, entries: DataFrame, key_col: str = "key", entry_col: str = "entry",
                      pick: str = "all") -> DataFrame:
    """Pairs (key, entry) with ``entry.startswith(key)``, as a range join.

    An entry starts with a key if it lies in the interval from the key up to all that continues it.  Keys and entries are
    sorted together into range slices; in sorted order the intervals that are open form a stack, and an entry's keys are the
    stack.  The intervals open at the start of a slice are the keys of earlier slices that its first string starts with: a
    lookup with one string a slice.  No entry is copied, however many lengths the keys have.  ``pick="last"`` keeps one entry
    per key, the greatest, like the reference's "last match wins" with a deterministic order instead of directory-scan order.
    """
    if pick not in ("all", "last"):
        raise ValueError("pick must be 'all' or 'last'")
    spark = keys.sparkSession
    ensure_checkpoint_dir(spark)
    both = (keys.select(F.col(key_col).alias("_s"), F.lit(0).alias("_t")).unionByName(entries.select(F.col(entry_col).alias("_s"), F.lit(1).alias("_t")))
            .where("_s IS NOT NULL").distinct())
    # the slices come from sampled bounds: written once
    placed = (both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_s", "_t")
              .withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True))
    first = placed.groupBy("_slice").agg(F.min("_s").alias("_first"))  # one row a slice
    prefixes = first.select(F.col("_slice").alias("_in"), F.explode(F.transform(
        F.sequence(F.lit(0), F.length("_first")), lambda n: F.substring(F.col("_first"), F.lit(1), n))).alias("_s"))
    opened = placed.where("_t = 0").join(prefixes, "_s").where(F.col("_slice") < F.col("_in"))
    carried: dict[int, list[str]] = {}
    for r in opened.select("_in", "_s").collect():  # keys that contain each other, one such chain a slice
        carried.setdefault(r["_in"], []).append(r["_s"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[str] | None = None
        for b in batches:
            found: tuple[list[str], list[str]] = ([], [])
            for s, t, at in zip(*(c.to_pylist() for c in b.columns)):
                if stack is None:
                    stack = sorted(carried.get(at, []), key=len)
                while stack and not s.startswith(stack[-1]):
                    stack.pop()
                if t:
                    found[0].extend(stack), found[1].extend([s] * len(stack))
                else:
                    stack.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()) for f in found], [key_col, entry_col])

    pairs = placed.sortWithinPartitions("_s", "_t").mapInArrow(match, f"`{key_col}` string, `{entry_col}` string")
    if pick == "last":
        pairs = pairs.groupBy(key_col).agg(F.max(entry_col).alias(entry_col))
    return pairs
