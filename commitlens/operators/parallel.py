"""Spreading CPU-heavy work.

Adaptive execution merges small shuffle partitions by *bytes*; for CPU-bound
steps (regex extraction, sequence diffs, line hashing) a few megabytes of text can
be minutes of work, so the rows that survived all filters and joins are hash-partitioned
to an explicit count, which is never coalesced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONF_KEY = "spark.commitlens.cpuPartitions"


def cpu_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    explicit = spark.conf.get(CONF_KEY, None)
    if explicit:
        return int(explicit)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: rows that one task sorts: a few hundred bytes a row then stay far below a task's share of memory
ROWS_PER_TASK = 250_000


def row_partitions(df: DataFrame, rows: int) -> int:
    """A number of partitions that grows with the rows.  Adaptive execution merges partitions by their compressed bytes, and
    where rows compress well the sort of a merged partition spills; an explicit count is never merged."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


#: fewer asked keys than this are broadcast as they are; the screen of more has 16 to 32 bits a key, and never more than 32 MB
FEW_KEYS = 50_000
MOST_BITS = 1 << 28


def screened(rows: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``asked``: a join that follows moves the rows it needs and few
    others, however large the table is.  Every row that is asked for stays; some others do too, so an exact join must follow.

    A bitmap of the hashes of the asked keys, in pieces of 4 KB, meets the rows by broadcast, where they are read.  ``asked``
    is read twice.
    """
    n = asked.count()
    if n < FEW_KEYS:
        few = F.broadcast(asked.select(*[F.col(k).alias(f"_asked_{k}") for k in keys]))
        return rows.join(few, [F.col(k).eqNullSafe(F.col(f"_asked_{k}")) for k in keys], "left_semi")
    bits = min(MOST_BITS, 1 << (16 * n).bit_length())
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    piece, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    # positions are moved, not pieces that each task has filled in part
    marks = (asked.select(piece.alias("_piece"), at.alias("_at")).repartition("_piece")
             .groupBy("_piece").agg(F.bitmap_construct_agg("_at").alias("_marks")))
    byte = F.conv(F.hex(F.substring("_marks", F.shiftright(at, 3).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(marks), (piece == F.col("_piece")) & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1), "left_semi")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by a hash of the keys that no join shares: the exchange of a later join is then the planner's own,
    which it may split where a key is hot."""
    return df.repartition(cpu_partitions(df), F.xxhash64(*keys))
