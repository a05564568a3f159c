"""Minimax contiguous partition of documents into shards, with copies of a text kept together.

Equal texts form one atomic group (all null texts form one too).  Groups stand in the order of their
SHA-256 digest, and each shard takes a contiguous run of them.  The law is ``bytes``: the largest shard
is as small as any contiguous partition of that order allows, and within that bound the others are near equal.

The capacity is found by binary search: a capacity is feasible if filling the shards greedily from the left
uses no more than ``shards``.  The search runs over sums of digest ranges ("cells"), never over the groups:
a cell that holds several groups leaves the place of a cut inside it open, so each greedy check gives a lower
and an upper place for every cut, and each capacity is feasible, infeasible or open.  Cells in which a cut may
fall are then split by two more hex digits, in one aggregation over the group sums, until no capacity is open.
The driver holds a few thousand cells at any size of the input; the groups never leave Spark.

The cuts are then set from the left: each shard ends at the edge nearest to an even share of what lies before the next group that
is larger than an even share (or before the end), no further than the capacity allows and far enough that the shards behind it hold
the rest.  So a hot group makes one shard large, and the others share the rest.  Cells that hold such a place are split in the same way.

A shard is then a range of digests, which every task decides from seven literals.  Slots number the rows of a
shard by a hash of doc_id, counted up over hash buckets, so no task numbers a whole shard.

A group larger than an even share makes its shard as large as itself.  Null and empty texts have no bytes and count 1
each; their CRC is 0.  Null ids and repeated rows get slots of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, register

SHARDS = 8
#: hex digits of a digest that tell the first cells apart, and that each split adds
FIRST_DIGITS, MORE_DIGITS = 3, 2
SLOT_DIGITS = 3


@dataclass
class Cells:
    """Contiguous digest ranges in order: prefix (lower bound), edges (sums up to each), whether one group fills it."""
    prefix: list[str]
    edges: np.ndarray
    atomic: np.ndarray

    def cut(self, x: int) -> tuple[int, int]:
        """The last edge up to x, and the last place up to x where a cut may be."""
        i = bisect.bisect_right(self.edges, x) - 1
        sure = int(self.edges[i])
        return sure, sure if i == len(self.atomic) or self.atomic[i] else x

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Lower and upper place of each shard's end when the shards are filled greedily."""
        low = high = 0
        out = []
        for _ in range(shards):
            low, high = self.cut(low + capacity)[0], self.cut(high + capacity)[1]
            out.append((low, high))
        return out


    def even_cuts(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Ends of all shards but the last, near even shares of the rest, and the cells that leave one open (none: the ends are right)."""
        edges, total = self.edges, int(self.edges[-1])
        unsure: set[int] = set()

        def below(x: int) -> int:
            i = bisect.bisect_right(edges, x) - 1
            if edges[i] < x and not self.atomic[i]:
                unsure.add(i)
            return int(edges[i])

        def above(x: int) -> int:
            i = bisect.bisect_left(edges, x)
            if edges[i] > x and not self.atomic[i - 1]:
                unsure.add(i - 1)
            return int(edges[i])

        enough = [total]  # from enough[k] on, k shards hold the rest
        for _ in range(shards - 1):
            enough.append(above(max(0, enough[-1] - capacity)))
        hot = []  # groups above an even share of all
        for i in np.flatnonzero(np.diff(edges) * shards > total):
            hot.append((int(edges[i]), int(edges[i + 1]))) if self.atomic[i] else unsure.add(int(i))
        at, out = 0, []
        for left in range(shards, 1, -1):
            ahead = [(a, b) for a, b in hot if a >= at]
            stop = ahead[0][0] if ahead else total
            free = total - at - sum(b - a for a, b in ahead)
            if stop == at:  # a hot group begins here, or nothing is left
                even = ahead[0][1] if ahead else total
            else:  # as many even shares up to the next hot group as come nearest to the share of all that is not hot
                runs = max(1, (2 * (stop - at) * max(1, left - len(ahead)) + free) // (2 * free))
                even = at + -((at - stop) // runs)
            low, high = below(even), above(even)
            near = low if at < low and even - low <= high - even else high
            at = max(at, min(max(near, enough[left - 1]), below(min(at + capacity, total))))
            out.append(at)
        return out, unsure


def _least(lo: int, hi: int, ok) -> int:
    """The smallest value in (lo, hi] for which the monotone ``ok`` holds; ok(hi) does."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def _cells(rows) -> Cells:
    rows = sorted(rows)
    edges = np.concatenate([[0], np.cumsum([b for _, b, _ in rows])]).astype(np.int64)
    return Cells([p for p, _, _ in rows], edges, np.array([n == 1 for _, _, n in rows], dtype=bool))


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """(capacity, lower digest bounds of shards 1, 2, ...) for ``groups(digest, bytes)``; the driver sees cell sums only."""
    def sums(df: DataFrame, prefix: Column) -> list[tuple[str, int, int]]:
        found = df.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        return [(r["p"], int(r["b"]), r["n"]) for r in found.collect()]

    rows = sums(groups, F.substring("digest", 1, FIRST_DIGITS))
    if not rows:
        return 0, []
    while True:
        cells = _cells(rows)
        total = int(cells.edges[-1])
        feasible = _least(0, total, lambda c: cells.cuts(c, shards)[-1][0] >= total)
        possible = _least(0, feasible, lambda c: cells.cuts(c, shards)[-1][1] >= total) if feasible > 1 else feasible
        if possible == feasible:
            places, split = cells.even_cuts(feasible, shards)
            if not split:
                break
        else:
            ranges = list(zip((low for low, _ in cells.cuts(possible, shards)), (high for _, high in cells.cuts(feasible, shards))))
            split = {i for i in range(len(cells.prefix)) if not cells.atomic[i]
                     and any(cells.edges[i] < high and low < cells.edges[i + 1] for low, high in ranges[:-1])}
            if not split:  # every place is sure: the two searches agree
                raise AssertionError("open capacities without open cells")
        prefixes = {cells.prefix[i] for i in split}
        finer = F.coalesce(*[F.when(F.substring("digest", 1, n).isin(sorted(p for p in prefixes if len(p) == n)), F.substring("digest", 1, n + MORE_DIGITS))
                             for n in sorted({len(p) for p in prefixes})])
        rows = [r for r in rows if r[0] not in prefixes] + sums(groups.filter(finer.isNotNull()), finer)
    bounds = []
    for place in places:
        i = int(np.searchsorted(cells.edges, place))
        bounds.append(cells.prefix[i] if i < len(cells.prefix) else "g")  # after every hex digest: an empty shard
    return feasible, bounds


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not ``key``)."""
    text = F.col(text_col)
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("digest")), "shard_rows")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard_groups")
    _, bounds = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("digest") >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("digest")).cast("binary"))
    placed = rows.select("*", shard.alias("shard"), place.alias("place"))
    return _with_slots(placed.withColumn("bucket", F.substring("place", 1, SLOT_DIGITS))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _with_slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers within each shard: rows before the bucket, plus the row's number in it."""
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside: Column = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "text_crc32", "digest"))
    return rows.join(offsets, ["shard", "bucket"]).withColumn("slot", (F.col("_offset") + inside - 1).cast("long"))


@register("op4_minimax_shards")
def op4_minimax_shards(spark, sf_dir):
    return shard_rows(documents(spark, sf_dir))
