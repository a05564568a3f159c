"""Added / deleted line counts between file versions.

Lines are split like Python's ``str.splitlines`` and told apart by two independent hashes (64 + 32 bits); a collision
inside one pair is ~1e-20 likely for 20,000-line files.  ``line_hashes`` reads each asked text once and writes its hashes;
nothing after it touches a text.

Two counts on top of it:

* ``line_diff_counts`` -- by multisets: the lines of one side less those of the other.  Exact whenever line order does not
  matter; a pure move counts 0/0.
* ``ordered_line_diff_counts`` -- order-aware: lines that are unique on both sides are anchors, the longest run of anchors that
  is increasing on both sides stays, and multisets are compared between neighbouring anchors of the run.  A moved line
  counts 1/1.  Lines meet by a window on (pair, line) and get their place between anchors by a running count on (pair, side),
  so neither side of a pair is ever held as text.  Only where anchors are out of order does a worker look for the run, over the
  anchors' positions alone.

Pairs whose sides have at most ``ROW_LINES`` lines meet the hashes of both sides in one row and are counted there, so the hashes
of a side move once a pair and nothing is dealt by line; longer sides, and ids that ``texts`` holds more than once, go line by
line as above.  Both ways give the same counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..session import materialise
from .parallel import cpu_partitions, spread

ADDED = "added_lines_num"
DELETED = "deleted_lines_num"

#: sides of at most so many lines are compared in one row: a batch of rows then stays small
ROW_LINES = 500

#: what a line starts with: a counter over a unified diff takes an added "+..." or a deleted "-..." for a file header
PLUS, MINUS = 1, 2


def hashed_line(x: Column) -> Column:
    """What is kept of a line: two hashes, and what it starts with."""
    mark = F.when(x.startswith("+"), F.lit(PLUS)).when(x.startswith("-"), F.lit(MINUS)).otherwise(F.lit(0)).cast("tinyint")
    return F.struct(F.xxhash64(x).alias("_h1"), F.hash(x).alias("_h2"), mark.alias("_m"))


def line_hashes(texts: DataFrame, ids: DataFrame, id_col: str = "blob_id", text_col: str = "text") -> DataFrame:
    """(_id, _l) of the asked ids (column ``_id`` of ``ids``), written once; _l holds (_h1, _h2, _m) of each line.

    The ids meet the text where it is read if they measure small enough to be broadcast, and only survivors are hashed.
    """
    asked = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(ids.select("_id").distinct(), "_id", "left_semi")
    asked = spread(asked, "_id")  # survivors only; a table of few files would be hashed by few tasks
    return materialise(asked.select("_id", F.transform(split_lines("_t"), hashed_line).alias("_l")), "line_hashes")


def _asked(pairs: DataFrame, new_col: str, old_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct pairs, written once; those that are modifications; all ids)."""
    p = materialise(pairs.select(new_col, old_col).where(F.col(new_col).isNotNull()).dropDuplicates(), "pairs")
    mod = p.where(F.col(old_col).isNotNull() & (F.col(new_col) != F.col(old_col)))
    ids = p.select(F.col(new_col).alias("_id")).unionByName(mod.select(F.col(old_col).alias("_id"))).distinct()
    return p, mod, ids


def _roles(mod: DataFrame, new_col: str, old_col: str, keys: list[str]) -> DataFrame:
    return (mod.select(F.col(new_col).alias("_id"), *keys, F.lit(1).alias("_s"))
            .unionByName(mod.select(F.col(old_col).alias("_id"), *keys, F.lit(-1).alias("_s"))))


def _pair_counts(new: list[tuple], old: list[tuple], ordered: bool, skip_marker_lines: bool) -> tuple[int, int]:
    """Lines added and deleted from ``old`` to ``new``; a line is (_h1, _h2), with ``skip_marker_lines`` (_h1, _h2, _m)."""
    left: Counter = Counter()
    if ordered:
        n_new, n_old, old_at = Counter(new), Counter(old), {x: i for i, x in enumerate(old)}
        anchors = [(i, old_at[x]) for i, x in enumerate(new) if n_new[x] == 1 and n_old.get(x) == 1]
        run = [anchors[i] for i in longest_run([o for _, o in anchors])]
        for lines, side, sign in ((new, 0, 1), (old, 1, -1)):
            kept, segment = {a[side] for a in run}, 0
            for i, x in enumerate(lines):
                if i in kept:
                    segment += 1
                else:
                    left[segment, x] += sign
    else:
        for lines, sign in ((new, 1), (old, -1)):
            for x in lines:
                left[0, x] += sign
    added = sum(n for (_, x), n in left.items() if n > 0 and not (skip_marker_lines and x[2] == PLUS))
    deleted = -sum(n for (_, x), n in left.items() if n < 0 and not (skip_marker_lines and x[2] == MINUS))
    return added, deleted


def _add_counts(batches: Iterator[pa.RecordBatch], ordered: bool, skip_marker_lines: bool) -> Iterator[pa.RecordBatch]:
    """(new id, old id, columns of the new side, columns of the old side) -> (new id, old id, added, deleted)."""
    for b in batches:
        each = (b.num_columns - 2) // 2

        def lines(first: int) -> list[list[tuple]]:
            columns = b.columns[first:first + each]
            flat = list(zip(*(c.flatten().to_pylist() for c in columns)))
            ends = list(accumulate((n or 0 for n in columns[0].value_lengths().to_pylist()), initial=0))  # a null text has no lines
            return [flat[i:j] for i, j in zip(ends, ends[1:])]

        counts = [_pair_counts(n, o, ordered, skip_marker_lines) for n, o in zip(lines(2), lines(2 + each))]
        both = [pa.array([c[i] for c in counts], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *both], [*b.schema.names[:2], ADDED, DELETED])


def _in_rows(mod: DataFrame, hashed: DataFrame, new_col: str, old_col: str, ordered: bool, skip_marker_lines: bool) -> DataFrame:
    """Counts of modifications whose sides are short; those with a missing side have no row."""
    kept = ("_h1", "_h2", "_m") if skip_marker_lines else ("_h1", "_h2")

    def side(id_col: str, mark: str) -> DataFrame:
        return hashed.select(F.col("_id").alias(id_col), *[F.col(f"_l.{c}").alias(mark + c) for c in kept])

    met = mod.join(side(new_col, "_n"), new_col).join(side(old_col, "_o"), old_col)
    met = met.select(new_col, old_col, *["_n" + c for c in kept], *["_o" + c for c in kept])
    types = dict(met.dtypes)
    schema = f"`{new_col}` {types[new_col]}, `{old_col}` {types[old_col]}, {ADDED} int, {DELETED} int"
    return met.mapInArrow(partial(_add_counts, ordered=ordered, skip_marker_lines=skip_marker_lines), schema)


def _count(p: DataFrame, mod: DataFrame, hashed: DataFrame, new_col: str, old_col: str, by_line: Callable[[DataFrame], DataFrame],
           ordered: bool = False, skip_marker_lines: bool = False) -> DataFrame:
    """Counts of the modifications, in one row where their sides are short and ``by_line`` where not, and of new and unchanged
    files; pairs with a missing side have no row."""
    sizes = hashed.select("_id", F.size("_l").cast("int").alias("_n"))
    whole = (p.where(F.col(old_col).isNull() | (F.col(new_col) == F.col(old_col))).join(sizes.withColumnRenamed("_id", new_col), new_col)
             .select(new_col, old_col, F.when(F.col(old_col).isNull(), F.col("_n")).otherwise(0).cast("int").alias(ADDED), F.lit(0).alias(DELETED)))
    long = sizes.groupBy("_id").agg(F.count(F.lit(1)).alias("_rows"), F.max("_n").alias("_n")).where((F.col("_rows") > 1) | (F.col("_n") > ROW_LINES))
    long = materialise(long.select("_id"), "long_sides")
    if long.isEmpty():
        return _in_rows(mod, hashed, new_col, old_col, ordered, skip_marker_lines).unionByName(whole)
    named = [mod.join(long.withColumnRenamed("_id", c), c, "left_semi").select(new_col, old_col) for c in (new_col, old_col)]
    slow = materialise(named[0].unionByName(named[1]).distinct(), "long_pairs")
    fast = mod.join(slow, [new_col, old_col], "left_anti")
    known = sizes.select("_id")
    modified = (slow.join(known.withColumnRenamed("_id", new_col), new_col, "left_semi").join(known.withColumnRenamed("_id", old_col), old_col, "left_semi")
                .join(by_line(slow), [new_col, old_col], "left")
                .select(new_col, old_col, *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in (ADDED, DELETED)]))
    return _in_rows(fast, hashed, new_col, old_col, ordered, skip_marker_lines).unionByName(modified).unionByName(whole)


def line_diff_counts(pairs: DataFrame, texts: DataFrame, new_col: str = "new_blob_id", old_col: str = "old_blob_id",
                     id_col: str = "blob_id", text_col: str = "text", hashed: DataFrame | None = None) -> DataFrame:
    """Per distinct (new, old) pair: ``added_lines_num``, ``deleted_lines_num`` (multisets).

    A pair without an old side is a new file: (line count, 0).  Equal ids: (0, 0).  A pair that names an object
    that ``texts`` lacks has no row.  Ids of ``texts`` are unique.  ``hashed`` (``line_hashes``) saves reading texts.
    """
    p, mod, ids = _asked(pairs, new_col, old_col)
    hashed = line_hashes(texts, ids, id_col, text_col) if hashed is None else hashed
    return _count(p, mod, hashed, new_col, old_col, lambda pairs: _by_line(pairs, hashed, new_col, old_col))


def _by_line(mod: DataFrame, hashed: DataFrame, new_col: str, old_col: str) -> DataFrame:
    """Counts by multisets of the pairs that have lines, one row a line of a pair."""
    lines = hashed.select("_id", F.explode("_l").alias("_l")).select("_id", F.struct("_l._h1", "_l._h2").alias("_l"))
    per_line = lines.join(_roles(mod, new_col, old_col, [new_col, old_col]), "_id").groupBy(new_col, old_col, "_l").agg(F.sum("_s").alias("_d"))
    return per_line.groupBy(new_col, old_col).agg(
        F.sum(F.greatest(F.col("_d"), F.lit(0))).alias(ADDED), F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias(DELETED))


def longest_run(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence of distinct values; of several, the one whose last index is smallest, and
    going back from it always the nearest one."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    end = -1
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v), at.append(i)
            end = i
        else:
            tails[k], at[k] = v, i
    run = []
    while end >= 0:
        run.append(end)
        end = before[end]
    return run[::-1]


def _add_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = [longest_run(v) for v in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(runs, pa.list_(pa.int32()))], [*b.schema.names[:-1], "_run"])


def ordered_line_diff_counts(pairs: DataFrame, texts: DataFrame, new_col: str = "new_blob_id", old_col: str = "old_blob_id",
                             id_col: str = "blob_id", text_col: str = "text", skip_marker_lines: bool = False,
                             hashed: DataFrame | None = None) -> DataFrame:
    """Per distinct (new, old) pair: ``added_lines_num``, ``deleted_lines_num``, in line order: a moved line counts 1/1.

    New files, equal ids and missing objects as in ``line_diff_counts``.  With ``skip_marker_lines`` an added line that itself
    starts with ``+`` and a deleted line that starts with ``-`` are not counted: a unified diff shows them as ``++`` / ``--``,
    which a counter over it takes for file headers.  New files always count all their lines.
    """
    p, mod, ids = _asked(pairs, new_col, old_col)
    hashed = line_hashes(texts, ids, id_col, text_col) if hashed is None else hashed
    return _count(p, mod, hashed, new_col, old_col, lambda pairs: _ordered_by_line(pairs, hashed, new_col, old_col, skip_marker_lines), True, skip_marker_lines)


def _ordered_by_line(mod: DataFrame, hashed: DataFrame, new_col: str, old_col: str, skip_marker_lines: bool) -> DataFrame:
    """Counts in line order of the pairs that have lines, one row a line of a pair."""
    # a pair is one number from here on; written once, so that the number stays the same
    numbered = materialise(mod.withColumn("_p", F.monotonically_increasing_id()), "diff_pairs")
    lines = hashed.join(_roles(numbered, new_col, old_col, ["_p"]), "_id").select("_p", "_s", F.posexplode("_l").alias("_at", "_l"))
    lines = lines.select("_p", "_s", "_at", "_l._h1", "_l._h2", "_l._m")
    lines = lines.repartition(cpu_partitions(lines), "_p", "_h1", "_h2")  # as the window below needs them: dealt once
    counts = dict(added=F.lit(True), deleted=F.lit(True))
    if skip_marker_lines:
        counts = dict(added=F.col("_m") != PLUS, deleted=F.col("_m") != MINUS)
    same_line = Window.partitionBy("_p", "_h1", "_h2")
    new, old = F.col("_s") == 1, F.col("_s") == -1
    seen = lines.select("*", F.count(F.when(new, 1)).over(same_line).alias("_nn"), F.count(F.when(old, 1)).over(same_line).alias("_no"),
                        F.max(F.when(old, F.col("_at"))).over(same_line).alias("_old_at"))
    anchor = (F.col("_nn") == 1) & (F.col("_no") == 1)
    again = (F.col("_nn") > 0) & (F.col("_no") > 0) & ~anchor
    per_pair = seen.groupBy("_p").agg(
        F.count(F.when(new & (F.col("_no") == 0) & counts["added"], 1)).alias("_a"),
        F.count(F.when(old & (F.col("_nn") == 0) & counts["deleted"], 1)).alias("_d"),
        F.array_sort(F.collect_list(F.when(anchor & new, F.struct(F.col("_at").alias("n"), F.col("_old_at").alias("o"), F.col("_m").alias("m"))))).alias("_anchors"),
        F.collect_list(F.when(again, F.struct("_s", "_at", "_h1", "_h2", "_m"))).alias("_again"))
    per_pair = materialise(per_pair.withColumn("_o", F.transform("_anchors", lambda x: x["o"])), "diff_anchors")

    moved = F.col("_o") != F.array_sort("_o")
    schema = ", ".join(f"{c} {t}" for c, t in per_pair.dtypes if c != "_o") + ", _run array<int>"
    in_order = per_pair.where(~moved).drop("_o").select("*", F.col("_anchors").alias("_kept"), F.lit(0).alias("_ma"), F.lit(0).alias("_md"))
    runs = per_pair.where(moved).mapInArrow(_add_run, schema)
    kept = F.transform("_run", lambda i: F.element_at("_anchors", i + 1))

    def left(mark: int) -> Column:
        """Anchors that are not in the run; those that start with the mark are not counted."""
        def n(anchors) -> Column:
            return F.size(F.filter(anchors, lambda x: x["m"] != mark)) if skip_marker_lines else F.size(anchors)
        return n("_anchors") - n(kept)

    all_pairs = in_order.unionByName(runs.select("*", kept.alias("_kept"), left(PLUS).alias("_ma"), left(MINUS).alias("_md")).drop("_run"))
    all_pairs = all_pairs.select("_p", (F.col("_a") + F.col("_ma")).alias("_a"), (F.col("_d") + F.col("_md")).alias("_d"), "_kept", "_again")

    # lines that repeat: how many anchors of the run stand before each, and multisets between anchors
    def row(side: int, at: Column) -> Column:
        return F.struct(F.lit(side).alias("_s"), at.alias("_at"), F.lit(None).cast("bigint").alias("_h1"), F.lit(None).cast("int").alias("_h2"),
                        F.lit(None).cast("tinyint").alias("_m"))

    marks = F.concat(F.transform("_kept", lambda x: row(1, x["n"])), F.transform("_kept", lambda x: row(-1, x["o"])), F.col("_again"))
    placed = all_pairs.where(F.size("_again") > 0).select("_p", F.explode(marks).alias("_l")).select("_p", "_l.*")
    so_far = Window.partitionBy("_p", "_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    between = placed.withColumn("_seg", F.count(F.when(F.col("_h1").isNull(), 1)).over(so_far)).where(F.col("_h1").isNotNull())
    per_line = between.groupBy("_p", "_seg", "_h1", "_h2").agg(F.sum("_s").alias("_n"), F.first("_m").alias("_m"))
    repeated = per_line.groupBy("_p").agg(F.sum(F.when(counts["added"], F.greatest("_n", F.lit(0)))).alias("_ra"),
                                          F.sum(F.when(counts["deleted"], F.greatest(-F.col("_n"), F.lit(0)))).alias("_rd"))
    totals = all_pairs.select("_p", "_a", "_d").join(repeated, "_p", "left")
    return numbered.join(totals, "_p").select(new_col, old_col, (F.col("_a") + F.coalesce("_ra", F.lit(0))).alias(ADDED),
                                              (F.col("_d") + F.coalesce("_rd", F.lit(0))).alias(DELETED))


def max_added_lines(records: DataFrame, n: int) -> DataFrame:
    """Keep records that add at most ``n`` lines; a negative ``n`` keeps all (P4, as documented)."""
    if n < 0:
        return records
    return records.where(F.col(ADDED) <= F.lit(n))
