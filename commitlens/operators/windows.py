"""Window-like operators that stay safe when one key holds a third of the rows.

An *order* is a sequence of ``(column, ascending)`` pairs that must be a total
order inside each group (ties would make results engine-dependent).

* ``first_n_per_group``: ``row_number() <= n``.  Catalyst turns it into a partial
  ``WindowGroupLimit`` before the shuffle, so a hot key ships at most ``n`` rows
  per map task instead of all of its rows.
* ``lag_over_group``: previous row's values inside a group with no bound on group
  size.  Groups that are no larger than one task's share of the rows are one plain window:
  their rows move once, to a number of tasks that grows with them, and nothing is written.  Rows of hot keys are range-partitioned on
  (keys, order), so a hot key is cut into contiguous slices over many tasks; the first row
  of every slice then takes its predecessor from the tail of the previous slice (one row
  per slice).
* ``as_of``: the last row of another table before each row, in the same way.
* ``global_row_number``: 1-based rank over the whole frame from a distributed sort
  plus per-partition offsets (a table with one row per partition), not a
  single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .parallel import row_partitions

Order = Sequence[tuple[str, bool]]


def sort_exprs(order: Order, reverse: bool = False) -> list[Column]:
    out = []
    for name, ascending in order:
        asc = ascending != reverse
        out.append(F.col(name).asc_nulls_first() if asc else F.col(name).desc_nulls_last())
    return out


def _group_limit_threshold(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Order, n: int | None,
                      rank_col: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows per group in ``order``; ``n`` None or negative keeps all.

    Small ``n`` plans as a partial ``WindowGroupLimit`` (at most ``n`` rows per key
    leave each map task).  Above Spark's group-limit threshold that rewrite does not
    apply, so the rank comes from ``group_row_number``, which never gives one task a
    whole group.
    """
    if n is None or n < 0:
        return df if rank_col is None else group_row_number(df, keys, order, rank_col)
    name = rank_col or "_rn"
    if n > _group_limit_threshold(df):
        out = group_row_number(df, keys, order, name).where(F.col(name) <= F.lit(n))
    else:
        w = Window.partitionBy(*keys).orderBy(*sort_exprs(order))
        out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= F.lit(n))
    return out if rank_col else out.drop(name)


def group_row_number(df: DataFrame, keys: Sequence[str], order: Order, name: str = "row_number",
                     slices: int | None = None) -> DataFrame:
    """``row_number()`` within each group, exact for any group size.

    Range partitioning on (keys, order) cuts a hot group into contiguous slices; each
    slice numbers its rows locally and adds the row count of the group's earlier
    slices (a table with one row per (key, slice)).  The slice-local result is
    materialised once (checkpoint in the shared folder) so every branch sees the
    same slices.
    """
    spark = df.sparkSession
    keys = list(keys)
    n_slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    local = (df.repartitionByRange(n_slices, *[F.col(k) for k in keys], *sort_exprs(order))
             .withColumn("_slice", F.spark_partition_id())
             .withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*sort_exprs(order))))
             .checkpoint(eager=True))
    counts = local.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")).alias("_o")
    cond = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_o.{k}")) for k in keys] + [F.col("_l._slice") == F.col("_o._slice")]
    out = local.alias("_l").join(offsets, cond, "inner")
    cols = [F.col(f"_l.{c}") for c in df.columns]
    return out.select(*cols, (F.col("_o._off") + F.col("_l._pos")).cast("int").alias(name))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """First row per key in ``order`` (``order`` lists the wanted row first)."""
    return first_n_per_group(df, keys, order, 1)


TRACKED = 10_000  # keys whose rows a task counts


def _slices(df: DataFrame, slices: int | None) -> int:
    return slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _hot(df: DataFrame, keys: Sequence[str], slices: int) -> tuple[Column | None, int]:
    """Which groups hold more than one of ``slices`` equal shares of the rows (none of them: None), and the number of rows.

    One reading of the keys alone, in which every task keeps a sketch of its most frequent keys.  A sketch may count a key
    too high: that decides where the rows of a group are handled, never what comes out.
    """
    top = F.expr(f"approx_top_k(_h, {slices}, {max(TRACKED, slices)})")
    found = df.select(F.xxhash64(*keys).alias("_h")).agg(top.alias("top"), F.count(F.lit(1)).alias("n")).first()
    hot = [t["item"] for t in found["top"] or () if t["count"] * slices > found["n"]]  # ``slices`` numbers at most
    return F.xxhash64(*keys).isin(hot) if hot else None, found["n"]


def lag_over_group(df: DataFrame, keys: Sequence[str], order: Order, cols: Sequence[str],
                   names: Sequence[str] | None = None, slices: int | None = None) -> DataFrame:
    """Add, for each row, ``cols`` of the previous row of its group in ``order``.

    Exact for any group size; no group above a task's share of the rows is ever handled by a single task.
    """
    names = list(names or [f"prev_{c}" for c in cols])
    keys, n_slices = list(keys), _slices(df, slices)
    hot, n = _hot(df, keys, n_slices)
    w = Window.partitionBy(*keys).orderBy(*sort_exprs(order))
    small = df if hot is None else df.where(~hot)
    out = small.repartition(row_partitions(df, n), *keys).select("*", *[F.lag(c).over(w).alias(nm) for c, nm in zip(cols, names)])
    return out if hot is None else out.unionByName(_lag_sliced(df.where(hot), keys, order, cols, names, n_slices))


def _lag_sliced(df: DataFrame, keys: list[str], order: Order, cols: Sequence[str], names: list[str], n_slices: int) -> DataFrame:
    spark = df.sparkSession
    # Slices come from sampled range bounds, which may differ between evaluations, so
    # the slice-local window result is materialised once (checkpoint in the shared
    # folder); every branch below reads that copy.
    ensure_checkpoint_dir(spark)
    ranged = (df.repartitionByRange(n_slices, *[F.col(k) for k in keys], *sort_exprs(order))
              .withColumn("_slice", F.spark_partition_id()))
    w = Window.partitionBy(*keys, "_slice").orderBy(*sort_exprs(order))
    w_all = Window.partitionBy(*keys, "_slice")
    local = ranged.select(
        "*",
        *[F.lag(c).over(w).alias(nm) for c, nm in zip(cols, names)],
        F.row_number().over(w).alias("_pos"),
        F.count(F.lit(1)).over(w_all).alias("_cnt"),
    ).checkpoint(eager=True)
    # Tail (last row) of every (key, slice); then each slice's predecessor tail.
    tails = local.where(F.col("_pos") == F.col("_cnt")).select(*keys, "_slice", *cols)
    wt = Window.partitionBy(*keys).orderBy("_slice")
    carried = tails.select(*keys, "_slice", *[F.lag(c).over(wt).alias(nm) for c, nm in zip(cols, names)])
    h = local.where(F.col("_pos") == 1).drop(*names).alias("_h")
    c = carried.alias("_c")
    cond = [F.col(f"_h.{k}").eqNullSafe(F.col(f"_c.{k}")) for k in keys] + [F.col("_h._slice") == F.col("_c._slice")]
    heads = h.join(c, cond, "left").select("_h.*", *[F.col(f"_c.{nm}") for nm in names])
    rest = local.where(F.col("_pos") > 1)
    cols_out = [c for c in local.columns if c not in ("_slice", "_pos", "_cnt")]
    return rest.select(*cols_out).unionByName(heads.select(*cols_out))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Order, cols: Sequence[str],
          names: Sequence[str] | None = None, slices: int | None = None, screen: bool = True) -> DataFrame:
    """``left`` plus, for each of its rows, ``cols`` of the last row of ``right`` that stands before it in ``order`` among the
    rows with the same ``keys`` (null where there is none).  A row of ``right`` at the same place does not count.

    One sort of both sides together and a running last value; groups with more than a task's share of ``right`` are cut into
    range slices as in ``lag_over_group``.  Only rows of ``right`` whose keys ``left`` has are sorted; without ``screen``, for
    a ``left`` that has nearly all of them, the rows are not joined before.
    """
    keys, names, n_slices = list(keys), list(names or [f"prev_{c}" for c in cols]), _slices(left, slices)
    hot, n = _hot(right, keys, n_slices)
    # a null key meets nothing
    asked = right.join(left.select(*keys).distinct(), keys, "left_semi") if screen else right.dropna("any", subset=keys)
    places = list(dict.fromkeys([*keys, *[c for c, _ in order]]))
    others = [c for c in left.columns if c not in places]
    value = F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names)])
    mine = left.select(*places, *others, F.lit(0).alias("_side"))
    both = mine.unionByName(asked.select(*places, F.lit(1).alias("_side"), value.alias("_value")), allowMissingColumns=True)
    in_order = [*sort_exprs(order), F.col("_side").asc()]
    so_far = Window.partitionBy(*keys).orderBy(*in_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = both if hot is None else both.where(~hot)
    if not screen:  # nearly all of ``right`` is sorted, so its rows say how many tasks that takes
        small = small.repartition(row_partitions(left, 2 * n), *keys)
    found = small.withColumn("_value", F.last("_value", ignorenulls=True).over(so_far)).where("_side = 0")
    if hot is not None:
        found = found.unionByName(_as_of_sliced(both.where(hot), keys, in_order, n_slices))
    return found.select(*left.columns, *[F.col(f"_value.{n}").alias(n) for n in names])


def _as_of_sliced(both: DataFrame, keys: list[str], in_order: list[Column], n_slices: int) -> DataFrame:
    """The rows of ``_side`` 0 with the last ``_value`` before them, over range slices: a running last value per slice, and the
    last value of the slices before it for the rows at its head."""
    ensure_checkpoint_dir(both.sparkSession)
    ranged = both.repartitionByRange(n_slices, *[F.col(k) for k in keys], *in_order).withColumn("_slice", F.spark_partition_id())
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*in_order)
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the slices come from sampled bounds: written once, so that both branches see the same
    local = ranged.withColumns({"_value": F.last("_value", ignorenulls=True).over(so_far), "_pos": F.row_number().over(in_slice)}).checkpoint(eager=True)
    tails = local.groupBy(*keys, "_slice").agg(F.max_by("_value", "_pos").alias("_tail"))  # one row per (key, slice)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_slice", F.last("_tail", ignorenulls=True).over(before).alias("_tail")).where("_tail IS NOT NULL").alias("_c")
    rows = local.where("_side = 0").alias("_l")
    cond = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_c.{k}")) for k in keys] + [F.col("_l._slice") == F.col("_c._slice")]
    filled = F.coalesce("_l._value", "_c._tail").alias("_value")
    return rows.join(carried, cond, "left").select(*[filled if c == "_value" else F.col(f"_l.{c}") for c in both.columns])


def global_row_number(df: DataFrame, order: Order, name: str = "row_number") -> DataFrame:
    """1-based position of every row in ``order`` over the whole frame."""
    # Positions are materialised once (checkpoint in the shared folder): a sort's
    # range bounds come from sampling and could differ between two evaluations.
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (df.orderBy(*sort_exprs(order))
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    ordered = ordered.withColumn("_part", F.shiftright(F.col("_mid"), 33)) \
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bound known before the job runs
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    return (ordered.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + F.lit(1))
            .drop("_mid", "_part", "_local", "_off"))

