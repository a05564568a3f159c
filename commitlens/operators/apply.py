"""User functions per row batch and per repository.

* ``map_rows``: ``fn(**kwargs, <free arg>=value)`` on every row, Arrow batches via
  ``mapInPandas``; the free argument is the keyword bound to ``None`` (the last
  such one).  An index column keeps the source order recoverable.
* ``apply_per_repo``: ``fn(key, frames) -> iterable of records`` per repository
  with ``groupBy().applyInPandas``; the group arrives as an iterator of Arrow
  batches, so a huge repository streams through the function instead of being
  materialised as one pandas frame.
* ``apply_isolated``: the same with failure isolation, in one pass: the records a
  repository gave before its error are kept, and its status row says what went wrong
  instead of failing the job.
* ``apply_status``: the status rows alone.
* ``cogroup_apply``: two inputs co-grouped per repository.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .parallel import row_partitions


OUTPUT_CHUNK_ROWS = 10_000


def _free_argument(kwargs: dict) -> str:
    free = ""
    for k, v in kwargs.items():
        if v is None:
            free = k
    if not free:
        raise ValueError("one keyword argument must be None: it receives the row value")
    return free


def map_rows(df: DataFrame, fn: Callable, value_col: str, out_col: str, out_type: str,
             index_col: str | None = None, **kwargs) -> DataFrame:
    """Add ``out_col = fn(**kwargs with the None keyword := value)`` for every non-empty value."""
    free = _free_argument(kwargs)
    bound = {k: v for k, v in kwargs.items() if k != free}
    call = functools.partial(fn, **bound)
    # empty elements are skipped before any work is scheduled: nulls, and '' for strings
    keep = F.col(value_col).isNotNull()
    if dict(df.dtypes)[value_col] == "string":
        keep = keep & (F.col(value_col) != F.lit(""))
    src = df.where(keep)
    if index_col:
        src = src.withColumn(index_col, F.monotonically_increasing_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf[out_col] = [call(**{free: v}) for v in pdf[value_col]]
            yield pdf

    schema = ", ".join(f"`{n}` {t}" for n, t in src.dtypes) + f", `{out_col}` {out_type}"
    return src.mapInPandas(run, schema)


def apply_per_repo(df: DataFrame, fn: Callable[..., Iterable[dict]], schema: str, key: str = "repo_url",
                   *args) -> DataFrame:
    """``fn(key_value, frames, *args)`` for every repository; ``frames`` iterates pandas batches."""
    out_cols = T.StructType.fromDDL(schema).names

    def run(keys: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk: list = []
        for rec in fn(keys[0], frames, *args):  # output streams out in bounded chunks
            chunk.append(rec)
            if len(chunk) >= OUTPUT_CHUNK_ROWS:
                yield pd.DataFrame(chunk, columns=out_cols)
                chunk = []
        if chunk:
            yield pd.DataFrame(chunk, columns=out_cols)

    return df.groupBy(key).applyInPandas(run, schema)


STATUS = T.StructType().add("status", "string").add("error", "string").add("n_rows", "long")


def _one_pass(df: DataFrame, fn: Callable[..., Iterable[dict]], schema: T.StructType, key: str, args: tuple, keep: bool) -> DataFrame:
    """(key, record columns, status columns): the records of each repository, then its status row."""
    key_type = df.schema[key].dataType
    names = [f"_{f.name}" for f in schema] if keep else []
    out = T.StructType([T.StructField("_key", key_type), *[T.StructField(f"_{f.name}", f.dataType) for f in schema if keep], *STATUS])

    def run(keys: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, status, err, chunk = 0, "ok", None, []

        def frame(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame([{"_key": keys[0], **r} for r in rows], columns=out.names).astype(object)

        try:
            for rec in fn(keys[0], frames, *args):
                n += 1
                if keep:
                    chunk.append({f"_{k}": v for k, v in rec.items() if f"_{k}" in names})
                if len(chunk) >= OUTPUT_CHUNK_ROWS:
                    full, chunk = frame(chunk), []
                    yield full
        except Exception as e:  # noqa: BLE001 - isolation is the feature
            status, err = "failed", f"{type(e).__name__}: {e}"
        yield frame([*chunk, {"status": status, "error": err, "n_rows": n}])

    return df.groupBy(key).applyInPandas(run, out)


def apply_isolated(df: DataFrame, fn: Callable[..., Iterable[dict]], schema: str, key: str = "repo_url", *args) -> tuple[DataFrame, DataFrame]:
    """(records, status) of ``fn(key_value, frames, *args)`` per repository; ``fn`` runs once.

    A repository whose ``fn`` fails keeps the records it gave before; its status row has ``failed``, the error
    and their number.  Records are the columns of ``schema``; status rows are (key, status, error, n_rows).
    """
    fields = T.StructType.fromDDL(schema)
    both = materialise(_one_pass(df, fn, fields, key, args, True), "isolated")
    records = both.where("status IS NULL").select(*[F.col(f"_{f.name}").alias(f.name) for f in fields])
    return records, both.where("status IS NOT NULL").select(F.col("_key").alias(key), *STATUS.names)


def apply_status(df: DataFrame, fn: Callable[..., Iterable[dict]], key: str = "repo_url", *args) -> DataFrame:
    """One status row per repository: ``ok`` or ``failed`` with the error text, and the number of records
    ``fn`` produced (a failing repository never fails the job)."""
    return _one_pass(df, fn, T.StructType(), key, args, False).select(F.col("_key").alias(key), *STATUS.names)


def cogroup_apply(left: DataFrame, right: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                  schema: str, key: str = "repo_url") -> DataFrame:
    """``fn(left_rows, right_rows)`` per repository present in either input.

    The rows of ``left`` are counted first (nothing but their number is read), so that no task sorts more than its share of them,
    unless a repository has more."""
    # fresh attribute ids, so both sides may derive from the same frame
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    left = left.repartition(row_partitions(left, left.count()), key)
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(fn, schema)
