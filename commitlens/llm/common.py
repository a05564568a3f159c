"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_path
from ..sources.tables import load_table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to a fresh folder under spark.checkpoint.dir and read it back."""
    path = scratch_path(df.sparkSession, f"llm_{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def tasks(df: DataFrame) -> int:
    """Partition count for CPU-bound steps on narrow rows (follows the session's shuffle setting)."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space characters (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """With doc_id, the identity of a row: rows that agree in both are repeats."""
    return F.xxhash64(text)


def all_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs``, with all their columns, whose (doc_id, text key) is in ``kept(_id, _key)``; repeated rows stay repeated."""
    named = kept.select(F.col("_id").alias("_llm_id"), F.col("_key").alias("_llm_key"))
    marked = docs.withColumn("_llm_row", text_key(F.col(text_col)))
    found = marked.join(named, same(F.col(id_col), F.col("_llm_id")) & (F.col("_llm_row") == F.col("_llm_key")), "left_semi")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: str | None = None,
              source_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose (doc_id, text key) is in ``kept(_id, _key)``; one of each,
    or as many of each as the column ``times`` of ``kept`` says.  The pairs of ``kept`` are distinct.  With ``source_col``
    the source is part of the identity, and ``kept`` has it as ``_source``.

    The ranking shares the join's partitioning, and only the first row of each key is ever kept back.
    """
    source = [F.col("_source").alias("_llm_source")] if source_col else []
    named = kept.select(F.col("_id").alias("_llm_id"), F.col("_key").alias("_llm_key"), *source, *([F.col(times).alias("_llm_times")] if times else []))
    marked, key = docs.withColumn("_llm_row", text_key(F.col(text_col))), [id_col, "_llm_row"]
    met = same(F.col(id_col), F.col("_llm_id")) & (F.col("_llm_row") == F.col("_llm_key"))
    if source_col:
        marked, key = marked.withColumn("_llm_from", F.col(source_col).cast("string")), [*key, "_llm_from"]
        met = met & same(F.col("_llm_from"), F.col("_llm_source"))
    found = marked.join(named, met, "inner" if times else "left_semi")
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != text_col and "map<" not in kind]
    once = Window.partitionBy(*key).orderBy(F.xxhash64(*others))  # the same one in every run
    rows = found.withColumn("_llm_no", F.row_number().over(once)).filter("_llm_no = 1")
    if times:
        rows = rows.withColumn("_llm_no", F.explode(F.sequence(F.lit(1), F.col("_llm_times"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
