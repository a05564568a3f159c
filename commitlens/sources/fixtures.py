"""Code-history views derived from the driver's order tables (see FIXTURES.md).

repository = supplier, commit = order, author = customer, changed file = line item,
star = (customer, part).  The same SELECT bodies feed Spark (``spark.sql`` with
DataFrame arguments) and the DuckDB oracle (plain table names), so both engines
see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.parallel import row_partitions
from ..session import scratch_path
from .tables import load_table

STARS_SQL = """
SELECT o_custkey AS user_id,
       concat('org', CAST(l_partkey % 50 AS STRING), '/repo', CAST(l_partkey AS STRING)) AS repo_full_name,
       o_orderdate AS starred_at, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

CHANGES_COLUMNS = """
SELECT concat('https://github.com/org', CAST(l_suppkey % 7 AS STRING), '/repo', CAST(l_suppkey AS STRING)) AS repo_url,
       CAST(l_orderkey AS STRING) AS commit_id, o_orderdate AS commit_time,
       concat(c_name, ' <', lower(c_mktsegment), '.', CAST(c_custkey AS STRING), '@example.org>') AS author_raw,
       concat('src/d', CAST(l_partkey % 4 AS STRING), '/f', CAST(l_partkey % 40 AS STRING),
              CASE l_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.js' WHEN 3 THEN '.ipynb' ELSE '.bin' END) AS file_path,
       CASE WHEN l_returnflag = 'R' THEN NULL
            ELSE concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS new_blob_id,
       l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_orderkey AS o
"""

CHANGES_SQL = CHANGES_COLUMNS + """FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
"""

# the same rows, moved as little as can be: customers meet the orders, which are fewer than the line items, and line items are
# dealt by order before their long texts are made
CHANGES_BY_ORDER_SQL = CHANGES_COLUMNS + """FROM {lineitem} JOIN (
  SELECT o_orderkey, o_orderdate, c_name, c_mktsegment, c_custkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS authors ON l_orderkey = o_orderkey
"""

BLOB_TEXT_EXPR = """
  CASE p % 5
  WHEN 0 THEN concat('import os.path', chr(10), 'import numpy as np', chr(10), 'from pkg', CAST(p % 7 AS STRING), ' import name', CAST(n AS STRING), ', other as o', chr(10),
    'class C', CAST(p % 7 AS STRING), ':', chr(10), '    def m', CAST(n AS STRING), '(self, x, y=1):', chr(10),
    '        v', CAST(s % 11 AS STRING), ' = fn', CAST(n AS STRING), '(x)  # w = 1', chr(10), '        v', CAST(s % 11 AS STRING), ' += 1', chr(10), '        self.q = 2', chr(10))
  WHEN 1 THEN concat('package org.p', CAST(p % 7 AS STRING), ';', chr(10), 'import java.util.List;', chr(10), 'import java.io.*;', chr(10),
    'public class J', CAST(p % 7 AS STRING), ' {', chr(10), '  private int f', CAST(n AS STRING), ' = 0, g = 1;', chr(10),
    '  J', CAST(p % 7 AS STRING), '(int z) { int loc = 1; }', chr(10), '  int run', CAST(s % 11 AS STRING), '(String s', CAST(n AS STRING), ', int n) { int t = n; return t; }', chr(10), '}', chr(10))
  WHEN 2 THEN concat('import React from ', chr(39), 'react', chr(39), ';', chr(10), 'import * as ns', CAST(p % 7 AS STRING), ' from "lib', CAST(p % 7 AS STRING), '";', chr(10),
    'import {p', CAST(n AS STRING), ', q as r', CAST(n AS STRING), '} from ', chr(39), 'mod', chr(39), ';', chr(10),
    'var u', CAST(s % 11 AS STRING), ' = w;', chr(10), 'let k = 1;', chr(10), 'function go', CAST(p % 7 AS STRING), '(arg) { k = u', CAST(s % 11 AS STRING), '; }', chr(10),
    'class K', CAST(n AS STRING), ' { meth() {} }', chr(10), 'import(', chr(39), 'dyn', CAST(s % 11 AS STRING), chr(39), ').then((mm) => { k; });', chr(10), 'obj.prop', CAST(p % 7 AS STRING), ';', chr(10))
  ELSE concat('text ', CAST(n AS STRING), chr(10)) END"""

# the id as CHANGES_COLUMNS gives it, from the same keys
BLOB_ID_EXPR = "concat(CAST(o AS STRING), '-', CAST(p AS STRING), '-', CAST(s AS STRING), '-', CAST(n AS STRING))"

BLOB_COLUMNS = ("new_blob_id AS blob_id", "p % 7 AS a", "n AS b", "s % 11 AS c", BLOB_TEXT_EXPR + " AS text")

# a blob id names one content: lines that share all four keys give one blob
BLOBS_SQL = "SELECT DISTINCT " + ",\n".join(BLOB_COLUMNS) + "\nFROM v_changes WHERE new_blob_id IS NOT NULL"


BASE_TABLES = ("lineitem", "orders", "customer")


def oracle_ctes(*views: str) -> str:
    """``WITH`` clause defining the requested fixture views over the base tables (DuckDB side)."""
    bodies = {
        "v_stars": STARS_SQL.format(lineitem="lineitem", orders="orders"),
        "v_changes": CHANGES_SQL.format(lineitem="lineitem", orders="orders", customer="customer"),
        "v_blobs": BLOBS_SQL,
    }
    needed = list(views)
    if "v_blobs" in needed and "v_changes" not in needed:
        needed.insert(0, "v_changes")
    order = [v for v in ("v_stars", "v_changes", "v_blobs") if v in needed]
    return "WITH " + ",\n".join(f"{v} AS ({bodies[v]})" for v in order)


# Derived input tables written once per (application, scale directory, view); every later
# query starts from plain scans of them, as it would from real history tables.
_MATERIALISED: dict[tuple[str, str, str], str] = {}


def materialised(spark: SparkSession, sf_dir: str, name: str, build, key_col: str | None = None) -> DataFrame:
    """``build()`` written once as parquet under the shared checkpoint folder, then read back.

    Rows are hash-partitioned on ``key_col`` (no sort, unlike a round-robin split) so the
    table is written as, and later read from, many files; without it ``build()`` has dealt them already."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    path = _MATERIALISED.get(key)
    if path is None:
        path = scratch_path(spark, f"view-{name}")
        parts = max(1, spark.sparkContext.defaultParallelism)  # one file per core reads in parallel
        (build() if key_col is None else build().repartition(parts, key_col)).write.parquet(path, compression="zstd")
        _MATERIALISED[key] = path
    return spark.read.parquet(path)


def stars_view(spark: SparkSession, sf_dir: str, materialise: bool = True) -> DataFrame:
    def build():
        return spark.sql(STARS_SQL, lineitem=load_table(spark, sf_dir, "lineitem"),
                         orders=load_table(spark, sf_dir, "orders"))
    return materialised(spark, sf_dir, "stars", build, "k1") if materialise else build()


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return spark.sql(
        CHANGES_BY_ORDER_SQL,
        lineitem=lines.repartition(row_partitions(lines, lines.count()), "l_orderkey"),
        orders=load_table(spark, sf_dir, "orders"),
        customer=load_table(spark, sf_dir, "customer"),
    )


def changes_view(spark: SparkSession, sf_dir: str, materialise: bool = True) -> DataFrame:
    return materialised(spark, sf_dir, "changes", lambda: _changes(spark, sf_dir)) if materialise \
        else _changes(spark, sf_dir)


def blobs_view(spark: SparkSession, sf_dir: str, changes: DataFrame | None = None,
               materialise: bool = True) -> DataFrame:
    def build():
        if materialise:
            c = changes_view(spark, sf_dir)  # the written changes table
        else:
            c = changes if changes is not None else _changes(spark, sf_dir)
        # an id is made of the four keys (null if one of them is): rows are told apart by these numbers, which take less room
        # than ids, and ids and texts are made where they are written
        keys = c.where("new_blob_id IS NOT NULL").select("o", "p", "s", "n").distinct()
        return keys.selectExpr(BLOB_ID_EXPR + " AS new_blob_id", "p", "s", "n").selectExpr(*BLOB_COLUMNS)
    return materialised(spark, sf_dir, "blobs", build) if materialise else build()


# Walk order of the fixture history: newest commit first, a total order per repository.
FIXTURE_WALK_ORDER = (("commit_time", False), ("o", False), ("n", True), ("p", True))
# Chronological order of fixture stars (oldest first), a total order per user.
FIXTURE_STAR_ORDER = ("starred_at", "k1", "k2", "k3", "k4")
