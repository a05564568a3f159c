"""What keeps shuffles and spills in proportion: rows dealt to a number of tasks that grows with them, short pairs counted in one row."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from commitlens.operators import churn, parallel
from commitlens.operators.apply import cogroup_apply
from commitlens.operators.blob_store import BlobStore
from commitlens.operators.classify import Drops
from commitlens.operators.windows import as_of, lag_over_group
from commitlens.plans import commit_info
from commitlens.session import scratch_path
from commitlens.sources.fixtures import blobs_view, changes_view

from .conftest import SF_SMALL


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(parallel, "ROWS_PER_TASK", 10)


def _rows(spark):
    return spark.createDataFrame([(f"k{i % 50}", i, f"b{i}") for i in range(400)], "k string, t int, b string")


def test_lag_tasks_grow_with_rows(spark, few_rows):
    out = lag_over_group(_rows(spark), ["k"], [("t", True)], ["b"])
    assert out.rdd.getNumPartitions() >= 40
    assert {(r["t"], r["prev_b"]) for r in out.collect()} == {(i, f"b{i - 50}" if i >= 50 else None) for i in range(400)}


def test_as_of_tasks_grow_with_rows(spark, few_rows):
    rows = _rows(spark)
    out = as_of(rows.drop("b"), rows, ["k"], [("t", True)], ["b"], screen=False)
    assert out.rdd.getNumPartitions() >= 40
    assert {(r["t"], r["prev_b"]) for r in out.collect()} == {(i, f"b{i - 50}" if i >= 50 else None) for i in range(400)}


def test_cogroup_tasks_grow_with_rows(spark, few_rows):
    rows = _rows(spark)

    def both(left, right):
        key = left["k"].iloc[0] if len(left) else right["k"].iloc[0]
        return pd.DataFrame([{"k": key, "n": len(left), "m": len(right)}])

    out = cogroup_apply(rows.where("k <> 'k0'"), rows.where("k <> 'k1'").select("k").distinct(), both, "k string, n long, m long", "k")
    assert out.rdd.getNumPartitions() >= 39
    got = {r["k"]: (r["n"], r["m"]) for r in out.collect()}
    assert got == {f"k{i}": (0 if i == 0 else 8, 0 if i == 1 else 1) for i in range(50)}


@pytest.mark.parametrize("how", ["set", "ordered", "marked"])
def test_short_and_long_sides_count_alike(spark, monkeypatch, how):
    """One row a pair or one row a line: the same counts; ids that come twice, null texts, missing and empty sides as well."""
    rng = random.Random(5)
    text = {f"b{i}": "".join(f"{rng.choice(('', '+', '-'))}l{rng.randrange(12)}\n" for _ in range(rng.randrange(14))) for i in range(60)}
    rows = [*text.items(), ("none", None), ("b3", text["b3"])]
    names = [*text, "none", "gone", None]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(250)] + [("b1", "none"), ("none", "b2"), ("none", None), ("b3", "b4"), ("b5", "b3"), ("b6", "gone")]
    texts = spark.createDataFrame(rows, "blob_id string, text string")
    frame = spark.createDataFrame(pairs, "new_blob_id string, old_blob_id string")

    def counts():
        out = churn.line_diff_counts(frame, texts) if how == "set" else churn.ordered_line_diff_counts(frame, texts, skip_marker_lines=how == "marked")
        return sorted((r["new_blob_id"], r["old_blob_id"] or "", r[churn.ADDED] if r[churn.ADDED] is not None else -1, r[churn.DELETED]) for r in out.collect())

    found = {}
    for most in (500, 6, -1):
        monkeypatch.setattr(churn, "ROW_LINES", most)
        found[most] = counts()
    assert found[500] == found[6] == found[-1] and len(found[500]) > 150


def test_records_without_limit_do_not_look_for_old_objects(spark, monkeypatch):
    """Without a limit the diff drops records whose old object is not there, and they are counted there."""
    def no(*_):
        raise AssertionError("moved the records once more")

    monkeypatch.setattr(commit_info, "missing_side", no)
    rows = [("r", f"c{i}", "A <a@b>", "a.py", f"b{i}", i) for i in range(4)]
    changes = spark.createDataFrame(rows, "repo_url string, commit_id string, author_raw string, file_path string, new_blob_id string, t int")
    blobs = spark.createDataFrame([(f"b{i}", f"x = {i}\n") for i in (0, 2, 3)], "blob_id string, text string")
    drops = Drops()
    got = commit_info.commit_records(changes, blobs, order=(("t", False),), limit=None, drops=drops).collect()
    assert {(r["commit_id"], r[churn.ADDED], r[churn.DELETED]) for r in got} == {("c0", 1, 0), ("c3", 1, 1)}
    counts = drops.counts()
    assert (counts["changes"], counts["missing_object"], counts["missing_old_object"]) == (4, 1, 1)


def test_blob_rows_are_told_apart_by_numbers(spark):
    plan = blobs_view(spark, SF_SMALL, changes_view(spark, SF_SMALL, materialise=False), materialise=False)._jdf.queryExecution().toString()
    assert "hashpartitioning(new_blob_id" not in plan and "hashpartitioning(o#" in plan


@pytest.mark.parametrize("few", [50_000, 1])
def test_a_screen_keeps_every_row_that_is_asked_for(spark, monkeypatch, few):
    monkeypatch.setattr(parallel, "FEW_KEYS", few)
    rows = spark.range(60_000).selectExpr("concat('b', id % 30000) AS k", "id", "if(id % 7 = 0, null, 'x') AS j")
    asked = rows.where("id % 100 = 3").select("k", "j").distinct()
    want = {r["id"] for r in rows.where("id % 100 = 3").collect()}  # a null key is asked for like any other
    got = [r["id"] for r in parallel.screened(rows, asked, ["k", "j"]).collect()]
    assert want <= set(got) and len(got) == len(set(got)) and len(got) < 6_000
    one = parallel.screened(rows, asked, ["k", "j"]).join(asked, ["k", "j"])
    assert one.count() == rows.join(asked, ["k", "j"], "left_semi").count()


def test_known_blobs_and_texts_are_screened_where_they_lie(spark, monkeypatch):
    """What is moved for some blobs does not grow with all of them: nothing but the screen meets the whole table."""
    monkeypatch.setattr(parallel, "FEW_KEYS", 1)
    blobs = spark.range(3_000).selectExpr("concat('b', id) AS blob_id", "concat('v', id, ' = 1\n') AS text")
    store = BlobStore(spark, scratch_path(spark, "store"))
    for n in (1_000, 1_200):
        ids = blobs.where(f"CAST(substring(blob_id, 2) AS INT) < {n}").select("blob_id")
        facts = store.facts(blobs, ids, lines=False)
        assert facts.count() == n and "bitmap_construct_agg" in facts._jdf.queryExecution().optimizedPlan().toString().lower()
        files = ids.withColumn("programming_language", F.lit("python"))
        assert store.symbols(files, blobs).where("size(variables) = 1").count() == n
    assert store._table("languages", "blob_id string").count() == 1_200
