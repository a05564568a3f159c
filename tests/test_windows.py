"""Skew-safe window helpers agree with plain single-partition windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from commitlens.operators.windows import first_n_per_group, global_row_number, lag_over_group


def skewed(spark, n=20000):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 30)}", i, rnd.randint(0, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, v long")


def test_lag_over_group(spark):
    df = skewed(spark)
    got = lag_over_group(df, ["k"], [("t", True)], ["v"], ["prev_v"])
    w = Window.partitionBy("k").orderBy("t")
    want = df.withColumn("prev_v", F.lag("v").over(w))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_global_row_number(spark):
    df = skewed(spark)
    got = global_row_number(df, [("k", True), ("t", False)], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("k"), F.col("t").desc())).cast("long"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_first_n_per_group_uses_partial_limit(spark):
    df = skewed(spark)
    out = first_n_per_group(df, ["k"], [("t", False)], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.groupBy("k").count().where("count > 3").count() == 0
    assert "WindowGroupLimit" in plan


def test_group_row_number_and_large_limits(spark):
    from commitlens.operators.windows import group_row_number
    df = skewed(spark)
    got = group_row_number(df, ["k"], [("t", False)], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("t").desc())))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    big = first_n_per_group(df, ["k"], [("t", False)], 5000)  # above the WindowGroupLimit threshold
    small = want.where("rn <= 5000").drop("rn")
    assert big.exceptAll(small).count() == 0 and small.exceptAll(big).count() == 0


def test_lag_of_many_small_groups_moves_rows_once(spark):
    rows = [(f"k{i % 500}" if i % 97 else None, i, i % 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = lag_over_group(df, ["k"], [("t", True)], ["v"], ["prev_v"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = df.withColumn("prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
