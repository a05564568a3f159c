"""availableNow incremental processing: each input file is processed exactly once across runs."""

from commitlens.session import scratch_path
from commitlens.streaming.incremental import append_to_table, process_available


def test_incremental_runs(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("inc-src", "inc-sink", "inc-ckpt"))
    schema = "repo_full_name string"
    spark.createDataFrame([("a/b",), ("c/d",)], schema).write.parquet(f"{src}/part=1")
    assert process_available(spark, src, schema, ckpt, append_to_table(sink)) == 1
    assert process_available(spark, src, schema, ckpt, append_to_table(sink)) == 0  # nothing new: no batch
    spark.createDataFrame([("a/b",)], schema).write.parquet(f"{src}/part=2")
    assert process_available(spark, src, schema, ckpt, append_to_table(sink)) == 1
    rows = sorted((r.repo_full_name, r.batch_id) for r in spark.read.parquet(sink).collect())
    assert [r[0] for r in rows] == ["a/b", "a/b", "c/d"]
    assert len({r[1] for r in rows}) == 2
