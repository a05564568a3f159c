"""Newest versions and counters by arrivals; as-of lookups; content decides a language."""

import random

import pytest
from pyspark.sql import functions as F

from commitlens.operators import parallel
from commitlens.operators.batching import repo_prefix_match
from commitlens.operators.content_language import candidates, decide, learn, tokens
from commitlens.operators.windows import as_of
from commitlens.session import scratch_path
from commitlens.streaming.incremental import process_available
from commitlens.streaming.newest import SymbolState

WALK = (("t", False), ("commit_id", True))
SCHEMA = "repo_url string, commit_id string, t int, file_path string, new_blob_id string"


def history(seed=5, n=60):
    rng = random.Random(seed)
    texts = {f"b{i}": f"import m{i % 7}\nv{i % 5} = f{i % 3}()\n" for i in range(20)}
    rows = [(f"r{rng.randrange(2)}", f"c{i}", rng.randrange(12), f"p{rng.randrange(6)}.py", rng.choice([*texts, None])) for i in range(n)]
    return rows, texts


def plain(rows, texts):
    newest, counts = {}, {}
    for repo, c, t, path, blob in sorted(rows, key=lambda r: (-r[2], r[1])):
        if blob is not None:
            newest.setdefault((repo, path), blob)
    for (repo, _), blob in newest.items():
        i = int(blob[1:])
        for kind, names in (("imports", {f"m{i % 7}", f"f{i % 3}"}), ("variables", {f"v{i % 5}"})):
            for name in names:
                counts[repo, kind, name] = counts.get((repo, kind, name), 0) + 1
    return newest, counts


def state_of(state):
    return ({(r.repo_url, r.file_path): r.blob_id for r in state.newest().collect()}, {(r.repo_url, r.kind, r.symbol): r.n_files for r in state.counts().collect()})


def test_a_stream_of_arrivals(spark):
    rows, texts = history()
    blobs = spark.createDataFrame(list(texts.items()), "blob_id string, text string")
    state = SymbolState(spark, scratch_path(spark, "state"), {"t": "int", "commit_id": "string"}, WALK, parts=3)
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    for upto, part in ((20, rows[:20]), (60, rows[20:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        process_available(spark, source, SCHEMA, checkpoint, state.handler(blobs))
        assert state_of(state) == plain(rows[:upto], texts)
    again = spark.createDataFrame(rows[5:30], SCHEMA)
    assert state.arrive(again, blobs, 1) is False  # committed already
    assert state.arrive(again, blobs, 7) is True and state_of(state) == plain(rows, texts)  # the same changes once more


def test_a_batch_that_was_not_committed_leaves_no_trace(spark, monkeypatch):
    rows, texts = history(9, 30)
    blobs = spark.createDataFrame(list(texts.items()), "blob_id string, text string")
    state = SymbolState(spark, scratch_path(spark, "state"), {"t": "int", "commit_id": "string"}, WALK, parts=2)
    state.arrive(spark.createDataFrame(rows[:15], SCHEMA), blobs, 0)
    write = SymbolState._write

    def dies(self, df, name, batch_id, touched):
        if name == "counts":
            raise RuntimeError("lost")
        return write(self, df, name, batch_id, touched)

    monkeypatch.setattr(SymbolState, "_write", dies)
    with pytest.raises(RuntimeError):
        state.arrive(spark.createDataFrame(rows[15:], SCHEMA), blobs, 1)
    assert state_of(state) == plain(rows[:15], texts)
    monkeypatch.setattr(SymbolState, "_write", write)
    assert state.arrive(spark.createDataFrame(rows[15:], SCHEMA), blobs, 1) and state_of(state) == plain(rows, texts)


@pytest.mark.parametrize("slices", [1, 7])
def test_as_of(spark, slices):
    rng = random.Random(2)
    right = [(rng.choice("aab"), rng.randrange(60), rng.choice((None, f"v{i}"))) for i in range(50)]
    right = list({r[:2]: r for r in right}.values())
    left = list({(rng.choice("aabc"), rng.randrange(60)) for _ in range(40)})
    got = as_of(spark.createDataFrame(left, "k string, t int").withColumn("x", F.lit(1)), spark.createDataFrame(right, "k string, t int, v string"), ["k"], [("t", True)], ["v"], slices=slices)
    want = []
    for k, t in left:
        before = [r for r in right if r[0] == k and r[1] < t]
        want.append((k, t, 1, max(before, key=lambda r: r[1])[2] if before else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_prefix_match_by_ranges(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    keys = {word(rng.randrange(1, 9)) for _ in range(60)} | {""}
    entries = {word(rng.randrange(0, 14)) for _ in range(200)} | {"é", "a\U0001F600"}
    df = lambda rows, name: spark.createDataFrame([(r,) for r in [*rows, None]], f"{name} string")
    got = sorted(tuple(r) for r in repo_prefix_match(df(keys, "key"), df(entries, "entry")).collect())
    assert got == sorted((k, e) for k in keys for e in entries if e.startswith(k))


def test_content_decides_open_extensions(spark):
    """Held-out files: all told apart; and the sums of a plain version."""
    rng = random.Random(7)
    make = {"c": lambda: f"#include <stdio.h>\nint f{rng.randrange(9)}(void) {{ return {rng.randrange(99)}; }}\n",
            "c++": lambda: f"#include <vector>\nnamespace n{rng.randrange(9)} {{ class K; std::vector<int> v; }}\n",
            "objective-c": lambda: f"#import <Foundation/F.h>\n@interface K{rng.randrange(9)} : NSObject\n@end\n"}
    files = [(f"{lang}{i}", lang, make[lang]()) for lang in make for i in range(30)]
    blobs = spark.createDataFrame([(b, t) for b, _, t in files] + [("odd", "zzz"), ("none", None)], "blob_id string, text string")
    known = spark.createDataFrame([(b, lang) for b, lang, _ in files if int(b[-1]) % 2], "blob_id string, programming_language string")
    held = spark.createDataFrame([(b, f"src/{b}.h") for b, _, _ in files if not int(b[-1]) % 2] + [("odd", "a.H"), ("lost", "b.h")], "blob_id string, path string")
    model = learn(known, blobs)
    out = decide(held.select("blob_id", candidates("path").alias("candidates")), blobs, model)
    got = {r.blob_id: r.language for r in out.collect()}
    assert got.pop("odd") == "c" and got.pop("lost") is None  # equal sums: the first name; no blob: no language
    assert got == {b: lang for b, lang, _ in files if not int(b[-1]) % 2}
    only = decide(held.limit(1).select("blob_id", F.array(F.lit("cobol"), F.lit("c++")).alias("candidates")), blobs, model).first()
    assert only.language == "c++"  # nothing is known of the other
    assert sorted(spark.range(1).select(tokens(F.lit("a1 12 a1 + 7")).alias("t")).first().t) == ["+", "0", "a1"]
    assert candidates is not None and spark.range(1).select(candidates(F.lit("x.py")).alias("c")).first().c is None


def contents(seed, n=70):
    """History whose newest versions may be binary or not there, and files whose content alone decides the language."""
    rng = random.Random(seed)
    texts = {f"b{i}": f"import m{i % 7}\nv{i % 5} = f{i % 3}()\n" for i in range(20)}
    texts |= {f"z{i}": "a\0b" for i in range(4)} | {f"s{i}": f"#!/usr/bin/env python3\nimport m{i}\n" for i in range(4)}
    names = ["p0.py", "p1.py", "run", "do.bin", "q.ipynb", "node_modules/v.py", "i.png"]
    blobs = [*texts, "lost", None]
    return [(rng.choice(("r0", "r1", None)), f"c{i}", rng.randrange(12), rng.choice(names), rng.choice(blobs)) for i in range(n)], texts


def expected(rows, texts):
    newest = {}
    for repo, c, t, path, blob in sorted(rows, key=lambda r: (-r[2], r[1])):
        text = texts.get(blob)
        if text is None or "\0" in text or path in ("q.ipynb", "node_modules/v.py", "i.png"):
            continue
        if path.endswith(".py") or text.startswith("#!"):
            newest.setdefault((repo, path), blob)
    return newest


@pytest.mark.parametrize("few", [50_000, 1])
def test_contents_decide_after_the_ranking(spark, monkeypatch, few):
    monkeypatch.setattr(parallel, "FEW_KEYS", few)
    rows, texts = contents(few)
    blobs = spark.createDataFrame(list(texts.items()), "blob_id string, text string")
    state = SymbolState(spark, scratch_path(spark, "state"), {"t": "int", "commit_id": "string"}, WALK, parts=3)
    for batch_id, upto in enumerate((25, 70)):
        state.arrive(spark.createDataFrame(rows[:upto], SCHEMA), blobs, batch_id)
        assert state_of(state)[0] == expected(rows[:upto], texts)


def test_only_the_newest_versions_are_looked_at(spark):
    rows = [("r", f"c{i}", i, "a.py", f"b{i}") for i in range(9)] + [("r", f"d{i}", i, "q.ipynb", f"n{i}") for i in range(3)]
    blobs = spark.createDataFrame([(r[4], "x = 1\n") for r in rows], "blob_id string, text string")
    state = SymbolState(spark, scratch_path(spark, "state"), {"t": "int", "commit_id": "string"}, WALK, parts=2)
    state.arrive(spark.createDataFrame(rows, SCHEMA), blobs, 0)
    assert state_of(state)[0] == {("r", "a.py"): "b8"}
    assert [r.blob_id for r in state.store._table("languages", "blob_id string").collect()] == ["b8"]


def test_tasks_that_write_a_part_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(parallel, "ROWS_PER_TASK", 10)
    rows = [("r", f"c{i}", i, f"p{i}.py", "b") for i in range(400)]
    blobs = spark.createDataFrame([("b", "x = 1\n")], "blob_id string, text string")
    state = SymbolState(spark, scratch_path(spark, "state"), {"t": "int", "commit_id": "string"}, WALK, parts=1)
    state.arrive(spark.createDataFrame(rows, SCHEMA), blobs, 0)
    assert state.newest().count() == 400 and len(state.newest().inputFiles()) > 8
    assert state_of(state)[1] == {("r", "variables", "x"): 400}
