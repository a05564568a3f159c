"""The reference's own unit cases, re-expressed on DataFrames."""

import pandas as pd
import pytest

from commitlens.functions.language import detected_language, programming_language
from commitlens.operators.apply import map_rows
from commitlens.operators.batching import batch_assign, repo_prefix_match
from commitlens.operators.stars import top_repos
from commitlens.operators.churn import line_diff_counts, ordered_line_diff_counts

# Cases of the line counts that must come out alike
DIFF_CASES = [
    ("line1\nline2\nline3", "line1\nline3", 1, 0),
    ("line1\nline3", "line1\nline2\nline3", 0, 1),
    ("line1\nline3", "line1\nline2", 1, 1),
]


@pytest.mark.parametrize("form", ["set", "ordered"])
def test_line_diff_dataframe(spark, form):
    texts = []
    pairs = []
    for i, (old, new, _, _) in enumerate(DIFF_CASES):
        texts += [(f"o{i}", old), (f"n{i}", new)]
        pairs.append((f"n{i}", f"o{i}"))
    pairs.append(("n0", None))  # a new file: (line count, 0)
    t = spark.createDataFrame(texts, "blob_id string, text string")
    p = spark.createDataFrame(pairs, "new_blob_id string, old_blob_id string")
    fn = line_diff_counts if form == "set" else ordered_line_diff_counts
    got = {(r.new_blob_id, r.old_blob_id): (r.added_lines_num, r.deleted_lines_num) for r in fn(p, t).collect()}
    for i, (_, _, deleted, added) in enumerate(DIFF_CASES):
        assert got[(f"n{i}", f"o{i}")] == (added, deleted)
    assert got[("n0", None)] == (2, 0)


# Lines that a counter over a unified diff takes for file headers
MARKER_CASES = [("a\n- item\n", "a\n", 0, 1), ("x\n", "x\n++i;\n", 1, 0), ("-a\nb\nc\n", "b\nc\n-a\n", 1, 1), ("+a\nb\nc\n", "b\nc\n+a\n", 1, 1)]


def test_marker_lines_rule(spark):
    # a unified diff shows "- item" removed as "-- item": with the option it is not counted
    t = spark.createDataFrame([(f"{s}{i}", c[k]) for i, c in enumerate(MARKER_CASES) for k, s in enumerate("on")], "blob_id string, text string")
    p = spark.createDataFrame([(f"n{i}", f"o{i}") for i in range(len(MARKER_CASES))], "new_blob_id string, old_blob_id string")

    def got(skip):
        return [tuple(r)[2:] for r in ordered_line_diff_counts(p, t, skip_marker_lines=skip).orderBy("new_blob_id").collect()]

    assert got(False) == [c[2:] for c in MARKER_CASES]
    assert got(True) == [(0, 0), (0, 0), (1, 0), (0, 1)]


# Batch sizes that must come out alike
@pytest.mark.parametrize("n, size, expected", [(10, 3, [3, 3, 3, 1]), (9, 3, [3, 3, 3])])
def test_batches(spark, n, size, expected):
    df = spark.createDataFrame([(i,) for i in range(1, n + 1)], "v long")
    b = batch_assign(df, size, (("v", True),))
    rows = sorted((r.batch_id, r.v) for r in b.collect())
    sizes = pd.Series([r[0] for r in rows]).value_counts().sort_index().tolist()
    assert sizes == expected
    # batches hold consecutive elements, in order
    assert [v for _, v in rows] == list(range(1, n + 1))


# Language names that must come out alike
@pytest.mark.parametrize("path, language", [
    ("notebooks/plots.ipynb", "jupyter notebook"),
    ("src/main/App.java", "java"),
    ("web/index.js", "javascript"),
    ("pkg/mod.py", "python"),
])
def test_file_language(spark, path, language):
    df = spark.createDataFrame([(path, "x = 1\n")], "path string, text string")
    r = df.select(detected_language("path", "text").alias("a"), programming_language("path", "text").alias("b")).first()
    assert r.a == language and r.b == language


def test_language_rules(spark):
    rows = [("bin/tool", "#!/usr/bin/env python3\nprint(1)\n"), ("vendor/lib/a.js", "x"), ("a.png", "x"),
            ("data.py", "ab\u0000cd"), ("Makefile", "all:\n"), ("README", "hello")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = [r.l for r in df.select(programming_language("path", "text").alias("l")).collect()]
    assert got == ["python", None, None, None, "makefile", None]


def cell_name(width, prefix, value):
    return f"{prefix}{value // width}"


def test_map_rows_bound_arguments(spark):
    src = spark.createDataFrame([(7 * i,) for i in range(40)], "c long")
    out = map_rows(src, cell_name, "c", "result", "string", index_col="idx", width=25, prefix="cell-", value=None)
    assert [r.result for r in out.orderBy("idx").collect()] == [f"cell-{7 * i // 25}" for i in range(40)]


def test_find_repository_by_name(spark):
    keys = spark.createDataFrame([("my_repo",)], "key string")
    entries = spark.createDataFrame([("my_repo",), ("my_repo_x1",), ("other",)], "entry string")
    got = sorted(r.entry for r in repo_prefix_match(keys, entries).collect())
    assert got == ["my_repo", "my_repo_x1"]


def test_top_repos_ties_by_first_seen(spark):
    rows = [(f"o/r{(i * 11) % 37}", i) for i in range(37 * 3)]  # every name has three stars
    df = spark.createDataFrame(rows, "repo_full_name string, seq long").repartition(3)
    assert [r.repo_full_name for r in top_repos(df, 5, seq_col="seq").collect()] == [f"o/r{i * 11 % 37}" for i in range(5)]
    assert [r.repo_full_name for r in top_repos(df, 3).collect()] == ["o/r0", "o/r1", "o/r10"]


def test_map_rows_skips_empty_elements(spark):
    src = spark.createDataFrame([("a",), ("",), (None,), ("bc",)], "s string")
    out = map_rows(src, lambda prefix, s: prefix + s, "s", "r", "string", prefix=">", s=None)
    assert sorted(r.r for r in out.collect()) == [">a", ">bc"]


def test_prefix_match_last_wins(spark):
    keys = spark.createDataFrame([("a_b",), ("zz",)], "key string")
    entries = spark.createDataFrame([("a_b_1",), ("a_b_2",), ("a_bc_9",), ("c",)], "entry string")
    got = {(r.key, r.entry) for r in repo_prefix_match(keys, entries, pick="last").collect()}
    assert got == {("a_b", "a_bc_9")}  # prefix mode also matches a_bc (the reference's quirk)
