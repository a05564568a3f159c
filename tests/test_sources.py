"""Git log exports, JSON-lines records and star lists."""

from pyspark.sql import functions as F

import pytest

from commitlens.session import scratch_path
from commitlens.sources.history import read_git_log
from commitlens.sources.jsonl import read_record_lines, write_record_lines
from commitlens.sources.star_list import read_star_list

Z = "0" * 40
A1, A2, B1, M1 = "a" * 40, "b" * 40, "c" * 40, "d" * 40

LOG = (
    f"\x1e{'3' * 40}\x1f{'2' * 40} {'9' * 40}\x1fAnn <ann@x>\x1f1700000300\n\n"
    f"::100644 100644 100644 {A1} {B1} {M1} MM\tsrc/app.py\n"
    f"\x1e{'2' * 40}\x1f{'1' * 40}\x1fBob <bob@y>\x1f1700000200\n\n"
    f":100644 100644 {A1} {A2} M\tsrc/app.py\n"
    f":100644 000000 {B1} {Z} D\tdocs/old name.md\n"
    f"\x1e{'1' * 40}\x1f\x1fAnn <ann@x>\x1f1700000100\n\n"
    f":000000 100644 {Z} {A1} A\tsrc/app.py\n"
)


def test_git_log(spark, tmp_path):
    p = tmp_path / "myrepo.log"
    p.write_text(LOG)
    rows = read_git_log(spark, str(p)).orderBy("commit_time", "change_index", "parent_index").collect()
    got = [(r.commit_id[0], r.status, r.file_path, r.old_blob_id, r.new_blob_id, r.parent_index) for r in rows]
    assert got == [
        ("1", "A", "src/app.py", None, A1, 0),
        ("2", "M", "src/app.py", A1, A2, 0),
        ("2", "D", "docs/old name.md", B1, None, 0),
        ("3", "MM", "src/app.py", A1, M1, 0),
        ("3", "MM", "src/app.py", B1, M1, 1),
    ]
    assert {r.repo_url for r in rows} == {"myrepo"}
    assert rows[0].author_raw == "Ann <ann@x>"


def test_record_lines_round_trip_and_chunking(spark):
    df = spark.range(0, 2500).selectExpr("CASE WHEN id < 2000 THEN 'hot' ELSE 'cold' END AS repo_url", "CAST(id AS STRING) AS x")
    path = scratch_path(spark, "jsonl-test")
    write_record_lines(df, path, max_records=300)
    sizes = [r.value.count('"x"') for r in spark.read.text(path).collect()]
    assert max(sizes) <= 300 and len(sizes) >= 2000 // 300 + 1 and sum(sizes) == 2500  # hot: several lines
    equal = spark.range(0, 2500).selectExpr("'r' AS repo_url", "'same' AS x")
    path2 = scratch_path(spark, "jsonl-equal")
    write_record_lines(equal, path2, max_records=1000)
    assert max(r.value.count('"x"') for r in spark.read.text(path2).collect()) <= 1000
    path3 = scratch_path(spark, "jsonl-whole")
    write_record_lines(equal, path3)
    assert spark.read.text(path3).count() == 1  # a repository within the bound is one line
    back = read_record_lines(spark, path, "repo_url string, x string")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_malformed_line_is_an_error(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    p.write_text('[{"repo_url": "a", "x": "1"}]\n[{"repo_url": "b", "x":\n')
    with pytest.raises(Exception, match="[Mm]alformed"):
        read_record_lines(spark, str(p), "repo_url string, x string").collect()


def test_star_list_strips_only_line_breaks(spark, tmp_path):
    p = tmp_path / "stars.txt"
    p.write_text("a/b\n c/d \n\nx/y\r\n")
    assert [r.repo_full_name for r in read_star_list(spark, str(p)).collect()] == ["a/b", " c/d ", "x/y"]


def test_blob_files(spark, tmp_path):
    from commitlens.functions.language import file_type
    from commitlens.sources.blobs import read_blob_files
    (tmp_path / "abc123.blob").write_bytes("print('hé')\n".encode())
    (tmp_path / "def456.blob").write_bytes(b"\x89PNG\x00\x01")
    df = read_blob_files(spark, str(tmp_path))
    got = {r.blob_id: (r.text, r.t) for r in df.select("blob_id", "text", file_type(F.lit("x.py"), binary="content").alias("t")).collect()}
    assert got["abc123"] == ("print('hé')\n", "Text")
    assert got["def456"][1] == "Binary"


def test_batches_append_and_resume(spark):
    from commitlens.operators.batching import batch_assign, resume_from_batch, write_batches
    items = spark.range(0, 25).withColumnRenamed("id", "v")
    b = batch_assign(items, 10, (("v", True),))
    path = scratch_path(spark, "batches-test")
    write_batches(resume_from_batch(b, 1), path)
    back = spark.read.parquet(path)
    assert sorted(r.batch_id for r in back.select("batch_id").distinct().collect()) == [1, 2]
    assert back.count() == 15


def _git(cwd, *args, env=None):
    import subprocess
    return subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True, env=env).stdout


def test_git_log_from_real_git(spark, tmp_path):
    import os
    import shutil
    import pytest
    if shutil.which("git") is None:
        pytest.skip("git not installed")
    repo = tmp_path / "demo"
    repo.mkdir()
    env = dict(os.environ, GIT_AUTHOR_NAME="Ann Lee", GIT_AUTHOR_EMAIL="ann@x.org", GIT_COMMITTER_NAME="Ann Lee",
               GIT_COMMITTER_EMAIL="ann@x.org", GIT_CONFIG_GLOBAL="/dev/null", GIT_CONFIG_SYSTEM="/dev/null")
    _git(repo, "init", "-q", "-b", "main", env=env)

    def commit(msg, when):
        e = dict(env, GIT_AUTHOR_DATE=f"{when} +0000", GIT_COMMITTER_DATE=f"{when} +0000")
        _git(repo, "add", "-A", env=e)
        _git(repo, "commit", "-q", "-m", msg, env=e)

    (repo / "app.py").write_text("x = 1\n")
    (repo / "old name.md").write_text("hello\n")
    (repo / "m.txt").write_text("a\nb\nc\nd\ne\n")
    (repo / 'we"ird\\name\t.txt').write_text("odd\n")
    commit("one", 1700000100)
    (repo / "app.py").write_text("x = 2\n")
    commit("two", 1700000200)
    _git(repo, "checkout", "-q", "-b", "side", env=env)
    (repo / "app.py").write_text("x = 3\n")
    (repo / "m.txt").write_text("a\nb\nc\nd\nE\n")
    commit("side", 1700000300)
    _git(repo, "checkout", "-q", "main", env=env)
    (repo / "m.txt").write_text("A\nb\nc\nd\ne\n")
    (repo / "old name.md").unlink()
    (repo / "lib.js").write_text("let k = 1;\n")
    commit("three", 1700000400)
    e = dict(env, GIT_AUTHOR_DATE="1700000500 +0000", GIT_COMMITTER_DATE="1700000500 +0000")
    _git(repo, "merge", "-q", "--no-ff", "-m", "merge", "side", env=e)
    (repo / "app.py").write_text("x = 4\n")
    commit("resolve", 1700000600)
    log = _git(repo, "-c", "core.quotePath=false", "log", "-c", "--raw", "--no-abbrev", "--no-renames", "--root",
               "--format=%x1e%H%x1f%P%x1f%an <%ae>%x1f%ct", env=env)
    out = tmp_path / "demo.log"
    out.write_text(log)
    rows = read_git_log(spark, str(out)).collect()
    by = {(r.status, r.file_path) for r in rows}
    assert ("D", "old name.md") in by and ("A", "lib.js") in by and ("A", "old name.md") in by
    assert {r.author_raw for r in rows} == {"Ann Lee <ann@x.org>"}
    assert ("A", 'we"ird\\name\t.txt') in by  # git quotes this path; the reader unquotes it
    assert {r.repo_url for r in rows} == {"demo"}
    adds = [r for r in rows if r.file_path == "app.py" and r.status == "A"]
    assert len(adds) == 1 and adds[0].old_blob_id is None
    # the merge changed m.txt against both parents: one row per parent, same new blob
    merged = [r for r in rows if r.file_path == "m.txt" and r.status == "MM"]
    assert sorted(r.parent_index for r in merged) == [0, 1] and len({r.new_blob_id for r in merged}) == 1
    assert len({r.old_blob_id for r in merged}) == 2
    # every modification's old id is the previous version's new id
    new_ids = {r.new_blob_id for r in rows if r.new_blob_id}
    assert all(r.old_blob_id in new_ids for r in rows if r.old_blob_id)


def test_record_lines_skip_empty_arrays(spark, tmp_path):
    p = tmp_path / "records.jsonl"
    p.write_text('[{"repo_url": "r", "x": "1"}, {"repo_url": "r", "x": "2"}]\n[]\n\n[{"repo_url": "q", "x": "3"}]\n')
    rows = sorted((r.repo_url, r.x) for r in read_record_lines(spark, str(p), "repo_url string, x string").collect())
    assert rows == [("q", "3"), ("r", "1"), ("r", "2")]


def test_merge_log_has_one_file_a_repository(spark, tmp_path, monkeypatch):
    from commitlens.checks import history
    rows = [(f"https://x/o/r{k % 2}", f"c{k}", "A <a@x>", "2024-01-01", k, i, f"b{k}-{i}", f"p{i}.py") for k in range(40) for i in range(2)]
    changes = spark.createDataFrame(rows, "repo_url string, commit_id string, author_raw string, commit_time string, o int, n int, new_blob_id string, file_path string")
    monkeypatch.setattr(history, "changes_view", lambda *_: changes)
    monkeypatch.setattr(history, "scratch_path", lambda *_: str(tmp_path / "log"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with large tables
    try:
        got = history.git_log_merges(spark, "").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 160 and {(r.repo_url, r.commit_id) for r in got} == {(r[0], r[1]) for r in rows}
    assert len(list((tmp_path / "log").rglob("part-*"))) == 2


def test_fixture_texts_are_made_after_the_keys_are_told_apart(spark):
    from commitlens.sources.fixtures import CHANGES_SQL, blobs_view, changes_view
    from commitlens.sources.tables import load_table
    sf = "/root/testdata/sf0.001"
    plan = blobs_view(spark, sf, materialise=False)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line.split("], [")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert grouped and all("import" not in keys for keys in grouped)
    want = spark.sql(CHANGES_SQL, **{t: load_table(spark, sf, t) for t in ("lineitem", "orders", "customer")})
    got = changes_view(spark, sf)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_blob_files_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from commitlens.sources import blobs as module
    seen = []
    monkeypatch.setattr(module, "spread", lambda df, *keys: seen.append(keys) or df.repartition(8, *keys))
    one = spark.createDataFrame([(f"b{i}", bytearray(b"x")) for i in range(40)] + [(None, bytearray(b"y"))], "blob_id string, content binary").coalesce(1)
    assert module.write_blob_files(one, str(tmp_path / "blobs")) == 40
    assert seen == [("blob_id",)] and len(list((tmp_path / "blobs").iterdir())) == 40


def test_blob_files_are_not_listed_by_the_driver(spark, tmp_path):
    from commitlens.sources.blobs import read_blob_files
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "_left").mkdir()
    for i in range(30):
        (tmp_path / ("a" if i % 2 else "a/b") / f"b{i}.blob").write_bytes(b"x" * (i + 1))
    for hidden in ("_left/b90.blob", "a/.b91.blob", "a/_b92.blob", "a/b93.blob._COPYING_"):
        (tmp_path / hidden).write_bytes(b"y")
    (tmp_path / "a" / "b94.blob").write_bytes(b"")
    (tmp_path / "a" / "b95.txt").write_bytes(b"z")
    want = {f"b{i}": i + 1 for i in range(30)}
    df = read_blob_files(spark, str(tmp_path), glob="*.{blob,bin}", empty_ids=["none"])
    assert {r.blob_id: len(r.content) for r in df.collect()} == want | {"none": 0}
    assert {r.blob_id: len(r.content) for r in read_blob_files(spark, str(tmp_path / "a*")).collect()} == want | {"b95": 1}
    assert df.inputFiles() == []  # a file source holds the list of its files on the driver
    with pytest.raises(FileNotFoundError):
        read_blob_files(spark, str(tmp_path / "nowhere"))
