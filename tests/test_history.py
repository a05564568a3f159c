"""History semantics on a hand-made repository (walk order, W1-W3, W7, Q2/Q3 rules)."""

import datetime as dt

from pyspark.sql import functions as F

from commitlens.operators.history import first_n_changes, latest_file_version, version_pairs
from commitlens.operators.symbols import latest_symbols
from commitlens.plans.commit_info import commit_records

WALK = (("commit_time", False), ("walk_index", True), ("change_index", True))
COMMIT_ORDER = (("commit_time", False), ("walk_index", True))


def t(h):
    return dt.datetime(2024, 1, 1, h)


def history(spark):
    # newest first: c4 (deletes a.py), c3 (no changes), c2 (a.py as text, b.py), c1 (adds a.py, notes.txt)
    changes = [
        ("r", "c4", "Dee <d@x>", t(4), 0, 0, "a.py", None),
        ("r", "c2", "Bo <b@x>", t(2), 2, 0, "a.py", "a2"),
        ("r", "c2", "Bo <b@x>", t(2), 2, 1, "b.py", "b1"),
        ("r", "c1", "Al <a@x>", t(1), 3, 0, "a.py", "a1"),
        ("r", "c1", "Al <a@x>", t(1), 3, 1, "notes.txt", "n1"),
    ]
    ch = spark.createDataFrame(changes, "repo_url string, commit_id string, author_raw string, commit_time timestamp, "
                                        "walk_index long, change_index long, file_path string, new_blob_id string")
    blobs = spark.createDataFrame([
        ("a1", "import os\nx = 1\n"), ("a2", "import os\nimport sys\nx = 2\ny = len(x)\n"),
        ("b1", "import re\nz = re.compile('a')\n"), ("n1", "hello\n"),
    ], "blob_id string, text string")
    commits = spark.createDataFrame([
        ("r", "c4", t(4), 0), ("r", "c3", t(3), 1), ("r", "c2", t(2), 2), ("r", "c1", t(1), 3),
    ], "repo_url string, commit_id string, commit_time timestamp, walk_index long")
    return ch, blobs, commits


def test_version_pairs_and_latest(spark):
    ch, _, _ = history(spark)
    vp = {(r.commit_id, r.file_path): r.old_blob_id for r in version_pairs(ch, WALK).collect()}
    assert vp[("c2", "a.py")] == "a1" and vp[("c4", "a.py")] == "a2" and vp[("c1", "a.py")] is None
    latest = {r.file_path: r.new_blob_id for r in latest_file_version(ch, WALK).collect()}
    assert latest == {"a.py": "a2", "b.py": "b1", "notes.txt": "n1"}  # the deletion is not a version
    assert [r.commit_id for r in first_n_changes(ch, 2, WALK).orderBy(F.col("commit_time").desc()).collect()] == ["c4", "c2"]


def test_commit_records(spark):
    ch, blobs, _ = history(spark)
    recs = {(r.commit_id, r.file_path): r for r in commit_records(ch, blobs, order=WALK, limit=-1).collect()}
    assert set(recs) == {("c2", "a.py"), ("c2", "b.py"), ("c1", "a.py"), ("c1", "notes.txt")}
    a2 = recs[("c2", "a.py")]
    assert (a2.added_lines_num, a2.deleted_lines_num) == (3, 1)
    assert (a2.author_name, a2.author_email, a2.programming_language) == ("Bo", "b@x", "python")
    assert recs[("c1", "notes.txt")].programming_language == "text"
    # limit counts emitted records, newest first
    limited = commit_records(ch, blobs, order=WALK, limit=1).collect()
    assert [(r.commit_id, r.file_path) for r in limited] == [("c2", "a.py")]


def test_newest_commits_rank_the_commit_table(spark):
    ch, blobs, commits = history(spark)
    # two newest commits: by the commits table c4 and c3 (no changes) -> a.py deleted, nothing parsed
    got = latest_symbols(ch, blobs, order=WALK, commit_order=COMMIT_ORDER, commit_limit=2, commits=commits)
    assert got.count() == 0
    # derived from changes only, the two newest are c4 and c2 -> a.py (a2) and b.py
    got = {r.file_path: (r.blob_id, sorted(r.imports)) for r in
           latest_symbols(ch, blobs, order=WALK, commit_order=COMMIT_ORDER, commit_limit=2).collect()}
    assert got == {"a.py": ("a2", ["len", "os", "sys"]), "b.py": ("b1", ["re"])}


def test_commit_records_options(spark):
    ch, blobs, _ = history(spark)
    seq = {(r.commit_id, r.file_path): (r.added_lines_num, r.deleted_lines_num)
           for r in commit_records(ch, blobs, order=WALK, limit=-1, diff="ordered").collect()}
    assert seq[("c2", "a.py")] == (3, 1) and seq[("c1", "a.py")] == (2, 0)
    # the restriction (added <= n, as documented) is applied before the per-repository limit
    kept = commit_records(ch, blobs, order=WALK, limit=1, max_added=1).collect()
    assert [(r.commit_id, r.file_path) for r in kept] == [("c1", "notes.txt")]


def test_user_extractor(spark):
    from commitlens.operators.symbols import extract_symbols
    _, blobs, _ = history(spark)
    files = spark.createDataFrame([("a2", "python"), ("b1", "python")], "blob_id string, programming_language string")

    def words(language, text):
        return {"imports": [w for w in text.split() if w.isalpha()], "variables": []}

    got = {r.blob_id: list(r.imports) for r in extract_symbols(files, blobs, extractor=words).collect()}
    assert got == {"a2": ["import", "os", "sys", "x", "y"], "b1": ["import", "re", "z"]}
