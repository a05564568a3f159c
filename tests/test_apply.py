"""Per-repository user functions and failure isolation."""

from commitlens.operators.apply import apply_per_repo, apply_status


def summary(repo, frames):
    n = sum(len(f) for f in frames)
    if repo == "bad":
        raise KeyError("missing object")
    yield {"repo_url": repo, "n": n}


def test_apply_per_repo_and_status(spark):
    df = spark.createDataFrame([("good", 1), ("good", 2), ("bad", 3)], "repo_url string, v long")
    ok = apply_per_repo(df.where("repo_url = 'good'"), summary, "repo_url string, n long")
    assert [(r.repo_url, r.n) for r in ok.collect()] == [("good", 2)]
    st = {r.repo_url: (r.status, r.error, r.n_rows) for r in apply_status(df, summary).collect()}
    assert st["good"] == ("ok", None, 1)
    assert st["bad"][0] == "failed" and "KeyError" in st["bad"][1]
