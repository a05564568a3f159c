"""Identity scalars and line splitting."""

import random

import pytest
from pyspark.sql import functions as F

from commitlens.functions.identity import (author_email, author_name, base_name, repo_slug, repo_url_from_name,
                                           stem, suffix)
from commitlens.functions.text import line_count, split_lines


@pytest.mark.parametrize("raw, name, email", [
    ("Ann Lee <ann@x.org>", "Ann Lee", "ann@x.org"),
    ("  Bob   <bob@y>", "Bob", "bob@y"),
    ("X <>", "X", ""),
    ("A <b> <c>", "A", "b> <c"),
    ("nobody", "nobody", None),
])
def test_author(spark, raw, name, email):
    r = spark.createDataFrame([(raw,)], "a string").select(author_name("a").alias("n"), author_email("a").alias("e")).first()
    assert (r.n, r.e) == (name, email)


def test_repo_and_path(spark):
    df = spark.createDataFrame([("https://github.com/apache/spark", "src/pkg/mod.tar.gz")], "u string, p string")
    r = df.select(repo_slug("u").alias("s"), repo_url_from_name(F.lit("a/b")).alias("u2"),
                  repo_url_from_name("u").alias("u3"), base_name("p").alias("b"), stem("p").alias("st"),
                  suffix("p").alias("sf")).first()
    assert r.s == "apache_spark"
    assert r.u2 == "https://github.com/a/b" and r.u3 == "https://github.com/apache/spark"
    assert (r.b, r.st, r.sf) == ("mod.tar.gz", "mod", "gz")


def test_split_lines_like_python(spark):
    rnd = random.Random(3)
    alphabet = ["a", "b", " ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "é"]
    texts = ["", "\n", "a", "a\n", "a\n\n", "\r\n"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))
                                                     for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: (list(r.l), r.n) for r in df.select("i", split_lines("t").alias("l"), line_count("t").alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t.splitlines(), len(t.splitlines())), repr(t)
