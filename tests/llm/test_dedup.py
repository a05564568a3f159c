"""Exact dedup (10) and SimHash near-dedup (8) against brute force."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from commitlens.llm import exact_dedup, fuse, simhash
from commitlens.llm.components import connected_components

from .conftest import ODD


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_exact(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d if d is not None else 0, d))
    return {n: (min(g)[3], len(g)) for n, g in groups.items()}


def test_fuse_never_misses_and_rarely_lies():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 1000, 50_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = fuse.build(np.concatenate([keys, keys]))
        assert fuse.contains(f, keys).all()
        assert fuse.contains(f, rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.01
    assert len(f) < 1.3 * n


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_exact_dedup_odd_rows(odd, batches):
    got = exact_dedup.exact_dedup(odd, batches=batches).collect()
    want = brute_exact(ODD)
    assert len(got) == len(ODD)
    by_sha = {hashlib.sha256(n.encode()).digest(): v for n, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[bytes(r["sha"])]
    assert sum(r["kept"] for r in got) == len(want)  # one row of each group, also where rows repeat


def test_exact_dedup_empty_and_kept_rows(odd, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len(brute_exact(ODD))
    assert {norm(r["text"]) for r in rows} == set(brute_exact(ODD))
    assert exact_dedup.keep_first_copies(empty).count() == 0


def test_a_false_positive_of_the_filter_is_no_copy(make_docs, monkeypatch):
    monkeypatch.setattr(fuse, "contains", lambda f, keys: np.ones(len(keys), dtype=bool))
    rows = [(i, f"text {i % 40}", "en", "a") for i in range(60)]
    got = exact_dedup.exact_dedup(make_docs(rows)).collect()
    assert sorted({(r["keep_id"], r["group_size"]) for r in got}) == [(i, 2 if i < 20 else 1) for i in range(40)]


@pytest.mark.parametrize("batches", [1, 2])
def test_a_digest_of_two_texts_stops_the_job(make_docs, monkeypatch, batches):
    digest_rows = exact_dedup.digest_rows
    monkeypatch.setattr(exact_dedup, "digest_rows", lambda *a: digest_rows(*a).withColumn("sha", F.unhex(F.lit("ab" * 32))))
    monkeypatch.setattr(exact_dedup.exact_dedup, "__defaults__", ("doc_id", "text", batches))
    docs = make_docs([(i, f"text {i % 2}", "en", "a") for i in range(8)])
    with pytest.raises(Exception, match="two different texts have one SHA-256 digest"):
        exact_dedup.keep_first_copies(docs).select("doc_id").collect()
    with pytest.raises(Exception, match="two different texts have one SHA-256 digest"):
        exact_dedup.exact_dedup(docs).select("doc_id", "kept").collect()
    same = make_docs([(i, "one text", "en", "a") for i in range(8)])
    assert [r["doc_id"] for r in exact_dedup.keep_first_copies(same).collect()] == [0]


# ---- SimHash -----------------------------------------------------------------------------------

def slow_fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=2):
    """fp -> smallest fp reachable."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= distance:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", ["", "a", " a  b ", "A b C d E", "x\x0by z " * 50, "é É Ü ü a a a a", "one two three " * 3])
def test_fingerprint(text, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_shingles_are_joined_by_one_space():
    assert simhash.fingerprint(b"a\n\nb\tc d") == simhash.fingerprint(b"a b c d")
    assert simhash.fingerprint(None) == 0


def clustered(n, seed):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 40])):
            out.add(f)
            for _ in range(rnd.randrange(1, 4)):
                f ^= 1 << rnd.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("bucket", [4096, 3])
@pytest.mark.parametrize("parts", [None, [(list(range(32)), 0), (list(range(32, 64)), 1)], [(list(range(64)), 2)]])
def test_links_lose_nothing(spark, bucket, parts):
    fps = clustered(400, 3)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    parts = parts or simhash.plan(df)
    assert sum(t for _, t in parts) + sum(1 for _ in parts) >= 1
    edges = simhash.links(df, parts, bucket=bucket)
    got = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in connected_components(edges).collect()}
    want = brute_components(fps)
    groups = lambda of: sorted(sorted(x for x in fps if of(x) == r) for r in {of(f) for f in fps})
    assert groups(lambda f: got.get(f, f)) == groups(lambda f: want[f])


def test_thresholds_sum_up_and_are_least():
    costs = [[0, 5, 50, 500], [0, 9, 10, 11], [0, 7, 70, 700]]
    for total in (-2, -1, 0, 1, 2):
        want = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in itertools.product((-1, 0, 1, 2), repeat=3) if sum(ts) == total)
        cost, chosen = simhash.allocate(costs, total)
        assert cost == want and sum(chosen) == total


def test_correlated_bits_share_a_partition(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        f = rnd.getrandbits(64)
        for b in range(0, 20, 2):  # bits 0, 2, ..., 18 repeat bit 40
            f = f & ~(1 << b) | (f >> 40 & 1) << b
        rows.append((f - (1 << 64) if f >> 63 else f,))
    both = simhash.bit_counts(spark.createDataFrame(rows, "fp long"))
    parts = simhash.correlated_partitions(both, 300, 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any(set(range(0, 20, 2)) | {40} <= set(p) for p in parts)


def test_simhash_odd_rows(odd, empty):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == len(ODD)
    fps = {(d, t): slow_fingerprint(t) for d, t, *_ in ODD}
    root = brute_components(fps.values())
    least = {}
    for (d, _), f in fps.items():
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    want = sorted((str(d), fps[(d, t)], str(least.get(root[fps[(d, t)]]))) for d, t, *_ in ODD)
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in got) == want
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(root.values()))
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one_each(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(edges).collect()
    assert sorted(r["node"] for r in got) == list(range(201)) and {r["root"] for r in got} == {0}
