"""Order-aware line counts against a plain version on random edits."""

import random
from collections import Counter

import pytest

from commitlens.operators.churn import longest_run, ordered_line_diff_counts


def plain_run(values):
    """The same rule by dynamic programming over all earlier values."""
    length, before = [], []
    for i, v in enumerate(values):
        best = max(((length[j], j) for j in range(i) if values[j] < v), default=(0, -1))
        length.append(best[0] + 1), before.append(best[1])
    run, at = [], length.index(max(length)) if values else -1
    while at >= 0:
        run.append(at)
        at = before[at]
    return run[::-1]


def plain_counts(old, new):
    a, b = old.splitlines(), new.splitlines()
    na, nb = Counter(a), Counter(b)
    anchors = [(i, a.index(x)) for i, x in enumerate(b) if na[x] == 1 and nb[x] == 1]
    run = [anchors[i] for i in plain_run([o for _, o in anchors])]
    cuts_b, cuts_a = [-1, *[n for n, _ in run], len(b)], [-1, *[o for _, o in run], len(a)]
    added = deleted = 0
    for i in range(len(run) + 1):
        x, y = Counter(b[cuts_b[i] + 1:cuts_b[i + 1]]), Counter(a[cuts_a[i] + 1:cuts_a[i + 1]])
        added, deleted = added + (x - y).total(), deleted + (y - x).total()
    return added, deleted


def test_longest_run():
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 9, 40):
        for _ in range(30):
            values = rng.sample(range(100), n)
            assert longest_run(values) == plain_run(values)


def edits():
    rng = random.Random(11)
    cases = [("", ""), ("", "a\n"), ("a\n", ""), ("a\nb\nc\n", "b\nc\na\n"), ("x\n" * 5, "x\n" * 3), ("x\na\nx\n", "x\nx\na\n")]
    for _ in range(120):
        base = [f"line {rng.randrange(60)}" if rng.random() < 0.7 else rng.choice(("", "}", "end")) for _ in range(rng.choice((3, 10, 40)))]
        t = list(base)
        for _ in range(rng.randrange(6)):
            kind, i = rng.randrange(4), rng.randrange(len(t) + 1)
            if kind == 0:
                t.insert(i, f"new {rng.randrange(5)}")
            elif kind == 1 and t:
                del t[min(i, len(t) - 1)]
            else:  # a block moves
                j = min(len(t), i + rng.randrange(1, 8))
                block, rest = t[i:j], t[:i] + t[j:]
                k = rng.randrange(len(rest) + 1)
                t = rest[:k] + block + rest[k:]
        cases.append(("\n".join(base), "\n".join(t)))
    return cases


@pytest.fixture(scope="module")
def tables(spark):
    cases = edits()
    texts = [(f"{side}{i}", c[k]) for i, c in enumerate(cases) for k, side in enumerate("on")]
    pairs = [(f"n{i}", f"o{i}") for i in range(len(cases))] + [("n0", None), ("n3", None), ("n4", "n4"), ("n5", "lost"), ("lost", "n5"), (None, "o1")]
    return cases, spark.createDataFrame(texts, "blob_id string, text string"), spark.createDataFrame(pairs * 2, "new_blob_id string, old_blob_id string")


def test_random_edits(tables):
    cases, texts, pairs = tables
    got = {tuple(r)[:2]: tuple(r)[2:] for r in ordered_line_diff_counts(pairs, texts).collect()}
    want = {(f"n{i}", f"o{i}"): plain_counts(*c) for i, c in enumerate(cases)}
    assert got == want | {("n0", None): (0, 0), ("n3", None): (3, 0), ("n4", "n4"): (0, 0)}
    assert want["n3", "o3"] == (1, 1)  # a moved line
