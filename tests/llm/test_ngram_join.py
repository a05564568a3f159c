"""N-gram Jaccard join (13) against brute force."""
import random
import re

import pytest

from commitlens.llm import ngram_join
from commitlens.llm.ngram_join import Cell

from .conftest import ODD


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, n_links) of every row."""
    sets = [shingles(t) for _, t, *_ in rows]
    near = [[j for j in range(len(rows)) if j != i and a and (100 * len(a & sets[j]) >= percent * len(a | sets[j]))] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j), stack.append(j)
        label[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((r[0], len(s), c, len(n)) for r, s, c, n in zip(rows, sets, label, near)), key=repr)


def got(docs, **kw):
    out = ngram_join.ngram_join(docs, **kw)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def near_copies(seed=3):
    """Texts, each with copies in which some words change: overlaps on both sides of the limit, chains, long and short ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, passage = [], [word() for _ in range(30)]
    for length in (3, 4, 5, 9, 30, 60, 200, 900):
        for copies in (1, 6, 25):
            base = [word() for _ in range(length)] + (passage if length in (30, 200) else [])
            rows.append(" ".join(base))
            for _ in range(copies):
                t = list(base)
                for _ in range(rng.choice((0, 1, 1, 2, 3, length // 40))):
                    at = rng.randrange(len(t))
                    kind = rng.randrange(3)
                    if kind == 0:
                        t[at] = word()
                    elif kind == 1 and len(t) > 1:
                        del t[at]
                    else:
                        t.insert(at, word())
                rows.append(" ".join(t).upper() if rng.random() < 0.1 else "  ".join(t))
                base = t if rng.random() < 0.2 else base  # chains
    rng.shuffle(rows)
    return [(i, t, "en", "a") for i, t in enumerate(rows)]


def test_odd_rows(odd, empty):
    assert got(odd) == brute(ODD)
    assert got(empty) == []


@pytest.mark.parametrize("limits", [{"CELL_SETS": 16, "CELL_TOKENS": 4000, "MANY": 4, "LEADERS": 3, "POSITIONS": 2}, {"MANY": 0}, {"MANY": 10**9}])
def test_near_copies(make_docs, monkeypatch, limits):
    """Whole cells, cut ones, everything led, and nothing led: all the same."""
    for k, v in limits.items():
        monkeypatch.setattr(ngram_join, k, v)
    rows = near_copies()
    assert got(make_docs(rows), block_size=3000) == brute(rows)


@pytest.mark.parametrize("percent", [100, 30])
def test_other_thresholds(make_docs, percent):
    rows = near_copies(8)[:250]
    assert got(make_docs(rows), percent=percent) == brute(rows, percent)


def test_threshold_is_checked(odd):
    for bad in (0, 101):
        with pytest.raises(ValueError):
            ngram_join.ngram_join(odd, percent=bad)


def cell_rows(sets):
    import numpy as np
    seen = sorted({w for s in sets for w in s}, key=lambda w: (sum(w in s for s in sets), w))
    place = {w: i for i, w in enumerate(seen)}
    rows = []
    for i, s in enumerate(sets):
        own = [w for w in s if sum(w in t for t in sets) == 1]
        t = np.array(sorted(place[w] for w in s if w not in own), dtype="<u8")
        rows.append({"sid": i, "n": len(s), "side": 0, "copies": 1, "skip": len(own), "n_tokens": len(t), "tokens": t.tobytes()})
    return rows


def test_answers_are_derived_from_a_leader(monkeypatch):
    """In a group of near copies, one set is counted against all and the others follow from it."""
    monkeypatch.setattr(ngram_join, "MANY", 8)
    rng = random.Random(1)
    base = set(range(400))
    sets = [(base - set(rng.sample(sorted(base), 12))) | {1000 + 20 * i + j for j in range(6)} for i in range(80)]
    cell = Cell(cell_rows(sets), 85)
    links = {(x, int(y)) for x, ys in cell.links() for y in ys}
    by_size = sorted(range(80), key=lambda i: (len(sets[i]), i))
    want = {(a, b) for a in range(80) for b in range(a) for s, t in [(sets[by_size[a]], sets[by_size[b]])] if 100 * len(s & t) >= 85 * len(s | t)}
    assert links == want and want
    assert cell.counted <= 3 and cell.derived >= 60
