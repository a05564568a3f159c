"""Ranked lexical search (11) against brute force."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from commitlens.llm import lexical

from .conftest import ODD


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, items, top=10):
    docs = [(d, Counter(terms(t))) for d, t, *_ in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, c, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:top], start=1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **kw):
    q = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS term", "2 AS rank")
    out = lexical.lexical_search(docs, q, **kw)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


ITEMS = [("q1", "The cat, on THE mat"), ("q2", "un deux quatre"), ("q3", None), ("q4", ""), ("q5", "word same row another text under"), ("q6", "nowhere"), (None, "Hund 漢字 é"),
         ("q1", "a b c"), ("q7", "x" * 60_000), ("q8", "cat " * 5000)]


def collection(seed=2, n=700):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(900)]
    weights = [1 / (i + 1) for i in range(900)]
    rows = [" ".join(rng.choices(vocabulary, weights, k=rng.choice((1, 2, 8, 40, 40, 150, 600)))) for _ in range(n)]
    rows += [rows[5]] * 40 + [rows[6] + " more"] * 3  # a text that ties with itself many times
    rng.shuffle(rows)
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 12))))) for k in range(30)] + [("copy", rows[5]), ("tie", "t0")]
    return [(i, t, "en", "a") for i, t in enumerate(rows)], items


def test_odd_rows(spark, odd, empty):
    want = brute(ODD, ITEMS)
    assert {r[0] for r in want} == {"q1", "q2", "q5", "q7", "q8", None}
    assert got(spark, odd, ITEMS) == want
    assert got(spark, empty, ITEMS) == [] and got(spark, odd, []) == []


@pytest.mark.parametrize("limits", [{}, {"BLOCK_DOCS": 8, "BITS": 1, "VOCABULARY": 50, "query_terms": 20}])
def test_against_brute_force(spark, make_docs, monkeypatch, limits):
    """One query block and sound signatures; many small blocks, signatures full of false bits, counts passed on early."""
    query_terms = limits.pop("query_terms", lexical.QUERY_TERMS)
    for k, v in limits.items():
        monkeypatch.setattr(lexical, k, v)
    rows, items = collection()
    assert got(spark, make_docs(rows), items, query_terms=query_terms) == brute(rows, items)


def test_bounds_hold_and_exclude(spark, make_docs):
    """No score is above its bound; most documents are provably out."""
    rows, items = collection(4)
    index = lexical.build_index(make_docs(rows))
    text = {i: t for i, t, *_ in rows}
    names = sorted({w for _, t in items for w in terms(t)})
    df = Counter(w for _, t, *_ in rows for w in set(terms(t)))
    n_terms = sum(len(terms(t)) for _, t, *_ in rows)
    query = lexical.Query([(i, w.encode(), df[w]) for i, (_, t) in enumerate(items) for w in set(terms(t)) if df[w]], len(rows), n_terms, len(items))
    assert names
    exact, bound = [], []
    for r in index.filter("slices IS NOT NULL").collect():
        b = query.bounds(r.asDict())
        for c, ids in enumerate(r["ids"]):
            exact.append(query.score(text[ids[0]].encode(), list(range(len(items)))))
            bound.append(b[:, c])
    exact, bound = np.array(exact), np.array(bound)
    assert (bound >= exact).all()
    tenth = np.sort(exact, axis=0)[-10]
    assert ((bound >= np.maximum(tenth, 1)).sum(axis=0) <= 10 + 0.1 * len(exact)).mean() > 0.8


def test_top_is_checked(spark, odd):
    assert got(spark, odd, ITEMS, top=2) == brute(ODD, ITEMS, 2)
    with pytest.raises(ValueError):
        got(spark, odd, ITEMS, top=11)
