"""Cross-tokenizer alignment (12) against the whole-text encoders and brute force."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from commitlens.llm import alignment
from commitlens.llm.common import documents

from .conftest import ODD

HARD = [" two  blanks", "trailing ", "tab\tand\nline \n end", "<|endoftext|> <s> </s> <unk> <0x41>", "it's John 's we'll don 't", "ｆｕｌｌ ﬁ ①", "é ́ a", "a b c d",
        "▁ ▁▁x", "日本語 テキスト 한국어", "😀 😀😀 🏳️‍🌈", "x" * 5000, "0123456789 " * 400, "a " * 3000, "\x00 \x01", " ", "  ", "\n", "end.\n\nStart (of) [it]: \"q\" 3,14 %", "﻿bom", "À É ñ ß"]


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer
    json_a = open(alignment.MODEL_A, "rb").read()
    tok = alignment.Tokenizers(json_a, open(alignment.MODEL_B, "rb").read())
    tok.whole_a = Tokenizer.from_str(json_a.decode())
    tok.whole_a.encode_special_tokens = True
    return tok


def test_ranks_give_what_the_library_gives(tokenizers):
    words = [w for t in HARD for w in alignment.words_of(t)]
    by_library = alignment.Tokenizers._by_library(open(alignment.MODEL_A, "rb").read())(words)
    assert tokenizers.encode_a(words) == by_library
    assert tokenizers._by_ranks({"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "ba": 3}, "merges": ["b a", "a b"]}, "pre_tokenizer": {"type": "ByteLevel"}}) is None


def whole(tok, text):
    """(ids of A, ids of B) of a text in one call of each library; none where they don't spell it."""
    if not text:
        return [], []
    a, b = tok.whole_a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    data = (" " + text).encode()
    return (a, b) if b"".join(tok.bytes_a[i] for i in a) == data and b"".join(tok.bytes_b[i] for i in b) == data else ([], [])


def brute(tok, texts):
    """The result columns without doc_id, by a walk over both token lists."""
    docs, count = [], Counter()
    for text in texts:
        a, b = whole(tok, text)
        i = j = at_a = at_b = 0  # next tokens, and where they start
        group, groups, links = ([], []), [], []
        while i < len(a):
            end_a, end_b = at_a + len(tok.bytes_a[a[i]]), at_b + len(tok.bytes_b[b[j]])
            links.append((a[i], b[j]))
            if end_a <= end_b:
                group[0].append(str(a[i]))
            if end_b <= end_a:
                group[1].append(str(b[j]))
            if end_a == end_b:
                groups.append(",".join(group[0]) + "|" + ",".join(group[1]))
                group = ([], [])
            i, at_a = (i + 1, end_a) if end_a <= end_b else (i, at_a)
            j, at_b = (j + 1, end_b) if end_b <= end_a else (j, at_b)
        count.update(links)
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    return [(na, nb, ng, len(ls), sum(count[p] == highest[p[1]] for p in ls), sum(count[p] for p in ls), sha) for na, nb, ng, ls, sha in docs]


def check(docs, rows, tok, **kw):
    out = alignment.align_tokenizers(docs, **kw)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *r) for i, r in zip([i for i, _ in rows], brute(tok, [t for _, t in rows]))]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_odd_rows(odd, empty, tokenizers):
    check(odd, [(i, t) for i, t, *_ in ODD], tokenizers)
    assert alignment.align_tokenizers(empty).count() == 0


def test_hard_texts_in_small_segments_and_blocks(make_docs, tokenizers, monkeypatch):
    """Texts over several segments and blocks, a word memory that is cleared, and a tree of sums of more than one level."""
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "WORDS", 20)
    rng = random.Random(6)
    texts = HARD + [" ".join(rng.choices(HARD, k=3)) for _ in range(30)]
    check(make_docs([(i, t, None, None) for i, t in enumerate(texts)]), list(enumerate(texts)), tokenizers, block_size=3000, segment_words=50)


def test_documents(spark, tokenizers):
    docs = documents(spark, "/root/testdata/sf0.001")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], tokenizers)


def test_shared_cuts():
    """Random ends: exactly the common ones are cuts, also where few or none are."""
    rng = np.random.default_rng(3)
    for density in (0.9, 0.3, 0.01, 0.0):
        for n in (1, 2, 50, 4000):
            a, b = (np.flatnonzero(np.append(rng.random(n) < max(density, 0.2), True)) for _ in range(2))
            if density == 0.0:
                a, b = np.append(np.arange(0, 2 * n, 2), 2 * n + 1), np.append(np.arange(1, 2 * n, 2), 2 * n + 1)
            cut = alignment.shared_cuts(a, b, np.array([len(a) - 1]))
            assert (a[cut] == np.intersect1d(a, b)).all()
