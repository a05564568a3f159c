"""Language ID (7), LM scoring (3), nearest neighbours (2) and SentencePiece (6) against brute force."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from commitlens.llm import ann, langid, lm_score, pieces
from commitlens.llm import sentencepiece as sp

from .conftest import ODD

DOCS = "/root/testdata/sf0.01/documents.parquet"


# ---- language ID -------------------------------------------------------------------------------

def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.95
    assert sum(r["accepted"] for r in got) / len(got) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(DOCS).limit(200).cache()
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df).collect())
    assert key(docs) == key(other)


def test_language_id_odd_rows(odd, empty):
    got = langid.identify(odd).join(odd.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    for r in got:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        if r["doc_id"] not in (None, 14):
            assert (r["lang_pred"] != "und") == letters and (letters or (r["score"] == 0 and not r["accepted"]))
    assert langid.identify(odd).count() == len(ODD)
    assert langid.identify(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.filter("text IS NULL OR text = ''").count() == 0
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_every_accepted_row_stays(make_docs):
    rows = [*ODD, *[(None, "un deux trois quatre", "fr", s) for s in ("x", "y", None)], (1, ODD[0][1], "en", "z")]
    docs = make_docs(rows)
    accepted = Counter((r["doc_id"], r["key_of_text"]) for r in langid.identify(docs).collect() if r["accepted"])
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["k"]) for r in kept.select("doc_id", F.xxhash64("text").alias("k")).collect()) == accepted
    assert max(accepted.values()) > 1


def brute_subwords(data):
    """All 3- and 4-grams of a folded text, hashed as integers, in plain Python."""
    folded = bytes(c if c > 127 else c | 32 if chr(c).isalpha() else 32 for c in data)
    folded = re.sub(rb" +", b" ", b" " + folded + b" ")
    def grams(n):
        return [int.from_bytes(folded[i:i + n], "little") for i in range(len(folded) - n + 1)]
    return Counter([(g * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for g in grams(3)] + [((g * 0x85EBCA6B + 1) & 0xFFFFFFFF) >> 16 for g in grams(4)])


def brute_predict(model, data):
    n = brute_subwords(data)
    z = [sum(float(model.table[k][f]) * c for f, c in n.items()) / max(sum(n.values()), 1) + float(model.bias[k]) for k in range(len(model.langs))]
    e = [math.exp(x - max(z)) for x in z]
    return model.langs[e.index(max(e))], max(e) / sum(e)


TEXTS = ["une phrase et encore une phrase, déjà vue. " * 40, "", " ", "a", "ab", "x   ", "  1 2 3  4 ", "é", "漢字 😀 A-z", "ab cd " * 7 + "!" * 900 + "e"]


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 64, 500, 1 << 18])
def test_pieces_of_a_text_change_nothing(monkeypatch, piece):
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], rng.normal(size=(2, langid.BUCKETS)).astype(np.float32), np.zeros(2), 0.5)
    monkeypatch.setattr(langid, "PIECE", piece)
    for text in TEXTS:
        data = text.encode()
        assert Counter(np.concatenate([np.zeros(0, int), *langid.subwords_in_pieces(data, piece)]).tolist()) == brute_subwords(data)
        assert Counter(langid.subwords(data).tolist()) == brute_subwords(data)
        lang, score = langid.predict_text(model, data)
        assert (lang, score) == (brute_predict(model, data)[0], pytest.approx(brute_predict(model, data)[1], abs=1e-9))


def test_predictions_of_a_fixed_model(make_docs):
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(3, langid.BUCKETS)).astype(np.float32), rng.normal(size=3), 0.4)
    got = langid.detect(make_docs([(i, t, "en", "s") for i, t in enumerate(TEXTS)]), model).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = TEXTS[r["doc_id"]]
        want = brute_predict(model, text.encode()) if any(c.isalpha() for c in text) else ("und", 0.0)
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=1e-9)
        assert r["accepted"] == (want[0] != "und" and want[1] >= model.threshold)


# ---- LM scoring --------------------------------------------------------------------------------

def brute_lm(texts, order=3, alpha=0.4, least=2):
    import re
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    c = [Counter(tuple(w[i:i + n]) for w in docs for i in range(len(w) - n + 1)) for n in range(order + 1)]
    total = sum(map(len, docs))
    out = []
    for w in docs:
        s, hits = 0.0, [0] * order
        for i in range(len(w)):
            n, penalty = min(order, i + 1), 0.0
            while n > 1 and c[n][tuple(w[i - n + 1:i + 1])] < least:
                n, penalty = n - 1, penalty + math.log(alpha)
            hits[n - 1] += 1
            g = tuple(w[i - n + 1:i + 1])
            s += penalty + math.log(c[n][g] / (c[n - 1][g[:-1]] if n > 1 else total))
        out.append((len(w), s, hits))
    return out


@pytest.mark.parametrize("order,block_words", [(3, 50), (3, 2_000_000), (1, 7), (2, 9), (4, 11)])
def test_lm_scores(spark, order, block_words):
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choices("abcdef", k=rnd.randrange(0, 90))).replace("a", "A", 3)) for i in range(40)] + [(40, None), (41, ""), (None, "a b c"), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_score.lm_scores(df, order=order, min_count=2, block_words=block_words).collect()
    key = lambda d, n, s, h: (str(d), n, round(s, 6) + 0.0, list(h))
    assert sorted(key(r["doc_id"], r["n_words"], r["log_score"], r["hits"]) for r in got) == sorted(
        key(d, *b) for (d, _), b in zip(rows, brute_lm([t for _, t in rows], order)))


def test_lm_odd_rows(odd, empty):
    got = lm_score.lm_scores(odd, min_count=2).collect()
    want = brute_lm([t for _, t, *_ in ODD])
    assert sorted((str(r["doc_id"]), r["n_words"], round(r["log_score"], 3)) for r in got) == sorted((str(o[0]), b[0], round(b[1], 3) + 0.0) for o, b in zip(ODD, want))
    assert lm_score.lm_scores(empty).count() == 0


def test_lm_query_counts_ngrams_that_occur_once(spark, tmp_path):
    rows = [(1, "a b c d a b c e"), (2, "x y z a b"), (3, "once only here"), (4, "q"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = lm_score.op3_lm_score(spark, str(tmp_path)).collect()
    want = brute_lm([t for _, t in rows], least=1)
    assert sorted((r["doc_id"], r["n_words"], r["log_score"] + 0.0, [r["hits_1"], r["hits_2"], r["hits_3"]]) for r in got) == [
        (d, n, round(s, 4) + 0.0, h) for (d, _), (n, s, h) in zip(rows, want)]


@pytest.mark.parametrize("order,block_words,bucket_bytes", [(3, 7, 100), (4, 2_000_000, 16 << 20)])
def test_lm_scores_without_a_cutoff(spark, monkeypatch, order, block_words, bucket_bytes):
    """The default: every n-gram counts; in several turns, and in one."""
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", bucket_bytes)
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choices("abcdef", k=rnd.randrange(0, 60)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_score.lm_scores(df, order=order, block_words=block_words).collect()
    assert sorted((r["doc_id"], round(r["log_score"], 6) + 0.0, list(r["hits"])) for r in got) == [
        (d, round(s, 6) + 0.0, h) for (d, _), (_, s, h) in zip(rows, brute_lm([t for _, t in rows], order, least=1))]


# ---- nearest neighbours ------------------------------------------------------------------------

def brute_nearest(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    norms = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        s = (v * v[at]).sum(axis=1) / (norms * norms[at])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def check_recall(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = total = 0
    for q, w in want.items():
        g = sorted(by.get(q, []))
        assert [r for r, *_ in g] == list(range(1, len(w) + 1))
        assert [(-s, i) for _, i, s in g] == sorted((-s, i) for _, i, s in g)
        found += len({i for _, i, _ in g} & {i for i, _ in w})
        total += len(w)
    assert found >= least * total


def test_recall_on_embeddings(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    check_recall(ann.op2_ann_search(spark, "/root/testdata/sf0.01").collect(), want, 0.9)


def test_nearest_odd_vectors_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 32)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(200)]
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] + [1.0] * 5), (2004, [float("inf")] + [1.0] * 5),
           (2005, [1.0]), (2006, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], "vec_id long, embedding array<double>, cell string, p string").repartition(4)
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    want = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    check_recall(got, want, 0.9)
    of_copy = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 1050)
    assert [i for _, i in of_copy] == [1000, 1001, 1002, 1003, 1004]  # ties to the smaller id
    assert ann.search(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.search(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


class CountingTree(ann.Tree):
    """Fails where one group brings more rows or queries than the limits set in the test allow."""
    limit = 0

    def __init__(self, ids, *rest):
        super().__init__(ids, *rest)
        self.asked = 0
        assert len(ids) <= 200, f"{len(ids)} rows in a group"

    def nearest_of_copies(self, own, *rest):
        self.asked += len(own)
        assert self.asked <= self.limit, f"more than {self.limit} queries in a group"
        return super().nearest_of_copies(own, *rest)

    def nearest(self, *rest):
        if not hasattr(super(), "nearest_of_copies"):
            self.asked += 1
            assert self.asked <= self.limit, f"more than {self.limit} queries in a group"
        return super().nearest(*rest)


@pytest.mark.parametrize("copies", [400, 0])
def test_queries_of_a_cell_are_bounded_too(spark, monkeypatch, copies):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 16, raising=False)
    monkeypatch.setattr(CountingTree, "limit", 48)
    monkeypatch.setattr(ann, "Tree", CountingTree)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(500)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(copies)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, F.lit(True)).collect()
    check_recall(got, brute_nearest(rows, [i for i, _ in rows]), 0.9)
    assert all(r["vec_id"] != r["query_id"] for r in got)
    for q in (1000, 1003, 1399) if copies else ():
        assert [i for _, i in sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)] == [i for i in range(1000, 1006) if i != q][:5]


def test_copies_of_a_query_are_searched_once_and_repeats_of_a_row_are_found(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, -0.0]), (4, [1.0, 1.0]), (5, [0.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=4).collect()
    by = {q: [i for _, i in sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)] for q in range(1, 6)}
    assert by == {1: [2, 3, 3, 4], 2: [1, 1, 1, 3], 3: [1, 1, 1, 2], 4: [1, 1, 1, 2], 5: [4, 1, 1, 1]}


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324, 1.7e308])
def test_lengths_of_vectors_do_not_matter(spark, monkeypatch, size):
    monkeypatch.setattr(ann, "CELL_ROWS", 16)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(1000, [1.0] * 6), (1001, [1.0, 1.0, 1.0, 1.0, 1.0, 0.9])]
    df = spark.createDataFrame([*rows, (2000, [size] * 6)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(df, F.col("vec_id") >= 1000).collect()
    at = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert at[2000, 1] == (1000, pytest.approx(1.0)) and at[1000, 1] == (2000, pytest.approx(1.0)) and at[2000, 2][0] == 1001
    check_recall(got, brute_nearest([*rows, (2000, [1.0] * 6)], [1000, 1001, 2000]), 0.9)


def test_a_repeated_query_id_asks_with_its_smallest_vector(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [2.0, 0.0])]
    for n in (1, 4):
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n), F.col("vec_id") == 1, k=2).collect()
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 1.0), (3, 0.0)]


def test_every_row_goes_down_to_the_cell_whose_box_holds_it():
    points = np.random.default_rng(7).normal(size=(500, 4))
    leaves = ann.split(points, 20)
    top = ann._descent([path for _, path in leaves], list(range(len(leaves))))
    for i, (at, _) in enumerate(leaves):
        for p in points[at]:
            node = top
            while not isinstance(node, int):
                node = node[3] if p[node[0]] > node[1] else node[2]
            assert node == i


def test_chi_square_of_even_degrees():
    x = np.random.default_rng(1).standard_normal((200_000, 8))
    for p in (0.1, 0.5, 0.9, 0.98):
        assert ((x * x).sum(axis=1) <= ann.chi2_bound(p)).mean() == pytest.approx(p, abs=0.01)


def test_chi_square_of_the_directions_in_use():
    x = np.random.default_rng(2).standard_normal((100_000, ann.DIMS))
    for p in (0.1, 0.5, 0.9, ann.CONFIDENCE):
        assert ((x * x).sum(axis=1) <= ann.chi2_bound(p, ann.DIMS)).mean() == pytest.approx(p, abs=0.01)


def test_more_directions_verify_fewer_rows(monkeypatch):
    """Recall stays at 0.9 or more, and the stopping test lets through fewer rows."""
    import pyarrow.parquet as pq
    table = pq.read_table(DOCS.replace("documents", "embeddings"))
    v = ann.scaled(np.array([x for x in table["embedding"].to_pylist() if x and all(map(math.isfinite, x)) and any(x)], dtype=float))
    v = np.concatenate([v, v + np.random.default_rng(3).normal(scale=0.3 * v.std(), size=v.shape)])
    ids, unit, plain = np.arange(len(v)), v / np.sqrt((v * v).sum(axis=1))[:, None], ann.cosines
    shares = {}
    for dims in (8, ann.DIMS):
        seen, hits = [], 0
        monkeypatch.setattr(ann, "cosines", lambda x, *a: (seen.append(len(x)), plain(x, *a))[1])
        p = ann._project(v, ann.directions(v.shape[1], dims))
        tree = ann.Tree(ids, v, p)
        for i in range(0, len(v), 20):
            _, scores = tree.nearest(i, v[i], p[i], 5, math.inf, ann.chi2_bound(ann.CONFIDENCE, dims))
            true = np.sort(np.delete(unit @ unit[i], i))[-5]
            hits += (scores >= true - 1e-12).sum()
        shares[dims] = sum(seen)
        assert hits >= 0.9 * 5 * len(range(0, len(v), 20))
    assert shares[ann.DIMS] < shares[8]


# ---- SentencePiece -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def models():
    from sentencepiece import sentencepiece_model_pb2 as pb
    bpe = pb.ModelProto.FromString(open(sp.MODEL, "rb").read())
    uni = pb.ModelProto.FromString(open(sp.MODEL, "rb").read())
    uni.trainer_spec.model_type = 1  # the same pieces, read as a unigram model
    rnd = random.Random(8)
    for i, p in enumerate(uni.pieces):
        if p.type == 1:
            p.score = -math.log(i + 10) - rnd.random()
    return {name: (pieces.Lattice(pieces.from_proto(m)), spm.SentencePieceProcessor(model_proto=m.SerializeToString())) for name, m in (("bpe", bpe), ("unigram", uni))}


def texts(n, seed):
    rnd = random.Random(seed)
    alphabets = ["abcdefgh  ethinr\n漢é😀.0", "ethaions", "  ab", "ééèçñß der die und ", "=-_/\\<>0123456789 \t"]
    return ["", " ", "a", "▁", "  ", "<0x0A>", "<s> </s>"] + ["".join(rnd.choices(a, k=rnd.randrange(1, 260))) for _ in range(n) for a in alphabets]


def scan(lattice, text, size):
    """The parallel scan without Spark, with the matrices multiplied as a tree."""
    t = pieces.normalise(text, True)
    if not t:
        return []
    edges = [*range(0, len(t), size), len(t)]
    chunks = list(zip(edges, edges[1:]))
    matrices = [lattice.transfer(t, a, b, b == len(t)) for a, b in chunks]
    states = sp.best_states(matrices, (0, None), (0, None))
    tree = matrices
    while len(tree) > 1:
        tree = [pieces.product(*tree[i:i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
    line = matrices[0]
    for m in matrices[1:]:
        line = pieces.product(line, m)
    assert [e[:4] for e in tree[0]] == [e[:4] for e in line] and len(line) == 1 and tree[0][0][4] == pytest.approx(line[0][4])
    found = b"".join(lattice.trace(t, a, b, states[k], states[k + 1], b == len(t)) for k, (a, b) in enumerate(chunks))
    return np.frombuffer(found, dtype="<i4").tolist()


@pytest.mark.parametrize("size", [33, 64, 10_000])
def test_scan_gives_the_ids_of_the_bpe_encoder(models, size):
    lattice, own = models["bpe"]
    for t in texts(30, size):
        assert scan(lattice, t, size) == own.encode(t), t


@pytest.mark.parametrize("size", [33, 10_000])
def test_scan_gives_a_best_unigram_path(models, size):
    lattice, own = models["unigram"]
    score = lambda ids: sum(own.get_score(i) for i in ids if not own.is_byte(i))
    for t in texts(12, size):
        got, want = scan(lattice, t, size), own.encode(t)
        assert own.decode(got) == own.decode(want)
        assert got == want or score(got) == pytest.approx(score(want), abs=1e-3)  # equal scores may tie


def test_segments_equal_the_encoder_on_documents(models):
    import pyarrow.parquet as pq
    lattice, own = models["bpe"]
    for t in pq.read_table(DOCS, columns=["text"])["text"].to_pylist()[:300]:
        assert np.frombuffer(lattice.segments(pieces.normalise(t, True)), dtype="<i4").tolist() == own.encode(t)


def test_encode_and_decode_odd_rows(odd, empty, models):
    _, own = models["bpe"]
    want = sorted(((str(d), None if t is None else own.encode(t)) for d, t, *_ in ODD), key=str)
    for chunk, block in ((1 << 14, 64), (100, 4)):
        got = sp.encode(odd, chunk=chunk, block=block)
        assert sorted(((str(r["doc_id"]), r["ids"]) for r in got.collect()), key=str) == want
    back = sp.decode(got.withColumn("text", F.lit("clash"))).collect()
    assert sorted(str((r["doc_id"], r["decoded"])) for r in back) == sorted(str((d, t and t.replace("▁", " "))) for d, t, *_ in ODD)
    assert sp.encode_and_decode(empty).count() == 0
