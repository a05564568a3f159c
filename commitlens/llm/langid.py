"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased (A-Z), everything but letters and non-ASCII bytes becomes a space, runs of spaces
become one, and the byte 3- and 4-grams are hashed to ``BUCKETS`` embedding rows.  The mean of the rows goes
through a linear layer and a softmax.  Both are trained by stochastic gradient descent in numpy on a bounded
sample: at most ``PER_LANG`` labelled rows of each language, the ones with the smallest hash of doc_id, and
windows of ``WINDOWS`` characters from anywhere in each of their texts.  Training rows are those whose
crc32(doc_id as text) mod 4 is not 2; the others are held out.  A fifth of the sample is not trained on: it sets the
temperature of the softmax and the score under which a text is rejected.

Prediction reads whole texts, one pass, no shuffle: embedding times output layer is folded into one score
table (BUCKETS x languages, a fixed size) that is broadcast.

A null text and a text without a letter get ``und`` with score 0 and are rejected; so does every text when there is nothing to
learn from (no labelled rows).  A null doc_id is not held out.  Repeated rows get equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import all_rows, documents, register, text_key

UNDETERMINED = "und"
BUCKETS = 1 << 16
DIM = 16
PER_LANG = 2048
#: characters of the windows taken from each text: short ones too, as short texts are to be told apart and kept
WINDOWS = (300, 120, 40)
EPOCHS = 4
RATE = 0.5
#: share of rightly labelled calibration windows that may score under the rejection threshold
REJECT_SHARE = 0.001
#: the threshold never exceeds this score
REJECT_AT_MOST = 0.4
#: bytes of a text that are hashed at once
PIECE = 1 << 18

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # languages x BUCKETS
    bias: np.ndarray
    threshold: float


def subwords(data: bytes) -> np.ndarray:
    """Hashed 3- and 4-grams of a text."""
    found = list(subwords_in_pieces(data, max(len(data), 1)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def subwords_in_pieces(data: bytes, piece: int) -> Iterator[np.ndarray]:
    """The n-grams of a text, ``piece`` of its bytes at a time: each is given where its last byte stands, so pieces change none."""
    last = np.array([32], dtype=np.uint8)  # what n-grams of the next piece reach back to; the text begins and ends with a space
    for at in range(0, max(len(data), 1), piece):
        new = _FOLD[np.frombuffer(data, dtype=np.uint8, count=min(piece, len(data) - at), offset=at)] if data else np.zeros(0, dtype=np.uint8)
        a = np.concatenate([last, new, np.full(int(at + piece >= len(data)), 32, dtype=np.uint8)])
        keep = np.ones(len(a), dtype=bool)
        keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
        a, old = a[keep], len(last)
        last = a[-3:]
        a = a.astype(np.uint32)
        if len(a) >= 3:
            three = a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)
            four = three[:-1] | a[3:] << np.uint32(24)
            three, four = three[max(old - 2, 0):], four[max(old - 3, 0):]
            yield np.concatenate([three * np.uint32(0x9E3779B1), four * np.uint32(0x85EBCA6B) + np.uint32(1)]) >> np.uint32(16)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[str, bytes, bool]], seed: int = 7) -> Model | None:
    """samples: (language, window, whether it calibrates); None if there is nothing to learn."""
    langs = sorted({lang for lang, _, cal in samples if not cal})
    prepared = [(langs.index(lang), f, cal) for lang, w, cal in samples if lang in langs and len(f := subwords(w))]
    train = [(y, *np.unique(f, return_counts=True)) for y, f, cal in prepared if not cal]
    if not train:
        return None
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    weight = len(train) / len(langs) / np.maximum(np.bincount([y for y, _, _ in train], minlength=len(langs)), 1)
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            y, rows, n = train[i]
            share = (n / n.sum())[:, None]
            rate = RATE * (1 - step / steps)
            step += 1
            e = emb[rows]
            x = (e * share).sum(axis=0)
            g = _softmax(x @ out + bias)
            g[y] -= 1
            g *= weight[y]
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= rate * g
            emb[rows] = e - (rate * len(rows) ** 0.5) * share * back
    table, logits, truth = (emb @ out).T, [], []
    for y, f, cal in prepared:
        if cal:
            logits.append(table[:, f].mean(axis=1) + bias)
            truth.append(y)
    temperature, threshold = _calibrate(np.array(logits), np.array(truth)) if truth else (1.0, 0.0)
    return Model(langs, np.ascontiguousarray(table / temperature, dtype=np.float32), bias / temperature, threshold)


def _calibrate(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the score under which REJECT_SHARE of the right answers fall."""
    at = np.arange(len(truth))
    grid = np.geomspace(0.05, 10, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[at, truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    return temperature, float(min(REJECT_AT_MOST, np.quantile(right, REJECT_SHARE))) if len(right) else 0.0


def predict_text(model: Model, data: bytes) -> tuple[str, float]:
    """Language and probability of a whole text."""
    total, n = np.zeros(len(model.langs)), 0
    for f in subwords_in_pieces(data, PIECE):
        n += len(f)
        for k in range(len(model.langs)):
            total[k] += model.table[k].take(f).sum(dtype=np.float64)
    p = _softmax(total / max(n, 1) + model.bias)
    best = int(p.argmax())
    return model.langs[best], float(p[best])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes, bool]]:
    """The bounded sample, on the driver: at most PER_LANG texts a language, a window of each length."""
    place = F.xxhash64(F.lit("langid"), F.col(id_col))
    usable = F.col(lang_col).isNotNull() & (F.col(lang_col) != UNDETERMINED) & ~held_out(F.col(id_col))
    pool = docs.filter(usable).select(F.col(lang_col).cast("string").alias("lang"), place.alias("place"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    # about twice as many as needed pass this bound, so that few rows are ranked
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * PER_LANG / n))) for lang, n in sorted(sizes.items())])
    near = pool.filter((F.col("place").cast("double") / 2.0**63 + 1) / 2 <= share)
    length = F.char_length("text")
    windows = F.array(*[F.substring("text", F.pmod(F.xxhash64("place", F.lit(i)), F.greatest(length - n, F.lit(1))).cast("int") + 1, F.lit(n))
                        for i, n in enumerate(WINDOWS)])
    by_place = Window.partitionBy("lang").orderBy("place", "windows")
    rows = (near.filter(F.col("text").rlike(r"\p{L}")).select("lang", "place", windows.alias("windows"))
            .withColumn("no", F.row_number().over(by_place)).filter(F.col("no") <= PER_LANG))
    found = sorted((r["lang"], r["place"], w, r["no"] % 5 == 0) for r in rows.collect() for w in r["windows"])
    return [(lang, w.encode(), cal) for lang, _, w, cal in found]


def detect(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, key_of_text, held_out, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if shared.value is None else Model(*shared.value)
        for b in batches:
            said = [predict_text(m, t.as_py()) if m is not None and ok.as_py() else (UNDETERMINED, 0.0)
                    for t, ok in zip(b.column(4).cast(pa.binary()), b.column(3))]
            score = np.array([s for _, s in said], dtype=np.float64)
            lang = pa.array([lang for lang, _ in said], pa.string())
            passed = np.array([lang != UNDETERMINED and s >= m.threshold for lang, s in said], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lang, pa.array(score), pa.array(passed)],
                                             ["doc_id", "key_of_text", "held_out", "lang_pred", "score", "accepted"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key_of_text"), held_out(F.col(id_col)).alias("held_out"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text")).mapInArrow(
        run, "doc_id long, key_of_text long, held_out boolean, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the documents' own labels and predict every document."""
    return detect(docs, fit(training_windows(docs, id_col, text_col, lang_col)), id_col, text_col)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is accepted, with all their columns."""
    model = fit(training_windows(docs, "doc_id", "text", "lang"))
    kept = detect(docs, model).filter("accepted").select(F.col("doc_id").alias("_id"), F.col("key_of_text").alias("_key")).distinct()
    return all_rows(docs, kept)


@register("op7_language_id")
def op7_language_id(spark, sf_dir):
    return identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "accepted")
