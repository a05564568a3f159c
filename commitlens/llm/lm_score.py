"""Language-model scores with stupid backoff over n-gram counts of the whole corpus.

Words are runs of non-white-space, A-Z lower-cased.  With c the counts over all documents and N all words,

    S(w | history) = c(history w) / c(history)  if c(history w) >= MIN_COUNT, else ALPHA * S(w | shorter history),
    S(w) = c(w) / N

and a document's score is the sum of log S over its words; the first words have the history there is.  The registered
query has MIN_COUNT = 1, plain stupid backoff: every n-gram that occurs is counted and joined.

The relations, and how they are joined:

* **blocks**: documents are read into blocks of about ``BLOCK_WORDS`` words (a longer text goes on in the next block, with the
  history it needs), stored once as word numbers and a bucketed table, so later joins on the block do not move it;
* **n-grams**: a block sends each of its distinct n-grams once, with its count, to the hash bucket of the n-gram: packed
  arrays of 64-bit hashes, one row a (bucket, block, order).  So "the" is one entry a block, however often it occurs;
* **count tables**, partitioned by hash: a bucket adds its entries up and joins the totals back to the blocks that asked;
  the buckets take turns, ``PASSES`` at most, and the n-grams of one turn are all that is shuffled at a time;
* with a cutoff of one, all orders are asked for at once.  A caller's higher cutoff (``min_count``) asks for an order above two
  only where both parts of an n-gram reach it, since no other can (a count is at most the count of its parts);
* each block scores its words, and the sums are added up by document.

The number of buckets follows from the bytes of text.  Counts are over all documents and nothing is dropped; two n-grams
are told apart by 64-bit hashes.  Null and empty texts have no words and score 0.  Repeated rows count as often as
they occur, and each has its own result.  An empty table gives an empty result.  Only ids and texts are read.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import documents, materialize, register, tasks

ORDER = 3
ALPHA = 0.4
#: cutoff of the registered query: every n-gram that occurs counts
MIN_COUNT = 1
BLOCK_WORDS = 400_000
#: bytes of text for each hash bucket
BUCKET_BYTES = 16 << 20
#: turns in which the buckets are asked, so that one turn's n-grams are on disk at a time; their number does not grow
PASSES = 8
#: bytes of a text that are split into words at once
PIECE = 1 << 22

_BLOCK = ("block long, n_words long, rid array<long>, doc_id array<long>, lengths binary, context binary, vocabulary binary, words binary")
_ASK = "bucket int, block long, n int, grams binary, counts binary"
_TOLD = "block long, n int, bucket int, totals binary"


# ---- packed arrays -----------------------------------------------------------------------------

def _planes(a: np.ndarray) -> bytes:
    """Integers by byte position, so that the bytes that are zero stand together and compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _deltas(sorted_values: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_values, prepend=np.uint64(0)))


def _undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, "<u8"), dtype=np.uint64)


# ---- blocks ------------------------------------------------------------------------------------

def _text_words(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].lower().split()
        at = end


def _make_blocks(order: int, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, rows = itertools.count(), itertools.count()
        rid, ids, lengths, context, parts = [], [], [], [], []
        vocabulary = defaultdict(itertools.count().__next__)
        size = 0

        def block() -> pa.RecordBatch:
            words = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], dtype="<u8")
            cols = [[(task << 32) + next(number)], [int(sum(lengths) - sum(context))], [rid], [ids], [np.array(lengths, dtype="<i8").tobytes()],
                    [np.array(context, dtype="<i4").tobytes()], [hashes.tobytes()], [_planes(words)]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              ["block", "n_words", "rid", "doc_id", "lengths", "context", "vocabulary", "words"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                row, history = (task << 36) + next(rows), []
                rid.append(row), ids.append(doc_id), lengths.append(0), context.append(0)
                for words in _text_words(text.as_py() or b""):
                    for at in range(0, len(words), block_words):
                        some = words[at:at + block_words]
                        if size >= block_words:
                            yield block()
                            vocabulary = defaultdict(itertools.count().__next__)
                            rid, ids, lengths, context, parts, size = [row], [doc_id], [len(history)], [len(history)], [], 0
                            parts.append(np.fromiter(map(vocabulary.__getitem__, history), "<u4", len(history)))
                        parts.append(np.fromiter(map(vocabulary.__getitem__, some), "<u4", len(some)))
                        lengths[-1] += len(some)
                        size += len(some)
                        if order > 1:
                            history = (history + some[1 - order:])[1 - order:]
        if rid:
            yield block()
    return run


class Block:
    """The words of a block as hashes, and its distinct n-grams by order."""

    def __init__(self, row: dict):
        hashes = np.frombuffer(row["vocabulary"], dtype="<u8")
        self.hash = hashes[_unplanes(row["words"], "<u4")] if len(row["words"]) else np.zeros(0, dtype="<u8")
        self.lengths = np.frombuffer(row["lengths"], dtype="<i8")
        self.context = np.frombuffer(row["context"], dtype="<i4").astype(np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        #: place of a word in its part of a document, and whether the word is scored here
        self.place = np.arange(len(self.hash)) - np.repeat(starts, self.lengths)
        self.own = self.place >= np.repeat(self.context, self.lengths)
        self.grams = {1: self.hash}
        #: totals at each word; an order that was not asked for anywhere has none
        self.counts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(self.hash), dtype=np.int64))

    def gram(self, n: int) -> np.ndarray:
        """At each word, the hash of the n words that end there (of no use near the start of a document)."""
        if n not in self.grams:
            before = np.empty_like(self.hash)
            shorter = self.gram(n - 1)
            before[0:1], before[1:] = 0, shorter[:-1]
            with np.errstate(over="ignore"):
                h = before * np.uint64(0x9E3779B97F4A7C15) + (self.hash ^ (self.hash >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            self.grams[n] = h ^ (h >> np.uint64(29))
        return self.grams[n]

    def asked(self, n: int, min_count: int) -> np.ndarray:
        """Where the n-gram's total is asked for: also in repeated history, which adds nothing to the total."""
        ok = self.place >= n - 1
        if n > 2 and min_count > 1:
            enough = self.counts[n - 1] >= min_count
            ok &= enough
            ok[1:] &= enough[:-1]
        return ok

    def put(self, n: int, totals: np.ndarray, min_count: int) -> None:
        """Totals of the distinct n-grams in hash order, as asked."""
        at = self.asked(n, min_count)
        _, which = np.unique(self.gram(n)[at], return_inverse=True)
        self.counts[n] = np.zeros(len(self.hash), dtype=np.int64)
        self.counts[n][at] = totals[which]

    def score(self, order: int, total: int, alpha: float, min_count: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: log S, and the order it was found at."""
        found = np.ones(len(self.hash), dtype=np.int64)
        with np.errstate(divide="ignore"):
            best = np.log(self.counts[1]) - np.log(max(total, 1))
            for n in range(2, order + 1):
                there = self.place >= n - 1
                hit = there & self.own & (self.counts[n] >= min_count)
                at = np.flatnonzero(hit)
                best[there] += np.log(alpha)
                best[at] = np.log(self.counts[n][at]) - np.log(self.counts[n - 1][at - 1])
                found[at] = n
        return best, found


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _ask(block: int, b: Block, n: int, buckets: int, min_count: int, part: int = 0, parts: int = 1) -> Iterator[tuple]:
    """The distinct n-grams of a block, by bucket; only those of every ``parts``-th bucket."""
    at = b.asked(n, min_count)
    grams, own = b.gram(n)[at], b.own[at]
    if parts > 1:
        now = _bucket(grams, buckets) % np.uint64(parts) == part
        grams, own = grams[now], own[now]
    grams, which = np.unique(grams, return_inverse=True)
    counts = np.bincount(which, weights=own, minlength=len(grams))
    edges = np.searchsorted(_bucket(grams, buckets), np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        part = slice(edges[k], edges[k + 1])
        yield int(k), block, n, _deltas(grams[part]), _planes(counts[part].astype("<u4"))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


_ASK_NAMES, _ASK_KINDS = ["bucket", "block", "n", "grams", "counts"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _add_up(table: pa.Table) -> pa.Table:
    """One bucket of the count table of an order: totals of each n-gram, told to every block that asked."""
    out = []
    rows = table.to_pylist()
    for n in sorted({r["n"] for r in rows}):
        asked = [r for r in rows if r["n"] == n]
        grams = [_undeltas(r["grams"]) for r in asked]
        keys, which = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(which, weights=np.concatenate([_unplanes(r["counts"], "<u4") for r in asked]), minlength=len(keys)).astype("<u8")
        ends = np.cumsum([len(g) for g in grams])
        out += [(r["block"], n, r["bucket"], _planes(totals[which[e - len(g):e]])) for r, g, e in zip(asked, grams, ends)]
    return _table(out, ["block", "n", "bucket", "totals"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])


def _load(block: pa.Table, told: pa.Table, min_count: int) -> Block:
    b = Block(block.to_pylist()[0])
    rows = sorted(told.to_pylist(), key=lambda r: (r["n"], r["bucket"]))
    for n, group in itertools.groupby(rows, key=lambda r: r["n"]):
        b.put(n, np.concatenate([_unplanes(r["totals"], "<u8") for r in group]).astype(np.int64), min_count)
    return b


# ---- the plan ----------------------------------------------------------------------------------

def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA,
              min_count: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, log_score, and hits (how many words were found at each order, from 1).

    ``min_count`` 1 is plain stupid backoff, as in the registered query; above, rarer n-grams are scored as unseen.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(tasks(docs), n_bytes // BUCKET_BYTES)
    name = f"llm_blocks_{uuid.uuid4().hex[:12]}"
    (texts.mapInArrow(_make_blocks(order, block_words), _BLOCK).write.option("compression", "zstd")
     .option("path", scratch_path(spark, "llm_blocks")).bucketBy(int(max(tasks(docs), n_bytes // (64 << 20))), "block").saveAsTable(name))
    try:
        return _score_blocks(spark.table(name), order, alpha, min_count, int(buckets), int(max(1, min(PASSES, n_bytes // BUCKET_BYTES))))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _score_blocks(blocks: DataFrame, order: int, alpha: float, min_count: int, buckets: int, parts: int) -> DataFrame:
    total = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    at_once = order if min_count <= 1 else min(order, 2)

    def first(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    b = Block(row)
                    for n in range(1, at_once + 1):
                        yield from _table(list(_ask(row["block"], b, n, buckets, min_count, part, parts)), _ASK_NAMES, _ASK_KINDS).to_batches()
        return run

    def longer(n: int):
        def run(block: pa.Table, told: pa.Table) -> pa.Table:
            if not len(block):
                return _table([], _ASK_NAMES, _ASK_KINDS)
            return _table(list(_ask(block["block"][0].as_py(), _load(block, told, min_count), n, buckets, min_count)), _ASK_NAMES, _ASK_KINDS)
        return run

    def totals(asked: DataFrame) -> DataFrame:
        return materialize(asked.groupBy("bucket", "n").applyInArrow(_add_up, _TOLD), "ngram_totals")

    told = totals(blocks.mapInArrow(first(0), _ASK))
    for part in range(1, parts):  # the buckets in turns: what a turn has shuffled is answered, and goes, before the next
        blocks.sparkSession.sparkContext._jvm.System.gc()  # Spark removes the shuffle files of plans that nothing holds
        told = told.unionByName(totals(blocks.mapInArrow(first(part), _ASK)))
    for n in range(at_once + 1, order + 1):
        asked = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(longer(n), _ASK)
        told = told.unionByName(totals(asked))

    names = ["rid", "doc_id", "n_words", "log_score", "hits"]

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        if not len(block):
            return _table([], names, kinds)
        b, row = _load(block, found, min_count), block.to_pylist()[0]
        parts = np.repeat(np.arange(len(b.lengths)), b.lengths)[b.own]
        if len(parts):
            best, at = b.score(order, total, alpha, min_count)
            best, at = best[b.own], at[b.own]
        else:
            best, at = np.zeros(0), np.zeros(0, dtype=np.int64)
        size = len(b.lengths)
        sums = np.bincount(parts, weights=best, minlength=size)
        hits = np.stack([np.bincount(parts[at == n], minlength=size) for n in range(1, order + 1)], axis=1)
        return _table(list(zip(row["rid"], row["doc_id"], (b.lengths - b.context).tolist(), sums.tolist(), hits.tolist())), names, kinds)

    scored = (blocks.groupBy("block").cogroup(told.groupBy("block"))
              .applyInArrow(score, "rid long, doc_id long, n_words long, log_score double, hits array<long>"))
    sums = materialize(scored, "lm_parts").groupBy("rid").agg(  # a text of several blocks has a row of each
        F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"),
        *[F.sum(F.col("hits")[n]).alias(f"_h{n}") for n in range(order)])
    return sums.select("doc_id", "n_words", "log_score", F.array(*[f"_h{n}" for n in range(order)]).alias("hits"))


_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w3, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT rid, i, w3, lag(w3) OVER p AS w2, lag(w3, 2) OVER p AS w1 FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
c1 AS (SELECT w3, count(*) AS c FROM g GROUP BY w3),
c2 AS (SELECT w2, w3, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY w2, w3),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY w1, w2, w3),
s AS (SELECT g.rid, g.i, CASE WHEN c3.c >= {MIN_COUNT} THEN 3 WHEN c2.c >= {MIN_COUNT} THEN 2 ELSE 1 END AS n,
        CASE WHEN c3.c >= {MIN_COUNT} THEN ln(c3.c) - ln(h2.c)
             WHEN c2.c >= {MIN_COUNT} THEN ln(c2.c) - ln(h1.c) + least(g.i - 2, 1) * ln({ALPHA})
             ELSE ln(c1.c) - ln((SELECT count(*) FROM g)) + least(g.i - 1, 2) * ln({ALPHA}) END AS s
      FROM g JOIN c1 ON g.w3 = c1.w3 LEFT JOIN c2 ON g.w2 = c2.w2 AND g.w3 = c2.w3
        LEFT JOIN c3 ON g.w1 = c3.w1 AND g.w2 = c3.w2 AND g.w3 = c3.w3
        LEFT JOIN c1 AS h1 ON g.w2 = h1.w3 LEFT JOIN c2 AS h2 ON g.w1 = h2.w2 AND g.w2 = h2.w3),
t AS (SELECT rid, sum(s) AS s, count(*) FILTER (n = 1) AS h1, count(*) FILTER (n = 2) AS h2, count(*) FILTER (n = 3) AS h3 FROM s GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score, coalesce(h1, 0) AS hits_1, coalesce(h2, 0) AS hits_2, coalesce(h3, 0) AS hits_3
FROM d LEFT JOIN t ON d.rid = t.rid"""


@register("op3_lm_score", _SQL)
def op3_lm_score(spark, sf_dir):
    out = lm_scores(documents(spark, sf_dir), min_count=MIN_COUNT)
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), *[F.col("hits")[n].alias(f"hits_{n + 1}") for n in range(ORDER)])
