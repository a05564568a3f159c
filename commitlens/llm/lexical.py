"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.  With N documents that
have a term, L terms in all of them, n terms of a document, df documents with a term and tf its occurrences in the document,

    w = floor(1000 ln((2 N + 2) / (2 df + 1))),   m = 10 + (90 n N) div L,
    score = sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 8 m)).

* **Index** (once per collection): documents of similar size make a block.  A document's signature is a Bloom filter of its
  (term, level) pairs: level i is set where tf reaches the i-th of 1, 2, 3, 4, 6, 8, 12, ... A block is stored by bits: a row of
  the filter is a bitmap over the documents.  Texts that repeat in a block are one column with their ten first ids: no other
  can come into ten.  The same pass counts df of every term, N and L.
* **Bounds**: the rows of a (term, level) are intersected; the result has every document where tf reaches the level, and few
  others.  A weighted sum of these slices, each level adding what the score gains up to the tf below the next level, is an
  upper bound of the score of every document of the block.
* **Threshold**: the documents with the highest bounds, twice as many as are asked for, are scored exactly from their texts; the tenth score is the
  least that counts.  All documents whose bound reaches it, however many, are scored exactly; the rest are provably out.

The index holds every document; items are taken in blocks of about ``QUERY_TERMS`` terms.  Rows that share an item_id are one
item with the terms of all.  Null texts have no terms; items without terms that occur have no rows.  Equal scores go by
ascending doc_id, null ids last; repeated rows are documents of their own.  Empty tables give an empty result.  Only ids and
texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import load_table
from .common import documents, materialize, register, same, text_key

TOP = 10
#: distinct terms of the items that are searched at once
QUERY_TERMS = 1 << 14
#: slices of an item's rows that are ranked before all are
SLICES = 16
#: bits of a signature for each (term, level), at least; hash functions
BITS, HASHES = 12, 6
#: the longest signature; larger documents have more false bits, which only loosens their bounds
MOST_BITS = 1 << 21
#: (term, level) pairs, cells of the bit matrix, and documents of a block
BLOCK_PAIRS, BLOCK_CELLS, BLOCK_DOCS = 1 << 19, 1 << 24, 1 << 12
#: distinct terms that a task counts before it passes the counts on
VOCABULARY = 1 << 20
#: a tf reaches level i if it is at least LEVELS[i]: powers of two, and halfway
LEVELS = np.array(sorted({1} | {2 ** i for i in range(1, 40)} | {3 * 2 ** i for i in range(39)}), dtype=np.int64)
#: the pattern of a term
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: bytes that belong to no term become a blank, A-Z become a-z
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_INDEX = "bits int, width int, slices binary, n array<long>, keys array<long>, ids array<array<long>>, terms array<binary>, dfs array<long>, n_docs long, n_terms long"
_FOUND = "item int, bound long, doc_id long, key_of_text long"


def terms_of(data: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return (data or b"").translate(_FOLD).split()


def term_array(text: Column) -> Column:
    """The terms of a text as an array column."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(TERM), F.lit(0))


# ---- signatures ------------------------------------------------------------------------------------

def _pair_hash(term: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (term + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _row(pair: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th row of the filter (of ``bits`` rows, a power of two) that a pair sets."""
    with np.errstate(over="ignore"):
        return ((pair + np.uint64(i) * ((pair >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


class _Block:
    """Documents whose signatures have the same length."""

    def __init__(self, bits: int):
        self.bits, self.pairs, self.n, self.keys, self.ids, self.places, self.held = bits, [], [], [], [], {}, 0

    def add(self, digest: bytes, doc_id: int | None, key: int, n: int, pairs: np.ndarray) -> None:
        at = self.places.get(digest)
        if at is None:
            self.places[digest] = len(self.n)
            self.n.append(n), self.keys.append(key), self.ids.append([doc_id]), self.pairs.append(pairs)
            self.held += len(pairs)
        else:
            self.ids[at].append(doc_id)
            if len(self.ids[at]) > 64:
                self.ids[at] = _first_ids(self.ids[at])

    def full(self) -> bool:
        return self.held >= BLOCK_PAIRS or len(self.n) * self.bits >= BLOCK_CELLS or len(self.n) >= BLOCK_DOCS

    def batch(self) -> pa.RecordBatch:
        width = -(-len(self.n) // 8)
        cells = np.zeros((self.bits, width * 8), dtype=bool)
        pairs, column = np.concatenate(self.pairs), np.repeat(np.arange(len(self.n)), [len(p) for p in self.pairs])
        for i in range(HASHES):
            cells[_row(pairs, i, self.bits), column] = True
        return _index_batch(bits=self.bits, width=width, slices=np.packbits(cells, axis=1, bitorder="little").tobytes(), n=self.n, keys=self.keys,
                            ids=[_first_ids(i) for i in self.ids])


def _first_ids(ids: list[int | None]) -> list[int | None]:
    return sorted(ids, key=lambda i: (i is None, i or 0))[:TOP]


def _index_batch(**row) -> pa.RecordBatch:
    kinds = {"bits": pa.int32(), "width": pa.int32(), "slices": pa.binary(), "n": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "ids": pa.list_(pa.list_(pa.int64())),
             "terms": pa.list_(pa.binary()), "dfs": pa.list_(pa.int64()), "n_docs": pa.int64(), "n_terms": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([row.get(k)], t) for k, t in kinds.items()], list(kinds))


def _make_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place: dict[bytes, int] = {}  # term -> number in this task
    hashes, df = np.zeros(1 << 10, dtype="<u8"), np.zeros(1 << 10, dtype=np.int64)
    n_docs = n_terms = 0
    blocks: dict[int, _Block] = {}

    def counts() -> pa.RecordBatch:
        return _index_batch(terms=list(place), dfs=df[:len(place)], n_docs=n_docs, n_terms=n_terms)

    for b in batches:
        for doc_id, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
            data = text.as_py() or b""
            words = terms_of(data)
            if not words:
                continue
            for w in set(words).difference(place):
                at = place[w] = len(place)
                if at == len(df):
                    hashes, df = np.concatenate([hashes, np.zeros_like(hashes)]), np.concatenate([df, np.zeros_like(df)])
                hashes[at] = xxhash.xxh64_intdigest(w)
            found, tf = np.unique(np.fromiter(map(place.__getitem__, words), np.int64, len(words)), return_counts=True)
            df[found] += 1
            n_docs, n_terms = n_docs + 1, n_terms + len(words)
            levels = np.searchsorted(LEVELS, tf, side="right")
            level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
            pairs = _pair_hash(np.repeat(hashes[found], levels), level)
            bits = min(MOST_BITS, 1 << int(BITS * len(pairs) - 1).bit_length())
            block = blocks.setdefault(bits, _Block(bits))
            block.add(xxhash.xxh3_128_digest(data), doc_id, key, len(words), pairs)
            if block.full():
                yield blocks.pop(bits).batch()
            if len(place) >= VOCABULARY:
                yield counts()
                place, n_docs, n_terms = {}, 0, 0
                df[:] = 0
    for block in blocks.values():
        yield block.batch()
    if n_docs:
        yield counts()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written once: rows with ``slices`` are blocks, rows with ``terms`` are counts."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key_of_text"), text.alias("text"))
    return materialize(rows.mapInArrow(_make_index, _INDEX), "lexical_index")


# ---- bounds ----------------------------------------------------------------------------------------

class Query:
    """A block of items: distinct terms with their weights, and the terms of each item."""

    def __init__(self, rows: list[tuple[int, bytes, int]], n_docs: int, n_terms: int, items: int):
        self.terms = sorted({t for _, t, _ in rows})
        place = {t: i for i, t in enumerate(self.terms)}
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in self.terms], dtype="<u8")
        self.weight = np.zeros(len(self.terms), dtype=np.int64)
        self.of_item: list[list[int]] = [[] for _ in range(items)]
        for item, term, df in rows:
            self.weight[place[term]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            self.of_item[item].append(place[term])
        self.n_docs, self.n_terms = n_docs, n_terms

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """8 m of documents of n terms."""
        return 8 * (10 + 90 * n * self.n_docs // self.n_terms)

    def bounds(self, row: dict) -> np.ndarray:
        """Upper bounds of the score: items x documents of the block."""
        n = np.array(row["n"], dtype=np.int64)
        width, bits, long = row["width"], row["bits"], self.lengths(n)
        slices = np.frombuffer(row["slices"], dtype=np.uint8).reshape(bits, width)
        out = np.zeros((len(self.of_item), len(n)), dtype=np.float64)
        before, alive, reached = np.zeros(len(n), dtype=np.int64), np.arange(len(self.terms)), None
        for level in range(len(LEVELS)):
            pair = _pair_hash(self.hashes[alive], level)
            maps = slices[_row(pair, 0, bits)]
            for i in range(1, HASHES):
                maps &= slices[_row(pair, i, bits)]
            if reached is not None:
                maps &= reached
            there = maps.any(axis=1)
            if not there.any():
                break
            alive, reached = alive[there], maps[there]
            most = np.minimum(n, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else n
            worth = 1_000_000_000 * most // (1000 * most + long)
            gain, before = worth - before, worth
            at = np.full(len(self.terms), -1)
            at[alive] = np.arange(len(alive))
            has = np.unpackbits(reached, axis=1, count=len(n), bitorder="little")
            for item, terms in enumerate(self.of_item):
                rows = at[terms]
                some = rows >= 0
                if some.any():  # whole numbers far below 2^53
                    out[item] += (self.weight[terms][some].astype(np.float64) @ has[rows[some]]) * gain
        return out

    def score(self, data: bytes, items: list[int]) -> list[int]:
        """The scores of a text."""
        words = terms_of(data)
        wanted = {self.terms[t]: t for i in items for t in self.of_item[i]}
        tf = dict.fromkeys(wanted.values(), 0)
        for w in words:
            if w in wanted:
                tf[wanted[w]] += 1
        long = int(self.lengths(np.int64(len(words)))) if words else 0
        return [sum(int(self.weight[t]) * (1_000_000_000 * tf[t] // (1000 * tf[t] + long)) for t in self.of_item[i] if tf[t]) for i in items]


def _highest(query: Query, first: int):
    """The ``first`` documents of a task with the highest bounds, for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in query.of_item]
        for row in (r for b in batches for r in b.to_pylist()):
            bounds = query.bounds(row)
            for item, own in enumerate(best):
                b = bounds[item]
                least = own[first - 1][0] if len(own) >= first else 0
                at = np.flatnonzero(b > least)
                if len(at):
                    at = at[np.argsort(-b[at], kind="stable")[:first]]
                    own += [(int(b[c]), row["keys"][c], row["ids"][c]) for c in at]
                    own.sort(key=lambda t: -t[0])
                    del own[first:]
        rows = [(item, bound, i, key) for item, own in enumerate(best) for bound, key, ids in own for i in ids]
        yield _found(rows)
    return run


def _reaching(query: Query, least: np.ndarray):
    """All documents whose bound is at least the item's threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            bounds = query.bounds(row)
            items, columns = np.nonzero(bounds >= np.maximum(least, 1)[:, None])
            if len(items):
                yield _found([(int(t), int(bounds[t, c]), i, row["keys"][c]) for t, c in zip(items, columns) for i in row["ids"][c]])
    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                                      ["item", "bound", "doc_id", "key_of_text"])


# ---- exact scores ------------------------------------------------------------------------------------

def _exact(docs: DataFrame, found: DataFrame, query: Query, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, score) of every document row that is asked for, scored from its text; scores above 0."""
    asked = found.groupBy("doc_id", "key_of_text").agg(F.collect_set("item").alias("items"))
    asked = materialize(asked.select(F.col("doc_id").alias("_id"), F.col("key_of_text").alias("_key"), "items"), "lexical_asked")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key_of_text"), F.col(text_col).alias("text"))
    # the written list has a known size: the planner broadcasts it if it is small, and texts then stay where they are read
    met = texts.join(asked, same(F.col("doc_id"), F.col("_id")) & (F.col("key_of_text") == F.col("_key"))).select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text, items in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
                scores = query.score(text.as_py() or b"", items)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array([doc_id] * len(items), pa.int64()), pa.array(scores, pa.int64())],
                                                 ["item", "doc_id", "score"])

    return met.mapInArrow(run, "item int, doc_id long, score long").filter("score > 0")


def _first(rows: DataFrame, n: int, by: str, rank: str, *ties: str) -> DataFrame:
    """The n rows of each item that are highest by a column, then smallest by doc_id (null last); first within slices of the
    item, so that its last step reads n rows a slice however many tasks had some."""
    order = [F.col(by).desc(), F.col("doc_id").asc_nulls_last(), *ties]
    part = rows.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    part = part.withColumn(rank, F.row_number().over(Window.partitionBy("item", "_slice").orderBy(*order))).filter(F.col(rank) <= n).drop("_slice")
    return part.withColumn(rank, F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col(rank) <= n)


def _top(scored: DataFrame, top: int) -> DataFrame:
    return _first(scored, top, "score", "rank")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                   item_text_col: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` (at most ten) highest-scoring documents of each item."""
    if not 1 <= top <= TOP:
        raise ValueError(f"top must be from 1 to {TOP}")
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    counted, blocks = index.filter("terms IS NOT NULL"), index.filter("slices IS NOT NULL").select("bits", "width", "slices", "n", "keys", "ids")
    n = counted.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    kind = dict(items.dtypes)[item_id_col]
    asked = items.select(F.col(item_id_col).alias("item_id"), F.explode(term_array(F.col(item_text_col))).alias("term")).distinct()
    wanted = asked.select("term").distinct()
    entries = counted.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select(F.col("e.terms").cast("string").alias("term"), F.col("e.dfs").alias("df"))
    df = entries.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    known = asked.join(df, "term")  # terms that occur
    parts = max(1, math.ceil(known.count() / query_terms))
    known = materialize(known.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")), "lexical_terms")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in range(parts):
        rows = known.filter(F.col("part") == part).select("item_id", "term", "df").collect()  # about ``query_terms`` terms
        if not rows:
            continue
        names = list(dict.fromkeys(r["item_id"] for r in rows))
        number = {name: i for i, name in enumerate(names)}
        query = Query([(number[r["item_id"]], r["term"].encode(), r["df"]) for r in rows], n["docs"], n["terms"], len(names))
        highest = blocks.mapInArrow(_highest(query, 2 * top), _FOUND)
        first = _top(_exact(docs, _first(highest, 2 * top, "bound", "place", "key_of_text"), query, id_col, text_col), top)
        least = np.zeros(len(names), dtype=np.int64)
        for r in first.filter(F.col("rank") == top).select("item", "score").collect():  # one row an item
            least[r["item"]] = r["score"]
        reaching = blocks.mapInArrow(_reaching(query, least), _FOUND)
        best = _top(_exact(docs, reaching, query, id_col, text_col), top)
        labels = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        out = out.unionByName(materialize(best.join(labels, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical_best"))
    return out


_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM documents),
g AS (SELECT count(*) FILTER (len(ts) > 0) AS nd, sum(len(ts))::BIGINT AS nt FROM d),
o AS (SELECT rid, unnest(ts) AS term FROM d),
f AS (SELECT rid, term, count(*) AS tf FROM o GROUP BY rid, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, g WHERE term IN (SELECT term FROM q) GROUP BY term, nd),
s AS (SELECT q.item_id, d.doc_id, f.rid, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * len(d.ts) * g.nd) // g.nt))))::BIGINT AS score
      FROM q JOIN w ON w.term = q.term JOIN f ON f.term = q.term JOIN d ON d.rid = f.rid, g GROUP BY q.item_id, d.doc_id, f.rid)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= {TOP}"""


@register("op11_lexical_search", _SQL)
def op11_lexical_search(spark, sf_dir):
    return lexical_search(documents(spark, sf_dir), load_table(spark, sf_dir, "benchmark"))
