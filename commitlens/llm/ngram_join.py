"""N-gram Jaccard self-join that skips by set relations.

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z lower-cased; runs of characters other than the six
ASCII white-space characters); with fewer words the whole sequence is the one shingle; without words the set is empty and
linked with nothing.  Two documents link when 100 * |intersection| >= ``PERCENT`` * |union|.  Result: one row per input row
with the size of its set, its component and the number of other documents it links with.

* **Sets**: shingles are 64-bit hashes, sorted; equal sets (128-bit digest) are one set with its number of copies, so copies
  cost one row a task.  Sets are stored in blocks of about ``BLOCK`` shingles, in a table bucketed by block.
* **Frequencies**: a block sends its distinct shingles once, cut to the bits that tell this many apart, to hash ranges;
  a range adds up and sends one byte each back: the class of the frequency (0: in one set only).  A collision only
  makes a shingle look more frequent, which is safe.
* **Prefixes**: with shingles in order of (class, hash), two sets that link share one among the first
  n - ceil(PERCENT % of n) + 1 of each.  Shingles of one set only are matched by none: a set that has more of them than
  that leaves here, as most texts without near copies do.
* **Cells**: sets that share a prefix shingle are tied to the smallest of its list; components of these ties go to cells
  whole, many small ones to a cell.  A component that is too large is cut by size and hash, and its parts meet in cells of
  two, but only parts whose sizes can link: every group of rows in a task is bounded.
* **Index-level skipping**, in a cell: sets come in order of size; the list of a prefix shingle is kept in blocks by
  position.  From the sizes and the first common place follows which sizes a block can still link with; blocks that
  have none are skipped whole, others are entered at the first that can.
* **Answer-level skipping**: a set that meets many candidates becomes a leader: its overlaps with all sets of the cell are
  counted once.  A set highly similar to a leader derives its own overlaps from the leader's: it adds the lists of
  the shingles that only it has and takes off those that only the leader has.  No list of its prefix is read.
* A cell gives spanning links and the numbers of links, never the pairs; star components tie them up.

Null ids come last among the members of a component.  Repeated rows count, and have equal results.  Null and empty texts
have size 0, no links, and their own doc_id.  An empty table gives an empty result.  Only ids and texts are read.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, bisect_right
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
from .components import connected_components
from .lm_score import _deltas, _planes, _table, _text_words, _undeltas, _unplanes

SHINGLE = 4
PERCENT = 85
#: shingles in a block of sets
BLOCK = 1 << 19
#: documents in a block
BLOCK_DOCS = 1 << 17
#: bytes of text for each hash range of shingles
BUCKET_BYTES = 16 << 20
#: sets, and shingles, that meet in a cell
CELL_SETS, CELL_TOKENS = 4096, 1 << 20
#: positions in a block of an index list
POSITIONS = 8
#: candidates from which a set counts its overlaps with the whole cell
MANY = 128
#: leaders whose overlaps are kept in a cell
LEADERS = 64
#: prefix shingles that are tied up at once
ENTRIES = 1 << 20
#: distinct words whose hashes a task keeps
WORDS = 1 << 20

_SETS = "block long, doc_id array<long>, at array<int>, digests array<binary>, sizes array<int>, tokens binary"
_ASK = "bucket int, block long, grams binary, counts binary"
_ASK_NAMES, _ASK_KINDS = ["bucket", "block", "grams", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_TOLD = "block long, bucket int, classes binary"
_ALIVE = "sid long, n int, skip int, n_tokens int, tokens binary"
_FOUND = "kind int, u long, v long, docs long"
#: a set's number is block << SLOT_BITS plus its place in the block
SLOT_BITS = 22


# ---- sets ----------------------------------------------------------------------------------------

def _mix(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """One 64-bit hash for each sequence of word hashes (parts[i] has the i-th words)."""
    h = np.full(len(parts[0]), seed, dtype="<u8")
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return h


def _shingles(words: Iterator[np.ndarray], k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text whose word hashes come in pieces."""
    found, history = [], np.zeros(0, dtype="<u8")
    for piece in words:
        h = np.concatenate([history, piece])
        if len(h) >= k:
            found.append(np.unique(_mix([h[i:len(h) - k + 1 + i] for i in range(k)], k)))
            history = h[len(h) - k + 1:]
        else:
            history = h
    if not found:
        return _mix([history[i:i + 1] for i in range(len(history))], len(history)) if len(history) else history
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _make_sets(shingle: int, block_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        hashes: dict[bytes, int] = {}

        def hashed(words: list[bytes]) -> np.ndarray:
            if len(hashes) > WORDS:
                hashes.clear()
            for w in set(words).difference(hashes):
                hashes[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(hashes.__getitem__, words), "<u8", len(words))

        ids, at, digests, sizes, tokens, places, held = [], [], [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            cols = [[(task << 20) + number], [ids], [at], [digests], [sizes], [b"".join(tokens)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["block", "doc_id", "at", "digests", "sizes", "tokens"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                s = _shingles((hashed(w) for w in _text_words(text.as_py() or b"")), shingle)
                ids.append(doc_id)
                if not len(s):
                    at.append(None)
                else:
                    raw = s.tobytes()
                    digest = xxhash.xxh3_128_digest(raw)
                    if digest not in places:
                        places[digest] = len(digests)
                        digests.append(digest), sizes.append(len(s)), tokens.append(raw)
                        held += len(s)
                    at.append(places[digest])
                if held >= block_size or len(ids) >= BLOCK_DOCS:
                    yield block()
                    number += 1
                    ids, at, digests, sizes, tokens, places, held = [], [], [], [], [], {}, 0
        if ids:
            yield block()
    return run


def _pieces(block: dict, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of the chosen sets one after the other, their sizes)."""
    flat, sizes = np.frombuffer(block["tokens"], dtype="<u8"), np.array(block["sizes"], dtype=np.int64)
    ends = np.cumsum(sizes)
    if len(which) == len(sizes):
        return flat, sizes
    return (np.concatenate([flat[ends[i] - sizes[i]:ends[i]] for i in which]) if len(which) else flat[:0]), sizes[which]


# ---- frequencies -----------------------------------------------------------------------------------

def _asks(shift: int, buckets: int):
    def run(block: pa.Table, owned: pa.Table) -> pa.Table:
        if not len(block) or not len(owned):
            return _table([], _ASK_NAMES, _ASK_KINDS)
        which = np.sort(np.array(owned["slots"][0].as_py(), dtype=np.int64))
        flat, _ = _pieces(block.to_pylist()[0], which)
        grams, counts = np.unique(flat >> np.uint64(shift), return_counts=True)
        edges = np.searchsorted(_bucket(grams, shift, buckets), np.arange(buckets + 1))
        rows = [(int(k), block["block"][0].as_py(), _deltas(grams[a:b]), _planes(counts[a:b].astype("<u4")))
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return _table(rows, _ASK_NAMES, _ASK_KINDS)
    return run


def _bucket(grams: np.ndarray, shift: int, buckets: int) -> np.ndarray:
    """The hash range of a cut shingle: by its upper bits, so that ranges follow the order."""
    return ((grams >> np.uint64(32 - shift)) * np.uint64(buckets)) >> np.uint64(32)


def _classes(table: pa.Table) -> pa.Table:
    """One range: the class of the frequency of each shingle, told to every block that asked."""
    rows = table.to_pylist()
    grams = [_undeltas(r["grams"]) for r in rows]
    keys, which = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(which, weights=np.concatenate([_unplanes(r["counts"], "<u4") for r in rows]), minlength=len(keys))
    classes = np.where(totals < 2, 0, np.minimum(255, np.ceil(4 * np.log2(np.maximum(totals, 2))))).astype(np.uint8)
    ends = np.cumsum([len(g) for g in grams])
    out = [(r["block"], r["bucket"], classes[which[e - len(g):e]].tobytes()) for r, g, e in zip(rows, grams, ends)]
    return _table(out, ["block", "bucket", "classes"], [pa.int64(), pa.int32(), pa.binary()])


def _needed(n, percent: int):
    """The least intersection that a set of n shingles has with any set it links with."""
    return (percent * n + 99) // 100


def _alive(shift: int, percent: int):
    """The sets that can link at all, without the shingles that no other set has, in order of (class, hash)."""
    names, kinds = ["sid", "n", "skip", "n_tokens", "tokens"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        if not len(block) or not len(told):
            return _table([], names, kinds)
        rows = sorted(told.to_pylist(), key=lambda r: r["bucket"])
        which = np.sort(np.array(rows[0]["slots"], dtype=np.int64))  # bucket -1: the sets that this block owns
        flat, sizes = _pieces(block.to_pylist()[0], which)
        classes = np.frombuffer(b"".join(r["classes"] for r in rows[1:]), dtype=np.uint8)
        _, back = np.unique(flat >> np.uint64(shift), return_inverse=True)
        cls, start, out = classes[back], np.cumsum(sizes) - sizes, []
        skips = np.add.reduceat((cls == 0).astype(np.int64), start) if len(start) else start
        for i in np.flatnonzero(sizes - skips >= _needed(sizes, percent)):
            part = slice(start[i], start[i] + sizes[i])
            c, t = cls[part], flat[part]
            order = np.argsort(c, kind="stable")[skips[i]:]  # the hashes are sorted already
            out.append(((block["block"][0].as_py() << SLOT_BITS) + int(which[i]), int(sizes[i]), int(skips[i]), len(order), t[order].tobytes()))
        return _table(out, names, kinds)
    return run


# ---- cells -----------------------------------------------------------------------------------------

def _entries(percent: int):
    """Lists of the prefixes, tied up within the task: (token, smallest sid here) once a token, and without a token the ties
    (sid, smaller sid) of sets that share one here.  So a list as long as the table is one entry a task."""
    def tied(tokens: list[np.ndarray], sids: list[np.ndarray]) -> pa.RecordBatch:
        t, s = np.concatenate(tokens), np.concatenate(sids)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        first = np.flatnonzero(np.diff(t, prepend=~t[:1]))
        least = np.repeat(s[first], np.diff(np.append(first, len(t))))
        ties = np.unique(np.stack([s, least])[:, s != least], axis=1)
        token = pa.concat_arrays([pa.array(t[first]), pa.nulls(ties.shape[1], pa.int64())])
        return pa.RecordBatch.from_arrays([token, pa.array(np.concatenate([s[first], ties[0]])), pa.array(np.concatenate([s[first], ties[1]]))], ["token", "sid", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sids, held = [], [], 0
        for r in (r for b in batches for r in b.to_pylist()):
            t = np.frombuffer(r["tokens"], dtype="<i8")[:r["n"] - _needed(r["n"], percent) + 1 - r["skip"]]
            tokens.append(t), sids.append(np.full(len(t), r["sid"]))
            held += len(t)
            if held >= ENTRIES:
                yield tied(tokens, sids)
                tokens, sids, held = [], [], 0
        if held:
            yield tied(tokens, sids)
    return run


def _cells(alive: DataFrame, ties: DataFrame, percent: int) -> DataFrame:
    """(sid, cell, side): the cells each set goes to.  In a cell of two parts, pairs are of both sides."""
    known = materialize(alive.select("sid", "n", "n_tokens").join(ties, F.col("sid") == F.col("node")).select("sid", "n", "n_tokens", "root"), "jaccard_ties")
    size = known.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_tokens").alias("toks"))
    is_small = (F.col("sets") <= CELL_SETS) & (F.col("toks") <= CELL_TOKENS // 2)
    total = size.filter(is_small).agg(F.sum("toks").alias("t"), F.sum("sets").alias("s")).first()
    cells = max(1, math.ceil((total["t"] or 0) * 2 / CELL_TOKENS), math.ceil((total["s"] or 0) / CELL_SETS / 4))
    placed = known.join(size, "root")
    small = placed.filter(is_small).select("sid", F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(cells))).alias("cell"), F.lit(0).alias("side"))
    # a step is a size ratio of 1.04: sets more than ``reach`` steps apart can't link
    reach = math.ceil(math.log(100 / percent) / math.log(1.04)) + 1 if percent else 1 << 30
    large = placed.filter(~is_small).withColumn("step", F.floor(F.log("n") / F.lit(math.log(1.04))).cast("int"))
    cut = large.groupBy("root", "step").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(CELL_SETS / 2)), F.ceil(F.sum("n_tokens") / F.lit(CELL_TOKENS // 2))).cast("int").alias("parts"))
    cut = materialize(cut, "jaccard_parts")
    parts = cut.select("root", "step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    a, b = parts.alias("a"), parts.select("root", F.col("step").alias("step2"), F.col("part").alias("part2")).alias("b")
    pairs = a.join(b, "root").filter((F.col("step2") - F.col("step")).between(0, reach) & (
        (F.col("step2") > F.col("step")) | (F.col("part2") >= F.col("part"))))
    cell = F.concat_ws("/", F.lit("p"), "root", "step", "part", "step2", "part2").alias("cell")
    both = pairs.select("root", "step", "part", cell, F.lit(0).alias("side")).unionByName(
        pairs.filter("step <> step2 OR part <> part2").select("root", F.col("step2").alias("step"), F.col("part2").alias("part"), cell, F.lit(1).alias("side")))
    dealt = large.join(cut, ["root", "step"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    return small.unionByName(dealt.join(both, ["root", "step", "part"]).select("sid", "cell", "side"))


class Cell:
    """The sets of a cell in order of size, and the links among them."""

    def __init__(self, rows: list[dict], percent: int):
        rows = sorted(rows, key=lambda r: (r["n"], r["sid"]))
        self.percent = percent
        self.sid = np.array([r["sid"] for r in rows], dtype=np.int64)
        self.n = np.array([r["n"] for r in rows], dtype=np.int64)
        self.side = np.array([r["side"] for r in rows], dtype=np.int64)
        self.copies = np.array([r["copies"] for r in rows], dtype=np.int64)
        self.skip = [r["skip"] for r in rows]
        flat = np.frombuffer(b"".join(r["tokens"] for r in rows), dtype="<u8")
        self.size = np.array([r["n_tokens"] for r in rows], dtype=np.int64)
        self.end = np.cumsum(self.size)
        words, back = np.unique(flat, return_inverse=True)
        self.flat = back.astype(np.int32)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), self.size)
        order = np.argsort(self.flat, kind="stable")
        self.listed = owner[order]  # sets by shingle
        self.list_at = np.searchsorted(self.flat[order], np.arange(len(words) + 1))
        self.mark = np.zeros(len(words), dtype=bool)
        self.leaders: dict[int, np.ndarray] = {}
        self.leader_of: dict[int, int] = {}
        self.derived = self.counted = 0

    def tokens(self, i: int) -> np.ndarray:
        return self.flat[self.end[i] - self.size[i]:self.end[i]]

    def _count(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the shingles each set of the cell has."""
        if not len(tokens):
            return np.zeros(len(self.n), dtype=np.int64)
        return np.bincount(np.concatenate([self.listed[self.list_at[t]:self.list_at[t + 1]] for t in tokens]), minlength=len(self.n))

    def _from_leader(self, x: int, prefix: np.ndarray) -> np.ndarray | None:
        """Overlaps of x with every set, from those of a leader that differs from x in at most a quarter of it."""
        for y in {self.leader_of[t] for t in prefix.tolist() if t in self.leader_of}:
            known = self.leaders.get(y)
            if known is None or 4 * (self.n[x] + self.n[y] - 2 * known[x]) > self.n[x]:
                continue
            mine, theirs = self.tokens(x), self.tokens(y)
            self.mark[mine] = True
            lost = theirs[~self.mark[theirs]]
            self.mark[mine] = False
            self.mark[theirs] = True
            own = mine[~self.mark[mine]]
            self.mark[theirs] = False
            self.derived += 1
            return known + self._count(own) - self._count(lost)
        return None

    def _lead(self, x: int, prefix: np.ndarray) -> np.ndarray:
        overlap = self._count(self.tokens(x))
        if len(self.leaders) >= LEADERS:
            self.leaders.pop(next(iter(self.leaders)))
        self.leaders[x] = overlap
        self.leader_of.update(dict.fromkeys(prefix.tolist(), x))
        self.counted += 1
        return overlap

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """(x, the smaller or earlier sets that it links with) for every set that has some."""
        t = self.percent / 100
        index: dict[int, dict[int, tuple[list, list]]] = defaultdict(dict)  # shingle -> block of positions -> (sizes, sets)
        for x in range(len(self.n)):
            n, skip = int(self.n[x]), self.skip[x]
            prefix = self.tokens(x)[:n - _needed(n, self.percent) + 1 - skip]
            overlap = self._from_leader(x, prefix)
            if overlap is None:
                met: list[int] = []
                for i, token in enumerate(prefix.tolist(), start=skip):
                    # the overlap is at most n - i, which bounds the other's size
                    most = (n - i) * (1 + t) / t - n + 1e-6
                    for block, (sizes, sets) in index[token].items() if token in index else ():
                        least = t * n + (1 + t) * block * POSITIONS - 1e-6
                        if least <= sizes[-1] and most >= sizes[0]:
                            met += sets[bisect_left(sizes, least):bisect_right(sizes, most)]
                if len(met) > MANY:
                    overlap = self._lead(x, prefix)
            if overlap is not None:
                others = np.flatnonzero((100 + self.percent) * overlap[:x] >= self.percent * (n + self.n[:x]))
            elif met:
                others = np.array(sorted(set(met)))
                self.mark[self.tokens(x)] = True
                shared = np.array([np.count_nonzero(self.mark[self.tokens(y)]) for y in others])
                self.mark[self.tokens(x)] = False
                others = others[(100 + self.percent) * shared >= self.percent * (n + self.n[others])]
            else:
                others = np.zeros(0, dtype=np.int64)
            if self.side.any():
                others = others[self.side[others] != self.side[x]]
            if len(others):
                yield x, others
            for i, token in enumerate(prefix.tolist(), start=skip):
                sizes, sets = index[token].setdefault(i // POSITIONS, ([], []))
                sizes.append(n), sets.append(x)


def _join_cell(percent: int):
    names, kinds = ["kind", "u", "v", "docs"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(table: pa.Table) -> pa.Table:
        cell = Cell(table.to_pylist(), percent)
        label = np.arange(len(cell.n))
        docs = np.zeros(len(cell.n), dtype=np.int64)
        out = []
        for x, others in cell.links():
            docs[x] += cell.copies[others].sum()
            docs[others] += cell.copies[x]
            roots, first = np.unique(label[others], return_index=True)
            for r, y in zip(roots, others[first]):  # one link for each component that is not tied yet
                if label[x] != r:
                    out.append((0, int(cell.sid[x]), int(cell.sid[y]), 0))
                    if label[x] == x:
                        label[x] = r
                    else:
                        label[label == r] = label[x]
        out += [(1, int(s), 0, int(d)) for s, d in zip(cell.sid, docs) if d]
        return _table(out, names, kinds)
    return run


# ---- the plan ----------------------------------------------------------------------------------------

def _links(blocks: DataFrame, sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Rows of ``_FOUND``: spanning links between sets (kind 0) and the documents a set links with (kind 1)."""
    total = blocks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("n")).first()["n"]
    shift = max(0, 64 - max(32, total.bit_length() + 6))
    owned = materialize(sets.groupBy("block").agg(F.collect_list("slot").alias("slots")), "jaccard_owned")
    asked = blocks.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(_asks(shift, buckets), _ASK)
    told = asked.groupBy("bucket").applyInArrow(_classes, _TOLD).withColumn("slots", F.lit(None).cast("array<int>"))
    told = told.unionByName(owned.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("classes"), "slots"))
    alive = materialize(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_alive(shift, percent), _ALIVE), "jaccard_alive")
    entries = materialize(alive.mapInArrow(_entries(percent), "token long, sid long, least long"), "jaccard_entries")
    heads = entries.filter("token IS NOT NULL").select("token", "sid")
    lists = heads.groupBy("token").agg(F.min("sid").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = heads.join(lists, "token").filter("sid <> least").select("sid", "least").unionByName(entries.filter("token IS NULL").select("sid", "least"))
    ties = connected_components(pairs.select(F.col("sid").alias("u"), F.col("least").alias("v")).distinct())
    met = alive.join(_cells(alive, ties, percent), "sid").join(sets.select("sid", "copies"), "sid")
    return materialize(met.groupBy("cell").applyInArrow(_join_cell(percent), _FOUND), "jaccard_links")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
               block_size: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links (other documents that it links with)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    name = f"llm_sets_{uuid.uuid4().hex[:12]}"
    (texts.mapInArrow(_make_sets(shingle, block_size), _SETS).write.option("path", scratch_path(spark, "llm_sets"))
     .bucketBy(int(max(tasks(docs), n_bytes // (64 << 20))), "block").saveAsTable(name))
    try:
        blocks = spark.table(name)
        of_doc = blocks.select("block", F.explode(F.arrays_zip("doc_id", "at")).alias("r"), "digests", "sizes")
        rows = materialize(of_doc.select(F.col("r.doc_id").alias("doc_id"), "block", F.col("r.at").alias("slot"),
                                         F.get("digests", F.col("r.at")).alias("digest"), F.coalesce(F.get("sizes", F.col("r.at")), F.lit(0)).cast("long").alias("n_shingles")), "jaccard_rows")
        sets = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("block", "slot")).alias("o"), F.min("doc_id").alias("least"))
        sets = materialize(sets.select("digest", "copies", "least", F.col("o.block").alias("block"), F.col("o.slot").alias("slot"),
                                       (F.shiftleft("o.block", SLOT_BITS) + F.col("o.slot")).alias("sid")), "jaccard_sets")
        found = _links(blocks, sets, percent, int(max(tasks(docs), n_bytes // BUCKET_BYTES)))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    tied = connected_components(found.filter("kind = 0").select("u", "v"))
    linked = found.filter("kind = 1").groupBy(F.col("u").alias("sid")).agg(F.sum("docs").alias("docs"))
    of_set = materialize(sets.join(tied, F.col("sid") == F.col("node"), "left").join(linked, "sid", "left")
                         .select("digest", "copies", "least", F.coalesce("root", "sid").alias("root"), F.coalesce("docs", F.lit(0)).alias("docs")), "jaccard_components")
    least = of_set.groupBy("root").agg(F.min("least").alias("component_id"))
    known = of_set.join(least, "root").select(F.col("digest").alias("_digest"), "component_id", (F.col("copies") - 1 + F.col("docs")).alias("n_links"))
    with_set = rows.filter("digest IS NOT NULL").join(known, F.col("digest") == F.col("_digest"))
    alone = rows.filter("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return with_set.select("doc_id", "n_shingles", "component_id", "n_links").unionByName(alone)


_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * o >= {PERCENT} * (p.n + q.n - o)),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT r.x, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY r.x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM d LEFT JOIN n ON n.rid = d.rid JOIN c ON c.x = d.rid LEFT JOIN k ON k.x = d.rid"""


@register("op13_ngram_join", _SQL)
def op13_ngram_join(spark, sf_dir):
    return ngram_join(documents(spark, sf_dir))
