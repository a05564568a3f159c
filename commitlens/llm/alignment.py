"""Alignment of two tokenizers by shared cuts, and how often their ids meet.

Each text is encoded by A (a byte-level BPE file of the ``tokenizers`` library, the text after one blank) and by B (a
``sentencepiece`` model, which adds that blank itself), without special tokens; their strings in a text are plain text.  Tokens
stand for bytes.  Byte offsets where a token of A and one of B both end cut the text into groups; a link is a pair of tokens, one
of each, whose byte ranges overlap; an id pair's count is the number of links that hold it, over all texts.

* **Encoding**: a blank between two characters that are no white space starts a token in both, so texts are split there, the
  distinct words of a task are encoded once, and a text's tokens are gathered from them.  A file of A whose merges come in the order
  of its ids is applied as a rank table, which gives the same ids; any other goes through the library.
* **Cuts, divide and conquer**: in an interval of A's ends, the end nearest to the middle that B has too (found by bisecting
  B's ends) cuts it in two, and both halves go on; an interval without one is a leaf group.  All open intervals of a
  block of texts take a step together.
* **Counts**: a block sends each of its distinct id pairs once, with its count, to the bucket of the B id.  A bucket is
  added up in a tree of bounded steps, so that no task holds more than some blocks' pairs; it knows the highest count of each of
  its B ids.  Totals go back to the blocks, which sum them by text.

The number of buckets is fixed, since there are only so many id pairs; rows grow with the blocks alone.  Texts that are null or
empty, or whose tokens of A or B do not spell the blank and the text, have no tokens: zeros and an empty string.  Long texts
are taken in segments of whole words and may span blocks.  Repeated rows count and have their own results.  An empty table gives
an empty result.  Only ids and texts are read.  A word without blanks is encoded as a whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import documents, materialize, register, tasks
from .lm_score import _deltas, _planes, _table, _undeltas, _unplanes

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: tokens (of A and B) in a block; words of a long text that are aligned at once
BLOCK, SEGMENT = 1 << 20, 1 << 16
#: words whose tokens a task keeps, and their characters
WORDS, WORD_CHARS = 1 << 18, 1 << 23
#: buckets of B ids; blocks whose pairs are added up at once
BUCKETS, FAN_IN = 32, 64

#: characters beside which a blank is not taken as a boundary of words
_ODD = r"\s\x00-\x20\x7f-\xa0" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)))
_SPLIT = re.compile(f"(?<=[^{_ODD}]) (?=[^{_ODD}])")
_PLAIN = re.compile(f"[^{_ODD}]+(?: [^{_ODD}]+)*")

_BLOCKS = ("block long, rid array<long>, doc_id array<long>, last array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
           "sha array<string>, pairs binary, counts binary, entries binary, times binary")
_ASK, _ASK_NAMES, _ASK_KINDS = "bucket int, block long, pairs binary, counts binary", ["bucket", "block", "pairs", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_SUM, _SUM_NAMES, _SUM_KINDS = "bucket int, part int, pairs binary, counts binary", ["bucket", "part", "pairs", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_TOLD, _TOLD_NAMES, _TOLD_KINDS = "block long, bucket int, totals binary, best binary", ["block", "bucket", "totals", "best"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]


# ---- tokens ------------------------------------------------------------------------------------------

def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: fixed value: the public pattern by which a byte-level file without one of its own splits text
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizers:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, json_a: bytes, model_b: bytes):
        import sentencepiece
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        letters = _byte_alphabet()
        file = json.loads(json_a)
        vocab = file["model"]["vocab"] | {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_b = {i: self._piece(i) for i in range(self.b.get_piece_size())}
        self.length = [np.array([len(t.get(i, b"")) for i in range(max(t) + 1)], dtype=np.int64) for t in (self.bytes_a, self.bytes_b)]
        self.encode_a = self._by_ranks(file) or self._by_library(json_a)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def _by_ranks(self, file: dict):
        """The same merges as ranks, where a file's merges come in the order of its ids: several times as fast."""
        import tiktoken
        model, split = file["model"], file.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
        joined = [model["vocab"].get(m.replace(" ", "", 1), -1) for m in merges]
        plain = (model.get("type") in (None, "BPE") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                 and not file.get("normalizer") and not file.get("post_processor") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix") and not model.get("dropout") and joined == sorted(joined) and joined[:1] != [-1])
        if not plain:
            return None
        added = {t["id"] for t in file.get("added_tokens", ())}
        ranks = {self.bytes_a[i]: i for i in model["vocab"].values() if i not in added}
        encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda words: [encoder.encode_ordinary(" " + w) for w in words]

    @staticmethod
    def _by_library(json_a: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        encoder = Tokenizer.from_str(json_a.decode())
        encoder.encode_special_tokens = True
        return lambda words: [e.ids for e in encoder.encode_batch([" " + w for w in words], add_special_tokens=False)]

    def encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids, number of ids of each word) of A and of B, and whether both spell the blank and the word."""
        data = [b" " + w.encode() for w in words]
        whole, size = b"".join(data), np.fromiter(map(len, data), np.int64, len(data))
        flat, counts, fine = [], [], np.ones(len(words), dtype=bool)
        for found, spelt, length in ((self.encode_a(words), self.bytes_a, self.length[0]), (self.b.encode(words, num_threads=1), self.bytes_b, self.length[1])):
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(itertools.chain.from_iterable(found), np.int64, counts[-1].sum()))
            ends = np.concatenate([[0], np.cumsum(length[flat[-1]])])
            at = np.cumsum(counts[-1])
            if not (np.array_equal(ends[at] - ends[at - counts[-1]], size) and b"".join(map(spelt.__getitem__, flat[-1].tolist())) == whole):
                fine &= np.array([b"".join(map(spelt.__getitem__, f)) == d for f, d in zip(found, data)], dtype=bool)
        return flat, counts, fine


def words_of(text: str) -> list[str]:
    """The text without the blanks at which it is split."""
    return text.split(" ") if _PLAIN.fullmatch(text) else _SPLIT.split(text)


class _Words:
    """The tokens of the words a task has met, one word after the other."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars, self.fine = 0, np.zeros(0, dtype=bool)
        self.ids = [np.zeros(0, dtype=np.int64)] * 2
        self.ends = [np.zeros(1, dtype=np.int64)] * 2

    def numbers(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.place))
        if new:
            flat, counts, fine = self.tokenizers.encode(new)
            for side in (0, 1):
                self.ids[side] = np.concatenate([self.ids[side], flat[side]])
                self.ends[side] = np.concatenate([self.ends[side], self.ends[side][-1] + np.cumsum(counts[side])])
            self.fine = np.concatenate([self.fine, fine])
            self.chars += sum(map(len, new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def tokens(self, side: int, words: np.ndarray) -> np.ndarray:
        first, size = self.ends[side][words], self.ends[side][words + 1] - self.ends[side][words]
        return self.ids[side][np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]


# ---- cuts --------------------------------------------------------------------------------------------

def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of A's ends are ends of B too.  ``last`` are places in ``ends_a`` known to be: the ends of the intervals to begin with."""
    cut = np.zeros(len(ends_a), dtype=bool)
    cut[last] = True
    lo, hi = np.concatenate([[0], last[:-1] + 1]), last  # ends inside an interval: lo to hi - 1
    while len(lo := lo[inside := hi > lo]):
        hi = hi[inside]
        middle, found = (lo + hi) // 2, np.full(len(lo), -1)
        open_, step = np.arange(len(lo)), 0
        while len(open_):  # the middle, then one to its right, one to its left, two to its right, ...
            at = middle[open_] + (step + 1) // 2 * (1 if step % 2 else -1)
            there = (at >= lo[open_]) & (at < hi[open_])
            which, at = open_[there], at[there]
            hit = ends_b[np.searchsorted(ends_b, ends_a[at])] == ends_a[at]
            found[which[hit]] = at[hit]
            step += 1
            open_ = open_[(found[open_] < 0) & ((step + 1) // 2 <= np.maximum(hi[open_] - middle[open_], middle[open_] - lo[open_]))]
        ok = found >= 0
        cut[found[ok]] = True
        lo, hi = np.concatenate([lo[ok], found[ok] + 1]), np.concatenate([found[ok], hi[ok]])
    return cut


class _Texts:
    """``1,2|`` and so on: the decimal ids with what comes behind them."""

    def __init__(self, size: int):
        numbers = [str(i).encode() for i in range(size)]
        self.comma, self.bar, self.semicolon = (np.array([n + c for n in numbers], dtype=object) for c in (b",", b"|", b";"))


def align(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, texts: _Texts):
    """Segments one after the other: groups and links of each, the id pair (B, A) of each link, and the groups written out."""
    cut_a = shared_cuts(ends_a, ends_b, last_a)
    at_b = np.searchsorted(ends_b, ends_a[cut_a])
    cut_b = np.zeros(len(ends_b), dtype=bool)
    cut_b[at_b] = True
    # a link for every end: of A's with the token of B that reaches it, of B's own with the token of A that does
    rest = np.flatnonzero(~cut_b)
    pairs = np.concatenate([ids_b[np.searchsorted(ends_b, ends_a)] << 32 | ids_a, ids_b[rest] << 32 | ids_a[np.searchsorted(ends_a, ends_b[rest])]])
    segment = np.concatenate([np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1)), np.searchsorted(last_b, rest)])
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    ends_of_a, ends_of_b = np.flatnonzero(cut_a) + 1, at_b + 1
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], ends_of_b])[group_a]
    place_b = np.arange(len(ids_b)) + ends_of_a[group_b]
    items = np.empty(len(ids_a) + len(ids_b), dtype=object)
    items[place_a] = np.where(cut_a, texts.bar[ids_a], texts.comma[ids_a])
    items[place_b] = np.where(cut_b, texts.semicolon[ids_b], texts.comma[ids_b])
    stops = last_a + last_b + 2
    written = [b"".join(items[a:b].tolist()) for a, b in zip(np.concatenate([[0], stops[:-1]]), stops)]
    groups = np.diff(group_a[last_a] + 1, prepend=0)
    return groups, pairs, segment, written


# ---- blocks ------------------------------------------------------------------------------------------

def _make_blocks(shared, block_size: int, segment_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Tokenizers(*shared.value)
        words, texts = _Words(shape), _Texts(max(map(len, shape.length)))
        task, number = TaskContext.get().partitionId(), 0
        parts, held = [], 0  # (row, doc_id, last segment of the row, tokens of A, tokens of B)
        sha = hashlib.sha256()

        def block() -> pa.RecordBatch:
            nonlocal sha
            some = [p for p in parts if len(p[3])]
            groups = links = np.zeros(0, dtype=np.int64)
            pairs, entries, counts, times, written = [np.zeros(0, dtype="<u8")] * 4 + [[]]
            if some:
                a, b = np.concatenate([p[3] for p in some]), np.concatenate([p[4] for p in some])
                last_a, last_b = (np.cumsum([len(p[side]) for p in some]) - 1 for side in (3, 4))
                groups, keys, segment, written = align(a, b, np.cumsum(shape.length[0][a]), np.cumsum(shape.length[1][b]), last_a, last_b, texts)
                links = np.bincount(segment, minlength=len(some))
                pairs, rank, counts = np.unique(keys.astype("<u8"), return_inverse=True, return_counts=True)
                entries, times = np.unique(segment.astype("<u8") << np.uint64(32) | rank.astype("<u8"), return_counts=True)
            out, at = [], 0
            for rid, doc_id, is_last, own_a, own_b in parts:
                digest = ""
                if len(own_a):
                    sha.update(written[at][:-1] if is_last else written[at])
                    digest = sha.hexdigest() if is_last else ""
                out.append((rid, doc_id, is_last, len(own_a), len(own_b), int(groups[at]) if len(own_a) else 0, int(links[at]) if len(own_a) else 0, digest))
                at += bool(len(own_a))
                if is_last:
                    sha = hashlib.sha256()
            names = ["rid", "doc_id", "last", "n_a", "n_b", "n_groups", "n_links", "sha"]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.string()]
            cols = [pa.array([list(c)], pa.list_(k)) for c, k in zip(zip(*out), kinds)]
            data = [_deltas(pairs), _planes(counts.astype("<u4")), _deltas(entries), _planes(times.astype("<u4"))]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), *cols, *[pa.array([d], pa.binary()) for d in data]],
                                              ["block", *names, "pairs", "counts", "entries", "times"])

        def tokens(pending: list[tuple]) -> Iterator[tuple]:
            """(row, doc_id, last, tokens of A, tokens of B) of the segments of some texts."""
            numbers = words.numbers([w for *_, split in pending for w in split])
            nothing, at = np.zeros(0, dtype=np.int64), 0
            for rid, doc_id, split in pending:
                own = numbers[at:at + len(split)]
                at += len(split)
                if not len(own) or not words.fine[own].all():
                    yield rid, doc_id, True, nothing, nothing
                    continue
                for i in range(0, len(own), segment_words):
                    some = own[i:i + segment_words]
                    yield rid, doc_id, i + segment_words >= len(own), words.tokens(0, some), words.tokens(1, some)
            if words.chars > WORD_CHARS or len(words.place) > WORDS:
                words.clear()

        def pending() -> Iterator[list[tuple]]:
            some, n, row = [], 0, task << 36
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    split = words_of(text.as_py()) if text.as_py() else []
                    some.append((row, doc_id, split))
                    n, row = n + len(split) + 1, row + 1
                    if n >= segment_words:
                        yield some
                        some, n = [], 0
            yield some

        for part in (t for some in pending() for t in tokens(some)):
            parts.append(part)
            held += len(part[3]) + len(part[4]) + 1
            if held >= block_size:
                yield block()
                parts, held, number = [], 0, number + 1
        if parts:
            yield block()
    return run


# ---- counts ------------------------------------------------------------------------------------------

def _bucket(pairs: np.ndarray) -> np.ndarray:
    """The bucket of a pair, by its B id alone."""
    with np.errstate(over="ignore"):
        return ((pairs >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BUCKETS)


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            pairs, counts = _undeltas(r["pairs"]), _unplanes(r["counts"], "<u4")
            bucket = _bucket(pairs)
            rows = [(k, r["block"], _deltas(pairs[at]), _planes(counts[at])) for k in range(BUCKETS) if len(at := np.flatnonzero(bucket == k))]
            yield from _table(rows, _ASK_NAMES, _ASK_KINDS).to_batches()


def _add_up(table: pa.Table) -> pa.Table:
    """The pairs of some blocks, or of some sums, in one bucket."""
    rows = table.to_pylist()
    pairs, which = np.unique(np.concatenate([_undeltas(r["pairs"]) for r in rows]), return_inverse=True)
    counts = np.concatenate([_unplanes(r["counts"], "<u8") if r["wide"] else _unplanes(r["counts"], "<u4").astype("<u8") for r in rows])
    total = np.zeros(len(pairs), dtype="<u8")
    np.add.at(total, which, counts)
    return _table([(rows[0]["bucket"], rows[0]["part"], _deltas(pairs), _planes(total))], _SUM_NAMES, _SUM_KINDS)


def _tell(asked: pa.Table, sums: pa.Table) -> pa.Table:
    """For some blocks, the totals of their pairs in a bucket, and whether they are the highest of their B id."""
    if not len(asked):
        return _table([], _TOLD_NAMES, _TOLD_KINDS)
    row = sums.to_pylist()[0]
    pairs, total = _undeltas(row["pairs"]), _unplanes(row["counts"], "<u8")
    start = np.flatnonzero(np.diff(pairs >> np.uint64(32), prepend=np.uint64(1 << 63)))  # pairs are in order of B's id
    best = total == np.repeat(np.maximum.reduceat(total, start), np.diff(np.append(start, len(pairs))))
    out = []
    for r in asked.to_pylist():
        at = np.searchsorted(pairs, _undeltas(r["pairs"]))
        out.append((r["block"], r["bucket"], _planes(total[at]), np.packbits(best[at]).tobytes()))
    return _table(out, _TOLD_NAMES, _TOLD_KINDS)


_RESULT = "rid long, doc_id long, last boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, sha string"
_RESULT_NAMES = ["rid", "doc_id", "last", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha"]
_RESULT_KINDS = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string()]


def _sum_up(block: pa.Table, told: pa.Table) -> pa.Table:
    if not len(block):
        return _table([], _RESULT_NAMES, _RESULT_KINDS)
    r = block.to_pylist()[0]
    pairs, entries, times = _undeltas(r["pairs"]), _undeltas(r["entries"]), _unplanes(r["times"], "<u4").astype(np.int64)
    total, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
    bucket = _bucket(pairs)
    for t in told.to_pylist():
        at = np.flatnonzero(bucket == t["bucket"])
        total[at], best[at] = _unplanes(t["totals"], "<u8").astype(np.int64), np.unpackbits(np.frombuffer(t["best"], np.uint8), count=len(at)).astype(bool)
    some = [i for i, n in enumerate(r["n_a"]) if n]
    n_best, count_sum = np.zeros(len(r["rid"]), dtype=np.int64), np.zeros(len(r["rid"]), dtype=np.int64)
    if some:
        rank = (entries & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.searchsorted(entries >> np.uint64(32), np.arange(len(some)).astype("<u8"))
        count_sum[some] = np.add.reduceat(times * total[rank], start)
        n_best[some] = np.add.reduceat(times * best[rank], start)
    rows = list(zip(r["rid"], r["doc_id"], r["last"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], n_best.tolist(), count_sum.tolist(), r["sha"]))
    return _table(rows, _RESULT_NAMES, _RESULT_KINDS)


# ---- the plan ----------------------------------------------------------------------------------------

def _count(blocks: DataFrame) -> DataFrame:
    """Totals of the pairs of every block (``_TOLD``)."""
    asked = materialize(blocks.select("block", "pairs", "counts").mapInArrow(_asks, _ASK), "pairs_asked")
    parts = max(1, math.ceil(blocks.count() / FAN_IN))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    sums, n, wide = asked.drop("block"), parts, False
    while True:
        sums = sums.withColumn("wide", F.lit(wide)).groupBy("bucket", "part").applyInArrow(_add_up, _SUM)
        if n == 1:
            break
        n, wide = math.ceil(n / FAN_IN), True
        sums = sums.withColumn("part", F.pmod("part", F.lit(n)))
    everywhere = materialize(sums, "pairs_sums").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asked.groupBy("bucket", "part").cogroup(everywhere.groupBy("bucket", "part")).applyInArrow(_tell, _TOLD)


def align_tokenizers(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, id_col: str = "doc_id", text_col: str = "text", block_size: int = BLOCK,
                     segment_words: int = SEGMENT) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    files = []
    for path in (model_a, model_b):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = spark.sparkContext.broadcast(tuple(files))  # two vocabulary files
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    name = f"llm_aligned_{uuid.uuid4().hex[:12]}"
    (texts.mapInArrow(_make_blocks(shared, block_size, segment_words), _BLOCKS).write.option("compression", "zstd").option("path", scratch_path(spark, "llm_aligned"))
     .bucketBy(int(max(tasks(docs), n_bytes // (64 << 20))), "block").saveAsTable(name))
    try:
        blocks = spark.table(name)
        found = materialize(blocks.groupBy("block").cogroup(_count(blocks).groupBy("block")).applyInArrow(_sum_up, _RESULT), "aligned")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                                    F.max("sha").alias("groups_sha256")).drop("rid")


@register("op12_align_tokenizers")
def op12_align_tokenizers(spark, sf_dir):
    return align_tokenizers(documents(spark, sf_dir))
