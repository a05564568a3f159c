"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

``pieces.Lattice`` states encoding as the best path of a lattice.  A text of up to ``CHUNK`` characters is solved
where it is read.  A longer one is cut into chunks at fixed places:

1. each chunk, with the few characters around it that a piece can reach, gives a sparse transfer matrix between
   the states at its left and right boundary (max-plus: scores add along a path, the best path counts);
2. the matrices of ``BLOCK`` neighbouring chunks are multiplied, block by block (the product is associative);
3. per text, the best path through the block matrices fixes the state at each block boundary, then, block by
   block, at each chunk boundary;
4. each chunk is traced back on its own between its two known states, and the ids are put together.

Equal giant texts are encoded once.  A text is one row, so what is put together for it is bounded by the size of a row,
and steps 1, 2 and 4 are tasks of bounded size.  The ids are those of the model's own encoder (tested
against it) for bpe and unigram models with identity normalisation.

Decoding gathers the bytes of the pieces and drops the dummy space.  It gives back the text, but for U+2581 (the
space mark itself), which becomes a space as in any SentencePiece decoder.

Null texts get null ids and decode to null; empty texts get no ids.  Repeated rows get equal results; null ids
of documents are carried along.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .common import documents, materialize, register, tasks, text_key

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 14
BLOCK = 64
#: rows of an Arrow batch that are worked on at once
ROWS = 500

_ENTRY = [("o", "<i4"), ("t", "<i8"), ("eo", "<i4"), ("et", "<i8"), ("s", "<f8")]


def _pack(entries: list[tuple]) -> bytes:
    none = pieces.ALONE
    return np.array([(o, none if t is None else t, eo, none if et is None else et, s) for o, t, eo, et, s in entries], dtype=_ENTRY).tobytes()


def _unpack(data: bytes) -> list[tuple]:
    none = pieces.ALONE
    return [(o, None if t == none else t, eo, None if et == none else et, s) for o, t, eo, et, s in np.frombuffer(data, dtype=_ENTRY).tolist()]


def share(spark, model_path: str):
    """The vocabulary, broadcast (its size is fixed by the model); a task's lattice stays with its worker."""
    return spark.sparkContext.broadcast({"vocabulary": tuple(pieces.load(model_path)), "lattice": None})


def _lattice(shared) -> pieces.Lattice:
    box = shared.value
    if box["lattice"] is None:
        box["lattice"] = pieces.Lattice(pieces.Vocabulary(*box["vocabulary"]))
    return box["lattice"]


def _lists(found: list[bytes | None]) -> pa.Array:
    """int32 lists from packed ids."""
    ends = np.cumsum([0] + [len(f or b"") // 4 for f in found]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(f or b"" for f in found), dtype="<i4"))
    lists = pa.ListArray.from_arrays(pa.array(ends), values)
    missing = np.array([f is None for f in found], dtype=bool)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(missing)) if missing.any() else lists


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _encode_whole(shared, check: bool):
    """(..., text) -> (..., ids) and, with ``check``, the length and CRC of what the ids decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for b in _slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            ids = [None if t is None else lattice.segments(pieces.normalise(t, lattice.v.prefix)) for t in texts]
            cols, names = [*b.columns[:-1], _lists(ids)], [*b.schema.names[:-1], "ids"]
            if check:
                back = _decode_lists(shared, cols[-1])
                cols += [pa.array([None if t is None else len(t) for t in back], pa.int32()),
                         pa.array([None if t is None else zlib.crc32(t.encode()) for t in back], pa.int64())]
                names += ["decoded_chars", "decoded_crc32"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _decode_lists(shared, lists: pa.Array) -> list[str | None]:
    box = shared.value
    if "raw" not in box:
        v = pieces.Vocabulary(*box["vocabulary"])
        lengths = np.array([len(r) for r in v.raw], dtype=np.int64)
        box["raw"] = (np.frombuffer(b"".join(v.raw), dtype=np.uint8), lengths, np.cumsum(lengths) - lengths, v.prefix)
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    n = np.diff(lists.offsets.to_numpy()) * there
    texts = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]), *box["raw"])
    return [t if ok else None for t, ok in zip(texts, there)]


def _cut(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, prefix = _lattice(shared).longest, _lattice(shared).v.prefix
        for b in batches:
            for tid, text in zip(b.column(0), b.column(1)):
                t = pieces.normalise(text.as_py(), prefix)
                for at in range(0, len(t), size * 64):  # a few chunks a batch
                    starts = range(at, min(at + size * 64, len(t)), size)
                    left = [min(a, reach) for a in starts]
                    ends = [min(a + size, len(t)) for a in starts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([tid.as_py()] * len(left)), pa.array([a // size for a in starts], pa.int32()),
                        pa.array([(len(t) - 1) // size] * len(left), pa.int32()), pa.array([e == len(t) for e in ends]), pa.array(left, pa.int32()),
                        pa.array([n + e - a for n, e, a in zip(left, ends, starts)], pa.int32()),
                        pa.array([t[a - n:e + reach] for n, e, a in zip(left, ends, starts)], pa.string())],
                        ["tid", "chunk", "last", "ends", "a", "b", "part"])
    return run


def _transfer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            found = [_pack(lattice.transfer(r["part"], r["a"], r["b"], r["ends"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["tid", "chunk", "last", "matrix"])
    return run


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, block, chunks of the block in order) -> (tid, block, matrix of the block)."""
    for batch in batches:
        out = []
        for parts in batch.column(2).to_pylist():
            m = _unpack(parts[0]["matrix"])
            for p in parts[1:]:
                m = pieces.product(m, _unpack(p["matrix"]))
            out.append(_pack(m))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["tid", "block", "matrix"])


def best_states(matrices: list[list[tuple]], enter: tuple, leave: tuple) -> list[tuple]:
    """The states before, between and after the matrices on the best path from ``enter`` to ``leave``."""
    steps: list[dict] = [{enter: (0.0, None)}]
    for m in matrices:
        to: dict = {}
        for o, t, eo, et, s in m:
            if (o, t) in steps[-1]:
                score = steps[-1][(o, t)][0] + s
                if (eo, et) not in to or score > to[(eo, et)][0]:
                    to[(eo, et)] = (score, (o, t))
        steps.append(to)
    path = [leave]
    for to in reversed(steps[1:]):
        path.append(to[path[-1]][1])
    return path[::-1]


_EDGES = ["enter_o", "enter_t", "leave_o", "leave_t"]


def _states(key: str):
    """(tid, matrices in order with their ``key``, states before and after) -> (tid, key, states before and after it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pieces.ALONE
        state = lambda o, t: (o, None if t == none else t)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                parts = r["parts"]
                path = best_states([_unpack(p["matrix"]) for p in parts], state(r["enter_o"], r["enter_t"]), state(r["leave_o"], r["leave_t"]))
                out += [(r["tid"], p[key], x, none if a is None else a, y, none if b is None else b) for p, (x, a), (y, b) in zip(parts, path, path[1:])]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tid", key, *_EDGES])
    return run


def _trace(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        none = pieces.ALONE
        for batch in batches:
            ids = [lattice.trace(r["part"], r["a"], r["b"], (r["enter_o"], None if r["enter_t"] == none else r["enter_t"]),
                                 (r["leave_o"], None if r["leave_t"] == none else r["leave_t"]), r["ends"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ids)], ["tid", "chunk", "ids"])
    return run


def encode_giants(texts: DataFrame, shared, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(tid, text), distinct and not null -> (tid, ids) by the parallel scan."""
    if chunk < 2 * max(len(p) for p in shared.value["vocabulary"][1]):
        raise ValueError("chunks must be longer than two pieces")
    chunks = materialize(texts.select("tid", "text").mapInArrow(_cut(shared, chunk), "tid string, chunk int, last int, ends boolean, a int, b int, part string")
                         .repartition(tasks(texts), "tid", "chunk"), "giant_chunks")
    matrices = materialize(chunks.mapInArrow(_transfer(shared), "tid string, chunk int, last int, matrix binary")
                           .select("tid", "chunk", F.floor(F.col("chunk") / block).cast("int").alias("block"),
                                   (F.floor(F.col("last") / block) + 1).cast("int").alias("blocks"), "matrix"), "giant_matrices")
    edges = "enter_o int, enter_t long, leave_o int, leave_t long"
    outer = [F.lit(v).cast(k).alias(c) for c, v, k in zip(_EDGES, (0, pieces.ALONE) * 2, ("int", "long") * 2)]  # start and end of a text
    rows = matrices.groupBy("tid", "block").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("parts"),
                                                F.max("blocks").alias("blocks"))  # at most ``block`` chunks
    products = rows.filter("blocks > 1").select("tid", "block", "parts").mapInArrow(_multiply, "tid string, block int, matrix binary")
    of_blocks = (products.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("parts")).select("tid", "parts", *outer)
                 .mapInArrow(_states("block"), f"tid string, block int, {edges}"))
    known = rows.join(of_blocks, ["tid", "block"]).select("tid", "parts", *_EDGES).unionByName(rows.filter("blocks = 1").select("tid", "parts", *outer))
    of_chunks = known.mapInArrow(_states("chunk"), f"tid string, chunk int, {edges}")
    traced = chunks.join(of_chunks, ["tid", "chunk"]).mapInArrow(_trace(shared), "tid string, chunk int, ids array<int>")
    return (traced.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
            .select("tid", F.flatten(F.col("parts.ids")).alias("ids")))


def _parts(docs: DataFrame, shared, id_col: str, text_col: str, chunk: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Usual rows (doc_id, key_of_text, text), and giant ones with their ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key_of_text"), F.col(text_col).alias("text"))
    long = F.coalesce(F.char_length("text") >= chunk, F.lit(False))
    giants = rows.filter(long).withColumn("tid", F.sha2("text", 256))
    ids = encode_giants(giants.groupBy("tid").agg(F.first("text").alias("text")), shared, chunk, block)
    return rows.filter(~long), giants.drop("text").join(ids, "tid").select("doc_id", "key_of_text", "ids")


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
           block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, key_of_text, ids (array of int)."""
    shared = share(docs.sparkSession, model_path)
    usual, giants = _parts(docs, shared, id_col, text_col, chunk, block)
    return usual.mapInArrow(_encode_whole(shared, False), "doc_id long, key_of_text long, ids array<int>").unionByName(giants)


def decode(encoded: DataFrame, model_path: str = MODEL, ids_col: str = "ids", shared=None) -> DataFrame:
    """The rows of ``encoded`` with the column ``decoded`` instead of the ids."""
    shared = shared or share(encoded.sparkSession, model_path)
    others = [c for c in encoded.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = _decode_lists(shared, b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "decoded"])

    schema = T.StructType([*[encoded.schema[c] for c in others], T.StructField("decoded", T.StringType())])
    return encoded.select(*others, ids_col).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
                      block: int = BLOCK) -> DataFrame:
    """doc_id, token_ids, n_tokens, and decoded_chars and decoded_crc32 (unsigned, UTF-8) of what the ids decode to.

    Usual texts are encoded and decoded in one pass, giant ones after their ids have been put together.
    """
    shared = share(docs.sparkSession, model_path)
    usual, giants = _parts(docs, shared, id_col, text_col, chunk, block)
    done = usual.mapInArrow(_encode_whole(shared, True), "doc_id long, key_of_text long, ids array<int>, decoded_chars int, decoded_crc32 long")
    back = decode(giants.withColumn("token_ids", F.col("ids")), shared=shared)
    late = back.select("doc_id", "key_of_text", F.col("token_ids").alias("ids"), F.char_length("decoded").alias("decoded_chars"),
                       F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))
    return done.unionByName(late).select("doc_id", F.col("ids").alias("token_ids"), F.size("ids").alias("n_tokens"), "decoded_chars", "decoded_crc32")


@register("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    return encode_and_decode(documents(spark, sf_dir))
