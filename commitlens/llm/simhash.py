"""SimHash near-duplicates by the generalised pigeonhole principle.

* **Fingerprint** (64 bits): A-Z lower-cased, words are runs of non-white-space, shingles are
  ``shingle`` words joined by a space, repeats included (fewer words: the whole sequence; none or a
  null text: fingerprint zero).  A bit is one if it is set in more than half of the shingles' XXH64.
* **Partitions**: bits that go together over all distinct fingerprints are put into one partition,
  which leaves the other partitions selective.
* **Thresholds**: with m partitions and a distance of at most r, any integers T_1..T_m >= -1 that sum
  to r - m + 1 are enough: some partition differs in at most T_i bits (-1: not probed).  Dynamic
  programming takes the ones with the least estimated cost, from the number of candidates each
  partition gives over all fingerprints and the number of signatures probed; the same estimate
  chooses m.
* **Probe and verify**: fingerprints are dealt by (partition, value), with all values within T_i bits;
  those that meet are compared on all 64 bits.  A task sends back a spanning forest of the verified
  links, never the pairs.  A bucket of more than ``BUCKET`` fingerprints is not compared pair by pair:
  its members are dealt anew by every value within r/2 bits of them, and those that share one are
  linked.  Two values at distance r or less share one, and those that share one are at most r apart
  (r even), so this is exact and linear.
* **Components**: stars over the links; a component's id is its smallest doc_id.

Links hold between distinct fingerprints, so copies cost one row a task.  Null ids come last among the
members of a component.  Repeated rows get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keep_rows, materialize, register, same, tasks, text_key
from .components import connected_components

BITS = 64
SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
#: numbers of partitions that are weighed against each other
PARTITIONS = (2, 3)
#: a probed signature is shuffled and sorted; a candidate is one comparison
PROBE_COST = 20.0
#: members of a bucket that are compared pair by pair in one task
BUCKET = 4096
#: bytes of a text that are split into words at once
PIECE = 1 << 20


# ---- fingerprints ----------------------------------------------------------------------------

def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end where a word ends."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    words: list[bytes] = []
    ones, total = np.zeros(BITS, dtype=np.int64), 0

    def add(shingles: list[bytes]) -> None:
        nonlocal ones, total
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(shingles)

    for piece in _pieces(data or b""):
        words += piece.lower().split()
        if len(words) >= shingle:
            add([b" ".join(s) for s in zip(*(itertools.islice(words, i, None) for i in range(shingle)))])
            words = words[len(words) - shingle + 1:]
    if total == 0 and words:
        add([b" ".join(words)])
    return sum(1 << int(b) for b in np.flatnonzero(ones * 2 > total))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key_of_text, fp (the fingerprint's 64 bits as a long) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2).cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "key_of_text", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key_of_text"),
                        F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, key_of_text long, fp long"))


# ---- partitions and thresholds ---------------------------------------------------------------

def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all fingerprints: 64 x 64 sums."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), dtype=np.int64)
        for b in batches:
            bits = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel())], ["i", "j", "n"])

    sums = fps.select("fp").mapInArrow(partial, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((BITS, BITS), dtype=np.int64)
    for r in sums.collect():  # at most 4,096 rows
        out[r["i"], r["j"]] = r["n"]
    return out


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_partitions(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m lists of bits of about equal length; each is filled with the bits most correlated to those in it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.maximum(np.outer(spread, spread), 1e-12)
    np.fill_diagonal(corr, 0)
    left, out = list(range(len(p))), []
    for i in range(m):
        room = math.ceil(len(left) / (m - i))
        first = max(left, key=lambda b: (corr[b, left].max(), -b))
        part = [first]
        while len(part) < room:
            part.append(max((b for b in left if b not in part), key=lambda b: (corr[b, part].mean(), -b)))
        left = [b for b in left if b not in part]
        out.append(sorted(part))
    return out


def _within(differ: np.ndarray, radius: int) -> np.ndarray:
    """P(at most r of the bits differ) for r = 0..radius, bits taken as independent."""
    dist = np.zeros(len(differ) + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)[: radius + 1]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least sum of costs[i][T_i + 1] with T_i >= -1 and sum of T_i = total: (cost, thresholds)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                to = (cost + c, [*chosen, t])
                if used + t not in step or to < step[used + t]:
                    step[used + t] = to
        best = step
    return best[total]


def plan(fps: DataFrame, distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, from statistics over all distinct fingerprints."""
    both, n = bit_counts(fps), fps.count()
    if n == 0:
        return []
    options = {m: correlated_partitions(both, n, m) for m in PARTITIONS}
    parts = [part for ps in options.values() for part in ps]
    same_value = _pairs_that_agree(fps, parts)
    p = both.diagonal() / n
    best = None
    at = 0
    for m, ps in options.items():
        costs = []
        for part in ps:
            within = _within(2 * p[part] * (1 - p[part]), distance)
            pairs = same_value[at] * within / max(within[0], 1e-300)
            ball = np.cumsum([math.comb(len(part), k) for k in range(distance + 1)])
            costs.append([0.0] + [float(min(c, n * n)) + PROBE_COST * n * float(b) for c, b in zip(pairs, ball)])
            at += 1
        found = allocate(costs, distance - m + 1)
        if best is None or found[0] < best[0]:
            best = (*found, ps)
    return [(part, t) for part, t in zip(best[2], best[1]) if t >= 0]


def _value(part: list[int]):
    """The bits of a partition: the fingerprint with all other bits cleared."""
    return F.col("fp").bitwiseAND(F.lit(_mask(part)))


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _pairs_that_agree(fps: DataFrame, parts: list[list[int]]) -> list[float]:
    """For each partition, the sum of squares of how often its values occur."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _value(p).alias("value")) for i, p in enumerate(parts)]))
    counts = fps.select(keys.alias("k")).groupBy("k.part", "k.value").agg(F.count(F.lit(1)).alias("n"))
    sums = {r["part"]: r["s"] for r in counts.groupBy("part").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("s")).collect()}
    return [sums.get(i, 0.0) for i in range(len(parts))]


# ---- probe and verify ------------------------------------------------------------------------

def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low, new = np.minimum(a, b), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def _forest(run: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of each run (rows of a run stand together)."""
    n = len(run)
    u = v = np.zeros(0, dtype=np.int64)
    at, step = np.arange(n), 0
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[run[at] == run[at + step]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        u, v = np.concatenate([u, near]), np.concatenate([v, near + step])
        if len(u) > max(4 * n, 1 << 16):
            root = _roots(n, u, v)
            u, v = np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)]
    root = _roots(n, u, v)
    tied = np.flatnonzero(root != np.arange(n))
    return fps[tied], fps[root[tied]]


def _nearby(radius: int) -> np.ndarray:
    """All masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in itertools.combinations(range(BITS), k)], dtype=np.uint64)


def links(fps: DataFrame, parts: list[tuple[list[int], int]], distance: int = MAX_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all within ``distance`` bits; a spanning set, not all pairs."""
    if distance % 2:
        raise ValueError("distance must be even")
    masks = [[_mask(c) for k in range(t + 1) for c in itertools.combinations(bits, k)] for bits, t in parts]
    probes = None
    for i, (bits, _) in enumerate(parts):
        value = F.explode(F.array(*[F.lit(m) for m in masks[i]])).alias("flip")
        some = fps.select("fp", value).select(F.lit(i).alias("part"), _value(bits).bitwiseXOR(F.col("flip")).alias("value"), "fp")
        probes = some if probes is None else probes.unionByName(some)
    balls = _nearby(distance // 2)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 3), dtype=np.int64)  # part, value, fp of the run that may go on
        hot = None  # (part, value) of a run too long to compare pair by pair

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                              ["kind", "u", "v"])

        def spread(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 4096):
                f = np.ascontiguousarray(rows[at:at + 4096, 2]).view(np.uint64)
                yield out(1, (f[:, None] ^ balls[None, :]).ravel(), np.repeat(f, len(balls)))

        def runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            return np.flatnonzero(new), np.cumsum(new)

        def finish(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            starts, run = runs(rows)
            length = np.diff(np.append(starts, len(rows)))
            long = (length > bucket)[run - 1]
            if long.any():
                yield from spread(rows[long])
            short = rows[~long]
            a, b = _forest(run[~long], np.ascontiguousarray(short[:, 2]).view(np.uint64), distance)
            if len(a):
                yield out(0, a, b)

        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            if hot is not None:
                ours = (rows[:, 0] == hot[0]) & (rows[:, 1] == hot[1])
                yield from spread(rows[ours])
                rows = rows[~ours]
                if not len(rows):
                    continue
                hot = None
            rows = np.concatenate([kept, rows])
            if not len(rows):
                continue
            starts, _ = runs(rows)
            yield from finish(rows[: starts[-1]])
            kept = rows[starts[-1]:]
            if len(kept) > bucket:
                hot = tuple(kept[0, :2])
                yield from spread(kept)
                kept = kept[:0]
        yield from finish(kept)

    if probes is None:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).filter("false")
    met = (probes.repartition(tasks(fps), "part", "value").sortWithinPartitions("part", "value")
           .mapInArrow(compare, "kind int, u long, v long"))
    met = materialize(met, "simhash_links")
    shared = met.filter("kind = 1").select("u", "v")
    least = shared.groupBy("u").agg(F.min("v").alias("m"))
    return (met.filter("kind = 0").select("u", "v")
            .unionByName(shared.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       distance: int = MAX_DISTANCE) -> DataFrame:
    """Every row's doc_id, key_of_text, fp and component_id; and ``stays`` for one row key of each component."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_of_text"))
    fps = materialize(rows.groupBy("fp").agg(first.alias("first")), "simhash_distinct")
    linked = connected_components(links(fps, plan(fps, distance), distance))
    roots = materialize(fps.join(linked, F.col("fp") == F.col("node"), "left")
                        .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash_roots")
    least = roots.groupBy("root").agg(F.min("first").alias("least"))
    of_fp = roots.join(least, "root").select("fp", "least")
    stays = same(F.col("doc_id"), F.col("least.doc_id")) & (F.col("key_of_text") == F.col("least.key_of_text"))
    return rows.join(of_fp, "fp").select("doc_id", "key_of_text", "fp", F.col("least.doc_id").alias("component_id"), stays.alias("stays"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` (all its columns) for each component: the one with the smallest doc_id."""
    kept = simhash_components(docs, id_col, text_col).filter("stays")
    return keep_rows(docs, kept.select(F.col("doc_id").alias("_id"), F.col("key_of_text").alias("_key")).distinct(), id_col, text_col)


@register("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark, sf_dir):
    out = simhash_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
