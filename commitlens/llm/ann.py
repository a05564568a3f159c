"""Approximate nearest neighbours by cosine: stable projections, a kd-tree, and a chi-square stopping test.

Vectors are scaled to length one, where the squared distance is 2 - 2 cosine, and projected on ``DIMS`` directions of
independent normal (2-stable) entries.  For two vectors at distance d the squared projected distance is d^2 times a
chi-square variable of DIMS degrees of freedom.  So projected neighbours are visited in order of their
projected distance r and verified on the original vectors, until

    P(chi2 <= r^2 / d_k^2) >= CONFIDENCE

with d_k the k-th best distance verified so far: a better vector would have shown up by then with that probability.

The index is one kd-tree.  Its top is split at medians of a bounded sample of ``SAMPLE`` projected rows into cells of about
``CELL_ROWS`` rows; every row is indexed in its cell.  A cell that holds more rows (copies of one vector cannot be split) is dealt
over several blocks by a hash of the id.  The rest of the tree is built where a block is searched.

A search has two rounds, both by joining queries and blocks on the cell: every query first searches its own cell, which
bounds d_k; then the other cells whose box is near enough to matter under the stopping test.  The queries of a cell are counted
before each round and dealt over parts of about ``QUERY_ROWS`` by a hash of the query's id; a block is repeated once a part, so
both sides of a join group are bounded.  Equal query vectors of a group are searched once.  No block is broadcast and
nothing but the cell boxes and counts (bounded by the number of cells) reaches the driver.

Vectors are first scaled by a power of two that brings their largest component under 1, which leaves their cosines as they are: very
large and very small ones neither overflow nor vanish.

Rows whose vector is null, zero, of another length than the commonest one (the smaller, if equally common), or holds null or non-finite components
take no part.  Ties go to the smaller id.  A null id takes no part.  Rows that repeat an id and vector are found as often as they occur, except for
the query's own id; a query id that repeats asks with the smallest of its scaled vectors.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import load_table
from .common import materialize, register

DIMS = 32
CONFIDENCE = 0.98
K = 5
SEED = 11
#: rows the top of the tree is fitted on
SAMPLE = 1 << 14
CELL_ROWS = 1 << 13
LEAF_ROWS = 64
#: queries that meet a block in one group
QUERY_ROWS = 1 << 12
#: candidates that are verified between two stopping tests
STEP = 512
#: squared projected distances up to this are those of copies (rounding)
TINY = 1e-9


# ---- the stopping test ------------------------------------------------------------------------

def chi2_cdf(x: float, dims: int = 8) -> float:
    """P(chi-square <= x) for an even number of degrees of freedom (a finite sum)."""
    if x <= 0:
        return 0.0
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi2_bound(p: float, dims: int = 8) -> float:
    """The x with chi2_cdf(x) = p."""
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, dims) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dims) < p else (lo, mid)
    return hi


def directions(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


# ---- the tree ---------------------------------------------------------------------------------

def split(points: np.ndarray, rows: int) -> list[tuple[np.ndarray, tuple]]:
    """kd-tree leaves of at most ``rows`` points: (indices, path of (axis, value, whether right)).

    Each node is split at the median of its widest axis; points that are all equal stay one leaf.
    """
    out, todo = [], [(np.arange(len(points)), ())]
    while todo:
        at, path = todo.pop()
        p = points[at]
        spread = p.max(axis=0) - p.min(axis=0) if len(at) else np.zeros(1)
        if len(at) <= rows or spread.max() <= 0:
            out.append((at, path))
            continue
        axis = int(spread.argmax())
        value = float(np.median(p[:, axis]))
        right = p[:, axis] > value
        if not right.any():
            right = p[:, axis] >= value
            value = float(np.nextafter(value, -np.inf))
        todo += [(at[~right], (*path, (axis, value, False))), (at[right], (*path, (axis, value, True)))]
    return out


def _boxes(paths: list[tuple], dims: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full((len(paths), dims), -np.inf), np.full((len(paths), dims), np.inf)
    for i, path in enumerate(paths):
        for axis, value, right in path:
            if right:
                low[i, axis] = max(low[i, axis], value)
            else:
                high[i, axis] = min(high[i, axis], value)
    return low, high


def _to_boxes(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=-1)


def cosines(vectors: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Each row's own sum, so that equal vectors get equal scores wherever they stand."""
    return (vectors * q).sum(axis=1) / (norms * q_norm)


class Tree:
    """A block of vectors, searched in order of projected distance."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        leaves = split(projected, LEAF_ROWS)
        order = np.concatenate([at for at, _ in leaves]) if len(ids) else np.zeros(0, dtype=np.int64)
        self.ids, self.vectors, self.points = ids[order], vectors[order], projected[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        ends = np.cumsum([len(at) for at, _ in leaves])
        self.leaves = [(int(e - len(at)), int(e)) for e, (at, _) in zip(ends, leaves) if len(at)]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.leaves])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.leaves])

    def nearest_of_copies(self, own: np.ndarray, q: np.ndarray, projected: np.ndarray, k: int, known: float, bound: float) -> list[tuple]:
        """``nearest`` for several ids that ask with one vector: one search, deep enough that each can leave out its own rows."""
        if len(own) == 1:
            return [self.nearest(int(own[0]), q, projected, k, known, bound)]
        _, times = np.unique(self.ids[np.isin(self.ids, own)], return_counts=True)
        ids, scores = self.nearest(None, q, projected, k + int(times.max(initial=0)), known, bound)
        return [(ids[ids != i][:k], scores[ids != i][:k]) for i in own]

    def nearest(self, own: int | None, q: np.ndarray, projected: np.ndarray, k: int, known: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Up to k (ids, scores), best first; ``known`` is a k-th best squared distance from elsewhere (inf: none).

        ``bound``: the stopping test holds once r^2 >= bound * d_k^2.  Leaves are opened in order of their distance, twice as
        many each time; points nearer than the next unopened leaf are verified in order, STEP of them between two tests.
        """
        q_norm = float(np.sqrt((q * q).sum()))
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        to = _to_boxes(projected, self.low, self.high)
        order = np.argsort(to, kind="stable")
        to = np.append(to[order], np.inf)
        rows, r = np.zeros(0, dtype=np.int64), np.zeros(0)  # opened and not verified yet, nearest first
        at, more = 0, 2
        limit = max(bound * known, TINY)
        while True:
            ready = int(np.searchsorted(r, min(limit, to[at]), side="right"))
            if not ready:
                if to[at] > limit or at >= len(order):
                    return ids, scores
                some = order[at:at + more]
                new = np.concatenate([np.arange(*self.leaves[i]) for i in some])
                gap = np.concatenate([self.points[slice(*self.leaves[i])] for i in some])
                gap -= projected
                rows, r = np.concatenate([rows, new]), np.concatenate([r, np.einsum("ij,ij->i", gap, gap)])
                by_distance = np.argsort(r, kind="stable")
                rows, r = rows[by_distance], r[by_distance]
                at, more = at + len(some), 2 * more
                continue
            if ready > STEP:
                ready = int(np.searchsorted(r, r[STEP], side="right"))  # equal distances are taken together
            found, rows, r = rows[:ready], rows[ready:], r[ready:]
            if own is not None:
                found = found[self.ids[found] != own]
            ids = np.concatenate([ids, self.ids[found]])
            scores = np.concatenate([scores, cosines(self.vectors[found], self.norms[found], q, q_norm)])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            d = min(known, max(0.0, 2 - 2 * float(scores[-1]))) if len(scores) == k else known
            limit = max(bound * d, TINY)


# ---- the plan ---------------------------------------------------------------------------------

def _valid(vector: Column, width: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, the largest component of each in [0.5, 1)."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def _descent(paths: list[tuple], ids: list[int], depth: int = 0):
    """The tree whose leaves have these paths: a leaf's number, or (axis, value, left, right)."""
    if len(ids) == 1:
        return ids[0]
    axis, value, _ = paths[ids[0]][depth]
    left, right = [i for i in ids if not paths[i][depth][2]], [i for i in ids if paths[i][depth][2]]
    return axis, value, _descent(paths, left, depth + 1), _descent(paths, right, depth + 1)


def _project(batch_vectors: np.ndarray, d: np.ndarray) -> np.ndarray:
    norms = np.sqrt((batch_vectors * batch_vectors).sum(axis=1))
    return (batch_vectors / norms[:, None]) @ d


def _parts(counts: dict[int, int], cells: int, rows: int) -> Column:
    """For each row's cell, how many parts of about ``rows`` rows its count makes."""
    parts = [max(1, math.ceil(counts.get(c, 0) / rows)) for c in range(cells)]
    if max(parts, default=1) == 1:
        return F.lit(1).cast("long")
    return F.coalesce(F.get(F.array(*[F.lit(m) for m in parts]), F.col("cell").cast("int")), F.lit(1)).cast("long")


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
           dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row for which ``queries`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("asks")).filter("vec_id IS NOT NULL")
    widths = rows.filter(F.size("v") > 0).select(F.size("v").alias("w"))
    width = widths.groupBy("w").count().orderBy(F.desc("count"), "w").first()
    width = width["w"] if width else 1
    rows = rows.filter(_valid(F.col("v"), width))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()  # bounded by SAMPLE
    d = directions(width, dims, seed)
    n = rows.count()
    points = _project(scaled(np.array([r["v"] for r in sample], dtype=np.float64).reshape(-1, width)), d)
    cells = split(points, max(1, math.ceil(CELL_ROWS * len(points) / max(n, 1))))
    paths = [path for _, path in cells]
    low, high = _boxes(paths, dims)
    top = _descent(paths, list(range(len(paths))))

    def cell_of(p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), dtype=np.int64)
        todo = [(top, np.arange(len(p)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                right = p[at, node[0]] > node[1]
                todo += [(node[2], at[~right]), (node[3], at[right])]
        return out

    def place(batches):
        for b in batches:
            v = scaled(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            p = _project(v, d)

            def lists(x: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(v), b.column(2), lists(p), pa.array(cell_of(p))], ["vec_id", "v", "asks", "p", "cell"])

    schema = "vec_id long, v array<double>, asks boolean, p array<double>, cell long"
    placed = materialize(rows.mapInArrow(place, schema), "ann_rows")
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a cell
    n_blocks = _parts(counts, len(paths), 2 * CELL_ROWS)
    data = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks)).select("cell", "block", "vec_id", "v", "p")
    asked = placed.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("p").alias("qp"), "cell")
    asked = asked.groupBy("query_id").agg(F.min(F.struct("qv", "qp", "cell")).alias("one")).select("query_id", "one.*")
    bound = chi2_bound(confidence, dims)
    found_schema = "query_id long, vec_id long, score double"

    def flat(table: pa.Table, name: str, n: int) -> np.ndarray:
        return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    def scan(block: pa.Table, qs: pa.Table) -> pa.Table:
        asked_by, ids, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        if len(block) and len(qs):
            tree = Tree(block["vec_id"].to_numpy(), flat(block, "v", width), flat(block, "p", dims))
            q_ids = qs["query_id"].to_numpy()
            known = np.array([math.inf if d_k is None else d_k for d_k in qs["known"].to_pylist()])
            q, p = flat(qs, "qv", width) + 0.0, flat(qs, "qp", dims)  # no negative zeros
            copies: dict[bytes, list[int]] = {}
            for i in np.argsort(q_ids):
                copies.setdefault(q[i].tobytes(), []).append(int(i))
            for at in copies.values():
                own = q_ids[at]
                for q_id, (i, s) in zip(own, tree.nearest_of_copies(own, q[at[0]], p[at[0]], k, float(known[at].max()), bound)):
                    asked_by.append(np.full(len(i), q_id)), ids.append(i), scores.append(s)
        return pa.table([pa.array(np.concatenate(x)) for x in (asked_by, ids, scores)], ["query_id", "vec_id", "score"])

    def per_cell(queries: DataFrame) -> dict[int, int]:
        return {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a cell

    def visit(queries: DataFrame, asking: dict[int, int]) -> DataFrame:
        n_parts = _parts(asking, len(paths), QUERY_ROWS)
        salted = (queries.withColumn("part", F.pmod(F.xxhash64("query_id"), n_parts))
                  .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))))
        repeated = data.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)))
        keys = ["cell", "block", "part"]
        return repeated.groupBy(*keys).cogroup(salted.groupBy(*keys)).applyInArrow(scan, found_schema)

    home = materialize(visit(asked.withColumn("known", F.lit(None).cast("double")), per_cell(asked)), "ann_home")
    worst = (_best(home, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("s"))
             .select("query_id", F.when(F.col("m") == k, F.greatest(2 - 2 * F.col("s"), F.lit(0.0))).alias("known")))
    open_queries = asked.join(worst, "query_id", "left")
    live = sorted(counts)

    def near(batches):
        """The other cells whose box the stopping test doesn't rule out."""
        at = np.array(live, dtype=np.int64)
        for b in batches:
            out = []
            for r in b.to_pylist():
                gap = _to_boxes(np.array(r["qp"]), low[at], high[at])
                most = math.inf if r["known"] is None else max(bound * r["known"], 1e-9)
                out += [{**r, "cell": int(c)} for c in at[gap <= most] if c != r["cell"]]
                while len(out) >= QUERY_ROWS:
                    yield pa.RecordBatch.from_pylist(out[:QUERY_ROWS], schema=b.schema)
                    out = out[QUERY_ROWS:]
            yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    asking = per_cell(open_queries.select("qp", "cell", "known").mapInArrow(near, "qp array<double>, cell long, known double"))
    cols = ["query_id", "qv", "qp", "cell", "known"]
    reach = open_queries.select(*cols).mapInArrow(near, "query_id long, qv array<double>, qp array<double>, cell long, known double")
    others = visit(reach, asking)
    return _best(home.unionByName(others), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@register("op2_ann_search")
def op2_ann_search(spark, sf_dir):
    return search(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
