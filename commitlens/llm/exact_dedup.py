"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

Two texts are equal when they are identical after deleting the six ASCII white-space characters;
a null text counts as empty.  The collection is taken in batches:

1. Each batch is digested (SHA-256 of the normalised UTF-8 text) and its own duplicates are
   grouped with map-side combine, so a text that holds a third of all rows is one row a task.
2. Every earlier batch is an immutable snapshot: a table of distinct digests and, for each hash
   shard, one static binary-fuse filter.  Incoming distinct digests meet the filter of their shard;
   most new texts stop there.  Only positives join the snapshot's exact buckets.
3. All members of a group of two or more are compared byte by byte (smallest and largest normalised
   text of the digest must be the same); a digest that stands for two texts stops the job.

Of equal texts the row with the most code points in the original text stays, then the smallest
doc_id (a null doc_id comes last).  Rows that repeat both doc_id and text are members of their
group like any other; one of them stays.  An empty table gives an empty result.  Only the id and
text columns are read, so extra columns of any name are harmless.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import documents, keep_rows, materialize, register, same, text_key

WHITE_SPACE = b" \t\n\x0b\x0c\r"
#: distinct digests a filter shard is sized for
SHARD_ROWS = 1 << 15
BATCHES = 2


class Snapshot(NamedTuple):
    """Immutable: distinct digests (sha, key, n, best) and their filters (shard, filter) over ``shards`` shards."""
    groups: DataFrame
    filters: DataFrame
    shards: int


def normalised(text: Column) -> Column:
    """The text as compared: white space deleted, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the original text), key_of_text, sha (SHA-256 of the normalised text)."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            sha = [hashlib.sha256((t.as_py() or b"").translate(None, WHITE_SPACE)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(sha, pa.binary())],
                                             ["doc_id", "n_points", "key_of_text", "sha"])

    points = F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("long")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), points.alias("n_points"), F.col(text_col).alias("text"),
                        text_key(F.col(text_col)).alias("key_of_text"))
            .mapInArrow(digest, "doc_id long, n_points long, key_of_text long, sha binary"))


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: n rows, and ``best`` = (-code points, doc_id missing, doc_id, text key) of the row that stays."""
    best = F.min(F.struct((-F.col("n_points")).alias("neg_points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_of_text"))
    return (rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
            .withColumn("key", F.xxhash64("sha")))


def build_snapshot(groups: DataFrame, shards: int) -> Snapshot:
    """Freeze distinct digests: written once, one filter per hash shard."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        built = fuse.build(pdf["key"].to_numpy("int64").view("uint64"))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [built]})

    filters = (groups.select(_shard(shards), "key").groupBy("shard").applyInPandas(one, "shard long, filter binary"))
    return Snapshot(groups, materialize(filters, "fuse_filters"), shards)


def screen(incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The incoming digests plus ``maybe``: false only if the snapshot surely lacks the digest."""
    cols = ["sha", "n", "best", "key"]

    def probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        f = bytes(filters["filter"].iloc[0]) if len(filters) else None
        rows["maybe"] = fuse.contains(f, rows["key"].to_numpy("int64").view("uint64"))
        return rows[["sha", "key", "maybe"]]

    asked = incoming.select("sha", "key", _shard(snapshot.shards))
    flagged = (asked.groupBy("shard").cogroup(snapshot.filters.groupBy("shard"))
               .applyInPandas(probe, "sha binary, key long, maybe boolean"))
    return incoming.select(*cols).join(flagged.select("sha", "maybe"), "sha")


def _shard(shards: int) -> Column:
    return F.pmod(F.col("key"), F.lit(shards)).alias("shard")


def dedup_groups(rows: DataFrame, batch: Column, batches: int) -> DataFrame:
    """Groups over all batches, taken in order 0..batches-1: sha, n, best."""
    numbered = rows.withColumn("_batch", batch)
    known: DataFrame | None = None
    for b in range(batches):
        incoming = materialize(group_digests(numbered.filter(F.col("_batch") == b)), "digest_groups")
        if known is None:
            known = incoming
            continue
        shards = max(1, math.ceil(max(known.count(), incoming.count()) / SHARD_ROWS))
        snapshot = build_snapshot(known, shards)
        screened = materialize(screen(incoming, snapshot), "screened")
        buckets = snapshot.groups.select("sha")
        maybe = screened.filter("maybe").drop("maybe")
        seen = maybe.join(buckets, "sha", "left_semi")
        new = screened.filter("NOT maybe").drop("maybe").unionByName(maybe.join(buckets, "sha", "left_anti"))
        merged = (snapshot.groups.unionByName(seen).groupBy("sha")
                  .agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.first("key").alias("key")))
        known = merged.unionByName(new)
        if b + 1 < batches:
            known = materialize(known, "snapshot")
    return known.select("sha", "n", "best")


def byte_checked(groups: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The groups, after comparing the normalised bytes of all members of each group of two or more."""
    members = (rows.join(groups.filter("n > 1").select("sha"), "sha", "left_semi")
               .select("doc_id", "key_of_text", "sha"))
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(text).alias("_key"), normalised(text).alias("_norm"))
    found = members.join(texts, same(F.col("doc_id"), F.col("_id")) & (F.col("key_of_text") == F.col("_key")))
    checked = found.groupBy("sha").agg(F.min("_norm").alias("lo"), F.max("_norm").alias("hi")) \
        .select("sha", (F.col("lo") == F.col("hi")).alias("equal"))
    stop = F.raise_error(F.lit("two different texts have one SHA-256 digest"))
    fine = F.col("equal").isNull() & (F.col("n") == 1) | F.col("equal")
    kinds = dict(groups.dtypes)  # every column waits for the check, so none can be used without it
    return groups.join(checked, "sha", "left").select(
        "sha", *[F.when(fine, F.col(c)).otherwise(stop.cast(kinds[c])).alias(c) for c in ("n", "best")])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per input row: doc_id, key_of_text, keep_id, group_size, kept, sha (binary).

    Batches are dealt by a hash of doc_id; all rows of all batches are deduplicated together.
    """
    ids = ["doc_id", "key_of_text", "sha", "n_points"]
    rows = materialize(digest_rows(docs, id_col, text_col).groupBy(*ids).agg(F.count(F.lit(1)).alias("copies")), "digests")
    singles = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    groups = dedup_groups(singles, F.pmod(F.xxhash64("doc_id"), F.lit(batches)), batches)
    checked = byte_checked(materialize(groups, "groups"), rows, docs, id_col, text_col)
    stays = (same(F.col("doc_id"), F.col("best.doc_id")) & (F.col("key_of_text") == F.col("best.key_of_text"))
             & (F.col("copy") == 1))
    return (singles.join(checked.select("sha", F.col("n").alias("group_size"), "best"), "sha")
            .select("doc_id", "key_of_text", F.col("best.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "sha"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    return keep_rows(docs, kept.select(F.col("doc_id").alias("_id"), F.col("key_of_text").alias("_key")), id_col, text_col)


@register("op10_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n_points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""")
def op10_exact_dedup(spark, sf_dir):
    out = exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
