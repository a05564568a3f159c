"""Token counts as delta-maintained rollups.

A **change** says what a document counted before and counts now, each as (source, lang, version, tokens, bytes) or
missing: missing before is an insert, missing after a delete, both present a revised count (a new tokenizer
version moves the document from one group to another).  A change turns into signed rows, -1 for
what was and +1 for what is, so totals by (source, lang, version) are sums and can be kept up by
adding: no stored document is read again.

A **store** is a folder with one sub-folder a batch that holds the batch's sums:

* within a batch, a change that is delivered twice (same ``change_id``) counts once; if deliveries under one id differ, the least of
  them counts, whatever the order; changes without an id cannot be told from repeats, so each of them counts;
* a batch counts when its folder has been written whole (Spark's ``_SUCCESS`` file is put last), and a committed batch is
  not written again, so a replay after a lost driver or a repeated delivery changes nothing, and a half-written folder is
  overwritten by the next try;
* ``compact`` adds the committed batches up into one folder and records which batches it holds; batches that
  are in it are ignored from then on, so a crash at any point counts nothing twice.  Folders that an earlier compaction replaced
  are removed, those that this one replaces stay until the next, so totals asked for before can still be read.

Groups of null source or language are groups of their own.  Groups whose documents are all gone drop out of the totals.
Null token counts add nothing.  A hot source costs one row a task: sums are taken before the shuffle.
An empty batch commits an empty folder.  Other columns of the changes are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import documents, materialize, register, word_count

GROUP = ("source", "lang", "version")
SUMS = ("n_docs", "n_tokens", "n_bytes")
_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long, n_bytes long"


def state(source: Column, lang: Column, version: Column, tokens: Column, n_bytes: Column) -> Column:
    """What a document counts: the ``before`` or ``after`` of a change."""
    return F.struct(source.cast("string").alias("source"), lang.cast("string").alias("lang"), version.cast("string").alias("version"),
                    F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"), F.coalesce(n_bytes.cast("long"), F.lit(0)).alias("bytes"))


def signed(changes: DataFrame) -> DataFrame:
    """(change_id, before, after) -> signed rows (source, lang, version, n_docs, n_tokens, n_bytes)."""
    named, nameless = F.col("change_id").isNotNull(), F.col("change_id").isNull()
    once = (changes.filter(named).groupBy("change_id").agg(F.min(F.struct("before", "after")).alias("least")).select("least.*")
            .unionByName(changes.filter(nameless).select("before", "after")))
    sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("s")))
    rows = once.select(F.explode(sides).alias("side")).select("side.sign", "side.s").filter(F.col("s").isNotNull())
    tokens, n_bytes = F.coalesce("s.tokens", F.lit(0)), F.coalesce("s.bytes", F.lit(0))
    return rows.select("s.source", "s.lang", "s.version", F.col("sign").cast("long").alias("n_docs"),
                       (F.col("sign") * tokens).cast("long").alias("n_tokens"), (F.col("sign") * n_bytes).cast("long").alias("n_bytes"))


def add_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])


class RollupStore:
    """Totals under a shared folder; safe to commit to again after any failure.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _committed(self, kind: str) -> list[str]:
        """Names of the whole folders ``kind=name``, in order."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name, at = status.getPath().getName(), status.getPath()
            if name.startswith(f"{kind}=") and fs.exists(at.suffix("/_SUCCESS")):
                found.append(name[len(kind) + 1:])
        return sorted(found)

    def batches(self) -> list[str]:
        """Ids of all committed batches, compacted ones included."""
        base = self._base()
        held = [r["batch_id"] for r in self._held(base).collect()] if base else []  # one row a batch
        return sorted({*self._committed("batch"), *held})

    def _base(self) -> str | None:
        """Name of the latest compaction."""
        return max(self._committed("base"), default=None)

    def _held(self, base: str) -> DataFrame:
        return self.spark.read.schema("batch_id string").parquet(f"{self.path}/held={base}")

    def holds(self, batch_id: str) -> bool:
        fs, done = self._fs(f"{self.path}/batch={batch_id}/_SUCCESS")
        if fs.exists(done):
            return True
        base = self._base()
        return base is not None and not self._held(base).filter(F.col("batch_id") == batch_id).isEmpty()

    def _loose(self, base: str | None) -> list[str]:
        """Batch folders that are not in the compaction: those since then, for the ones in it go with the next."""
        found = self._committed("batch")
        if base is None or not found:
            return found
        held = {r["batch_id"] for r in self._held(base).filter(F.col("batch_id").isin(found)).collect()}
        return [b for b in found if b not in held]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and nothing done, if it is committed already."""
        if self.holds(batch_id):
            return False
        add_up(signed(changes)).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens, n_bytes) over all committed batches."""
        base = self._base()
        folders = [f"{self.path}/base={base}"] if base is not None else []
        folders += [f"{self.path}/batch={b}" for b in self._loose(base)]
        if not folders:
            return self.spark.sql("SELECT 1 AS x").filter("false").select(
                *[F.lit(None).cast("string").alias(c) for c in GROUP], *[F.lit(None).cast("long").alias(c) for c in SUMS])
        rows = self.spark.read.schema(_SCHEMA).parquet(*folders)
        return add_up(rows).filter(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Fold all committed batches into one folder."""
        base = self._base()
        loose = self._loose(base)
        if not loose:
            return
        replaced = [f"batch={b}" for b in self._committed("batch") if b not in loose]
        replaced += [f"{kind}={b}" for b in self._committed("base") if b != base for kind in ("base", "held")]
        name = f"{int(base or 0) + 1:06d}"
        held = self.spark.createDataFrame([(b,) for b in loose], "batch_id string")
        if base is not None:
            held = held.unionByName(self._held(base))
        held.write.mode("overwrite").parquet(f"{self.path}/held={name}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/base={name}")  # counts from here on
        for folder in replaced:
            fs, at = self._fs(f"{self.path}/{folder}")
            fs.delete(at, True)


def commit_stream(store: RollupStore, changes: DataFrame, checkpoint: str):
    """Commit a stream of changes, one store batch a micro-batch; a micro-batch that is run again counts once."""
    return (changes.writeStream.foreachBatch(lambda df, n: store.commit(f"stream-{n:012d}", df))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def bpe_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) by a tokenizers-library file, for feeding real token counts into changes; null texts count 0."""
    import pyarrow as pa

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of fixed size

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec.value)
        t.encode_special_tokens = True
        for b in batches:
            found = t.encode_batch([x or "" for x in b.column(1).to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.ids) for x in found], pa.int64())], ["doc_id", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tokens long")


# ---- the query: a corpus that is loaded, cleaned and moved to a new tokenizer version ----------

V1, V2 = "words-1", "words-2"
#: rows with fewer words than this are deleted by the second batch
LEAST_WORDS = 20
#: what counts as a token in version 2: runs of letters and digits, or one other character that is not a space
V2_TOKEN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"


def corpus_changes(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Narrow counts of every document, and three batches of changes derived from them.

    1 inserts every document under version 1; 2 deletes those of fewer than LEAST_WORDS words;
    3 revises the rest of the documents that are not English to version 2.
    """
    text = F.col("text")
    counts = materialize(docs.select(
        F.xxhash64("doc_id", text).alias("row_key"), "source", "lang", word_count(text).alias("v1"),
        F.coalesce(F.regexp_count(text, F.lit(V2_TOKEN)), F.lit(0)).cast("long").alias("v2"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
        .groupBy("row_key", "source", "lang", "v1", "v2", "n_bytes").agg(F.count(F.lit(1)).alias("copies")), "token_counts")
    rows, key, one, two, none, short = _states(counts)
    moved = ~short & ~F.col("lang").eqNullSafe(F.lit("en"))
    return counts, [rows.select(key, none.alias("before"), one.alias("after")),
                    rows.filter(short).select(key, one.alias("before"), none.alias("after")),
                    rows.filter(moved).select(key, one.alias("before"), two.alias("after"))]


def _states(counts: DataFrame) -> tuple[DataFrame, Column, Column, Column, Column, Column]:
    """A row a document; the id of its changes; what it counts under version 1, under 2, and when absent; whether it is short."""
    rows = counts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    one = state(F.col("source"), F.col("lang"), F.lit(V1), F.col("v1"), F.col("n_bytes"))
    two = state(F.col("source"), F.col("lang"), F.lit(V2), F.col("v2"), F.col("n_bytes"))
    none = F.lit(None).cast(counts.select(one.alias("s")).schema["s"].dataType)
    key = F.struct("row_key", "source", "lang", "copy").alias("change_id")
    return rows, key, one, two, none, F.col("v1") < LEAST_WORDS


def returned_changes(counts: DataFrame) -> DataFrame:
    """A fourth batch: the documents that the second deleted come in again, under version 2, so the totals cover every document."""
    rows, key, _, two, none, short = _states(counts)
    return rows.filter(short).select(key, none.alias("before"), two.alias("after"))


_SQL = rf"""
WITH d AS (SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS v1,
                  coalesce(len(regexp_extract_all(text, '{V2_TOKEN}')), 0) AS v2, coalesce(strlen(text), 0) AS n_bytes FROM documents),
s AS (SELECT source, lang, CASE WHEN lang = 'en' AND v1 >= {LEAST_WORDS} THEN '{V1}' ELSE '{V2}' END AS version,
             CASE WHEN lang = 'en' AND v1 >= {LEAST_WORDS} THEN v1 ELSE v2 END AS tokens, n_bytes FROM d)
SELECT source, lang, version, count(*) AS n_docs, sum(tokens)::BIGINT AS n_tokens, sum(n_bytes)::BIGINT AS n_bytes
FROM s GROUP BY source, lang, version"""


@register("op5_token_rollups", _SQL)
def op5_token_rollups(spark, sf_dir):
    """Four batches, each delivered twice in a row, with a compaction in between."""
    store = RollupStore(spark, scratch_path(spark, "llm_rollups"))
    counts, batches = corpus_changes(documents(spark, sf_dir))
    for n, changes in enumerate([*batches, returned_changes(counts)]):
        store.commit(f"{n:04d}", changes)
        store.commit(f"{n:04d}", changes)
        if n == 1:
            store.compact()
    return store.totals()
