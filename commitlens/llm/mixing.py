"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. **Targets**: source s of weight w gets min(repeats * size, level * w) words, where the level is the
   one at which all targets sum to the budget (the excess of a capped source is reshared by weight).
2. **Quotas**: the budget is ``round(budget / block)`` blocks ("seats").  Seats go to the highest quotients
   target / (2 j - 1).  The order of the seats is cut into equal runs, one a shard, so each shard has an
   integer quota of every source.  Only the quotients around the cut are ranked: a bound on the
   divisor says how many seats of each source are surely in, and about two a source are left to compare.
3. **Selection**: the documents of a source stand in seeded hash order and form one stream of words, cut
   into blocks of ``block`` words.  A seeded block starts the round; the shards take their quotas of
   blocks one after the other around the stream, so no block is taken again before all others are.
   Each document's words are given out shard by shard: ``shard_words`` holds what every shard takes of it.
   Hence no document is taken more than ``repeats`` times, as no source has more than ``repeats`` times its blocks.

All of it is DataFrame work: a source that holds a third of all rows is dealt over ``BUCKETS`` hash
buckets, whose sums are added up first.  Source-level steps run on one row a source.
A null source is a source of its own, last in order.  Null texts count no words.  Rows without words take
no part in the mix (taken 0).  Repeated rows each have their own place.  Empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, keep_rows, materialize, register, text_key, word_count

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
REPEATS = 3
#: words of a block
BLOCK = 64
SHARDS = 8
#: hash buckets of a source, from the first three hex digits of a row's seeded MD5
BUCKET_DIGITS = 3


class Mix(NamedTuple):
    """rows: doc_id, key_of_text, source, size, place; sources: one row a source with target, blocks, first, seats, ends
    (seats given out up to and with each shard)."""
    rows: DataFrame
    sources: DataFrame
    quotas: DataFrame


def _seeded(seed: str, col: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), col.cast("string")).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> plus rank (code point order, null last), weight, target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(n)) + 1).cast("int"))
    ranked = materialize(sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight.cast("long")), "mix_sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    cap, level, capped = F.col("source_size") * repeats, 0.0, -1
    while True:  # each turn caps at least one more source
        above = F.lit(False) if capped < 0 else F.col("weight") * F.lit(level) > cap
        row = ranked.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("full"),
                         F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("w"),
                         F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (total - row["full"]) / row["w"]
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def apportion(parties: DataFrame, seats: list[int]) -> DataFrame:
    """Sainte-Lague: (source, rank, target) -> (house, source, rank, seats) for each number of seats in ``seats``.

    Ties of quotients go to the smaller rank.  Parties without a target get none.
    """
    live = parties.filter("target > 0").select("source", "rank", "target")
    row = live.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first()
    houses = F.array(*[F.struct(F.lit(i).alias("house"), F.lit(int(h)).cast("long").alias("h")) for i, h in enumerate(seats)])
    total = F.lit(max(row["t"], 1e-300))
    low = F.floor((F.col("target") * (2 * F.col("h") - row["n"]) / total + 1) / 2) - 1  # surely among the first h
    high = F.floor((F.col("target") * (2 * F.col("h") + row["n"]) / total + 1) / 2) + 1  # surely not all
    bounds = (live.withColumn("_house", F.explode(houses)).select("_house.*", "source", "rank", "target")
              .select("house", "h", "source", "rank", "target", F.greatest(low, F.lit(0)).cast("long").alias("low"), high.cast("long").alias("high")))
    sure = Window.partitionBy("house")
    open_seats = (bounds.withColumn("open", F.col("h") - F.sum("low").over(sure))
                  .withColumn("j", F.explode(F.sequence(F.col("low") + 1, F.greatest("high", F.col("low") + 1))))
                  .withColumn("quotient", F.col("target") / (2 * F.col("j") - 1)))
    by_quotient = Window.partitionBy("house").orderBy(F.desc("quotient"), "rank", "j")
    won = open_seats.withColumn("no", F.row_number().over(by_quotient))
    return won.groupBy("house", "source", "rank").agg(
        (F.first("low") + F.count(F.when(F.col("no") <= F.col("open"), 1))).alias("seats"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: str = SEED, block: int = BLOCK, shards: int = SHARDS, repeats: int = REPEATS) -> Mix:
    place = _seeded(seed, F.coalesce(F.col(id_col).cast("string"), text_key(F.col(text_col)).cast("string")))
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key_of_text"),
                                   F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
                                   place.alias("place")), "mix_rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), repeats=repeats)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    start = F.conv(F.substring(_seeded(seed, F.coalesce("source", F.lit(""))), 1, 8), 16, 10).cast("long")
    facts = materialize(targets.withColumn("blocks", blocks).withColumn("first", F.pmod(start, F.greatest(blocks, F.lit(1)))), "mix_targets")
    words = facts.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    seats = (2 * words + block) // (2 * block)
    won = materialize(apportion(facts, [seats * (k + 1) // shards for k in range(shards)]), "mix_seats")
    in_turn = Window.partitionBy("source").orderBy("house")
    capped = won.join(facts.select("rank", "blocks"), "rank").withColumn("upto", F.least(F.col("seats"), F.col("blocks") * repeats))
    before = F.coalesce(F.lag("upto").over(in_turn), F.lit(0))
    quotas = capped.select(F.col("house").alias("shard"), "source", before.alias("first_seat"), (F.col("upto") - before).alias("quota"))
    by_shard = capped.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("house", "upto"))), lambda x: x["upto"]).alias("_ends"))
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    sources = (facts.join(by_shard, "rank", "left").withColumn("ends", F.coalesce("_ends", none)).drop("_ends")
               .withColumn("seats", F.element_at("ends", shards)))
    return Mix(rows, materialize(sources, "mix_plan"), quotas)


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length of the part that [a, b) and [c, d) share."""
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = SEED, block: int = BLOCK, shards: int = SHARDS, repeats: int = REPEATS) -> DataFrame:
    """One row per document: doc_id, key_of_text, source, size, source_size, target, taken, shard_words (words that each
    shard takes of it, by the shards' quotas; they sum to ``taken``)."""
    m = plan_mix(docs, id_col, text_col, source_col, seed, block, shards, repeats)
    bucket = F.substring("place", 1, BUCKET_DIGITS).alias("bucket")
    rows = m.rows.select("*", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    facts = m.sources.select(F.col("source").alias("_source"), "source_size", "target", "blocks", "first", "ends")
    offsets = (offsets.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "bucket_size")
               .withColumnsRenamed({"source": "_source", "bucket": "_bucket"}))
    met = rows.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    order = (Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", "key_of_text")
             .rowsBetween(Window.unboundedPreceding, -1))
    a = F.col("offset") + F.coalesce(F.sum("size").over(order), F.lit(0))
    met = met.withColumn("a", a).withColumn("b", F.col("a") + F.col("size"))
    n = F.greatest("blocks", F.lit(1))

    def words_of(seats: Column) -> Column:
        """Words of the document in the first ``seats`` blocks around the stream."""
        end = F.col("first") + F.pmod(seats, n)
        return (F.floor(seats / n) * F.col("size")
                + _overlap(F.col("a"), F.col("b"), F.col("first") * block, F.least(end, n) * block)
                + _overlap(F.col("a"), F.col("b"), F.lit(0), F.greatest(end - n, F.lit(0)) * block)).cast("long")

    met = met.withColumn("upto", F.transform("ends", words_of))
    by_shard = F.transform("upto", lambda words, i: words - F.when(i > 0, F.get("upto", i - 1)).otherwise(F.lit(0).cast("long")))
    return met.select("doc_id", "key_of_text", "source", "size", "source_size", "target", F.element_at("upto", shards).alias("taken"),
                      by_shard.alias("shard_words"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows with all columns of ``docs``: each as often as its words are taken, rounded to whole documents."""
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest("size", F.lit(1))))
    kept = (mix(docs, id_col, text_col, source_col).withColumn("times", times).groupBy("doc_id", "key_of_text", "source")
            .agg(F.sum("times").cast("int").alias("_times")).filter("_times > 0"))
    named = kept.withColumnsRenamed({"doc_id": "_id", "key_of_text": "_key", "source": "_source"})
    return keep_rows(docs, named, id_col, text_col, times="_times", source_col=source_col)


def _sql_words(k: int) -> str:
    """Words of a document in the blocks given out up to and with shard k."""
    end = f"(first + u{k} % n)"
    return (f"((u{k} // n) * size + greatest(least(b, least({end}, n) * {BLOCK}) - greatest(a, first * {BLOCK}), 0)"
            f" + greatest(least(b, greatest({end} - n, 0) * {BLOCK}) - a, 0))::BIGINT AS t{k}")


_WORDS_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
c AS (SELECT *, sum(cap) OVER o - cap AS below, sum(weight) OVER o - weight AS gone FROM w
      WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank ROWS UNBOUNDED PRECEDING)),
l AS (SELECT ((SELECT sum(source_size) FROM w) - below)::DOUBLE / ((SELECT sum(weight) FROM w) - gone) AS level
      FROM c WHERE ((SELECT sum(source_size) FROM w) - below)::DOUBLE / ((SELECT sum(weight) FROM w) - gone) * weight <= cap
      ORDER BY cap::DOUBLE / weight, rank LIMIT 1),
t AS (SELECT *, least(cap::DOUBLE, weight * (SELECT level FROM l)) AS target,
             ceil(source_size / {BLOCK})::BIGINT AS blocks FROM w),
q AS (SELECT rank, target / (2 * j - 1) AS quotient FROM (
        SELECT rank, target, unnest(range(1, (target / {BLOCK})::BIGINT + 40)) AS j FROM t WHERE target > 0)),
no AS (SELECT rank, row_number() OVER (ORDER BY quotient DESC, rank) AS no,
              (SELECT (2 * sum(source_size) + {BLOCK}) // {2 * BLOCK} FROM t)::BIGINT AS seats FROM q),
won AS (SELECT rank, {", ".join(f"count(*) FILTER (no <= seats * {k + 1} // {SHARDS}) AS s{k}" for k in range(SHARDS))} FROM no GROUP BY rank),
p AS (SELECT t.*, greatest(blocks, 1) AS n, {", ".join(f"least(coalesce(s{k}, 0), {REPEATS} * blocks) AS u{k}" for k in range(SHARDS))},
             ('0x' || substr(md5('{SEED}|' || coalesce(source, '')), 1, 8))::BIGINT % greatest(blocks, 1) AS first
      FROM t LEFT JOIN won USING (rank)),
pos AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('{SEED}|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - size AS a FROM d),
r AS (SELECT doc_id, size, source_size, target, {", ".join(_sql_words(k) for k in range(SHARDS))}
      FROM (SELECT pos.*, pos.a + pos.size AS b, p.* EXCLUDE (source) FROM pos JOIN p ON pos.source IS NOT DISTINCT FROM p.source))
"""
_MIX_COLS = f"SELECT doc_id, size, source_size, target, t{SHARDS - 1} AS taken"
_SHARD_COLS = ", ".join(f"t{k}{f' - t{k - 1}' if k else ''} AS shard_{k}_words" for k in range(SHARDS))
_SQL = f"{_WORDS_SQL}{_MIX_COLS} FROM r"


@register("op9_mix_sources", f"{_WORDS_SQL}{_MIX_COLS}, {_SHARD_COLS} FROM r")
def op9_mix_sources(spark, sf_dir):
    """``taken``, and how much of it each shard's quota takes."""
    words = [F.get("shard_words", F.lit(k)).alias(f"shard_{k}_words") for k in range(SHARDS)]
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", *words)
