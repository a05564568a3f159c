"""Language of files whose name leaves it open (F14): naive Bayes as joins and sums.

``learn`` counts, over files whose name settles their language, in how many files of each language a token occurs; ``decide`` joins
the distinct tokens of the open files to those counts and takes the candidate with the highest sum

    ln P(l) + sum over tokens t of ln((files of l with t + 1) / (files of l + 2)).

A token that no file of a candidate has adds the same constant, so only tokens that meet a count are joined: the sum over the
others follows from the number of tokens.  Texts are screened by the asked ids where they lie, and those that may be asked for leave as
tokens, once; a token that every file has is counted by partial aggregation, and joined by hash or, where the planner finds the counts
small, by broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import extension
from ..session import materialise
from .parallel import screened

# Extensions that several languages of the public Linguist list share
AMBIGUOUS = {
    ".h": ("c", "c++", "objective-c"),
    ".m": ("matlab", "objective-c"),
    ".pl": ("perl", "prolog"),
    ".fs": ("f#", "glsl"),
    ".v": ("coq", "verilog"),
}
#: names, numbers as one token, and single marks
TOKEN = r"[A-Za-z_]\w*|[0-9]+|[^\s\w]"


def tokens(text: str | Column) -> Column:
    """The distinct tokens of a text; every number is ``0``."""
    found = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN), F.lit(0))
    # ":" follows "9": what stands between starts with a digit, and so is a number
    return F.array_distinct(F.transform(found, lambda t: F.when((t >= "0") & (t < ":"), "0").otherwise(t)))


def candidates(path: str | Column, ambiguous: Mapping[str, Sequence[str]] = AMBIGUOUS) -> Column:
    """The languages that a file's extension leaves open (null: none)."""
    open_ = [x for e, languages in sorted(ambiguous.items()) for x in (F.lit(e), F.array(*[F.lit(x) for x in sorted(languages)]))]
    return F.element_at(F.create_map(*open_), extension(path))


def _tokens_of(blobs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _text, _ts): the texts and tokens of blobs that ``asked`` (written once) may name; an exact join must follow."""
    named = asked.select(id_col).where(F.col(id_col).isNotNull())
    return screened(blobs.select(id_col, F.col(text_col).alias("_text")), named, [id_col]).withColumn("_ts", F.coalesce(tokens("_text"), F.array().cast("array<string>")))


def _each(ts: str) -> Column:
    """A row for every token, and one with a null token that stands for the file itself.  There is always one, and ``explode``
    would have the planner ask so of every text: it would be searched once more."""
    return F.explode_outer(F.concat(ts, F.array(F.lit(None).cast("string"))))


def learn(files: DataFrame, blobs: DataFrame, id_col: str = "blob_id", lang_col: str = "programming_language",
          text_col: str = "text") -> DataFrame:
    """The model, written once: (token, language, n), n files of the language with the token; token null: all files of the language."""
    known = materialise(files.select(id_col, F.col(lang_col).alias("language")).where("language IS NOT NULL").distinct(), "known_files")
    rows = _tokens_of(blobs.where(F.col(text_col).isNotNull()), known, id_col, text_col).drop("_text").join(known, id_col)
    counts = rows.select("language", _each("_ts").alias("token")).groupBy("token", "language").agg(F.count(F.lit(1)).alias("n"))
    return materialise(counts, "model")  # read several times; texts are not


def decide(files: DataFrame, blobs: DataFrame, model: DataFrame, id_col: str = "blob_id", candidates_col: str = "candidates",
           text_col: str = "text") -> DataFrame:
    """(id, candidates, language) of every distinct (id, candidates) of ``files``; of equal sums the first name.

    A blob may be open between different candidates under different paths.  A candidate that the model has no file of is
    no choice; a file none of whose candidates it has, or whose blob is missing, has a null language.
    """
    asked = materialise(files.select(id_col, F.array_sort(candidates_col).alias("_c")).distinct().withColumn("_file", F.xxhash64(id_col, "_c")), "open_files")
    # one row a language
    sizes = model.where("token IS NULL").select("language", F.col("n").alias("_files"), F.sum("n").over(Window.partitionBy("token")).alias("_all"))
    counts = model.join(sizes, "language").alias("_m")
    # the size of no text is what ``size`` gives for it
    texts = _tokens_of(blobs, asked, id_col, text_col).select(id_col, "_ts", F.size(F.when(F.col("_text").isNotNull(), F.col("_ts"))).alias("_n")).join(asked, id_col)
    # a file's null token meets the size of each language, so every candidate of the model has a row
    met = (texts.select("_file", "_c", "_n", _each("_ts").alias("token")).alias("_t").join(counts, F.col("_t.token").eqNullSafe(F.col("_m.token")))
           .where(F.array_contains("_c", F.col("language"))))
    base = F.log(F.col("_files") / F.col("_all")) - F.col("_n") * F.log(F.col("_files") + 2)
    scored = met.groupBy("_file", "language").agg(F.max(F.when(F.col("_t.token").isNull(), base)).alias("_base"),
                                                  F.sum(F.when(F.col("_t.token").isNotNull(), F.log(F.col("n") + 1))).alias("_met"))
    scored = scored.select("_file", "language", F.round(F.col("_base") + F.coalesce("_met", F.lit(0.0)), 9).alias("_s"))
    first = scored.groupBy("_file").agg(F.min(F.struct((-F.col("_s")).alias("_s"), "language"))["language"].alias("language"))
    return asked.join(first, "_file", "left").select(id_col, F.col("_c").alias(candidates_col), "language")
