"""Language classification of changed files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.language import (IMAGE_EXTENSIONS, blob_language_facts, extension, is_vendored,
                                  language_by_name, language_of_text, programming_language)

DEFAULT_SUPPORTED = ("python", "java", "javascript")


class Drops:
    """Rows that a plan drops, by reason, counted by the jobs that run it (``DataFrame.observe``)."""

    def __init__(self):
        self.found: list[Observation] = []

    def observation(self, name: str) -> Observation:
        self.found.append(Observation(f"drops_{name}_{uuid.uuid4().hex[:8]}"))
        return self.found[-1]

    def counts(self) -> dict[str, int]:
        """Once the plan has run: reason -> rows."""
        return {reason: n for o in self.found for reason, n in o.get.items()}


def classify_files(df: DataFrame, path_col: str = "file_path", text_col: str | None = None,
                   keep_unknown: bool = False) -> DataFrame:
    """Add ``programming_language``; drop binary, vendored and unknown files unless ``keep_unknown``."""
    out = df.withColumn("programming_language", programming_language(path_col, text_col))
    return out if keep_unknown else out.where(F.col("programming_language").isNotNull())


def dropped_by_name(path: str | Column) -> Column:
    """Vendored files and images: no content makes them files of a language."""
    return is_vendored(path) | F.coalesce(extension(path).isin(*IMAGE_EXTENSIONS), F.lit(False))


def classify_changes(changes: DataFrame, blobs: DataFrame, path_col: str = "file_path",
                     blob_col: str = "new_blob_id", id_col: str = "blob_id", text_col: str = "text", store=None, drops: Drops | None = None, lines: bool = False) -> DataFrame:
    """Classify changes using their blob content, computing content facts once per blob, before the shuffle.
    With ``store`` (a ``BlobStore``) only blobs that it has not seen are read; with ``lines`` it keeps the hashes of their
    lines as well, for a caller that asks for diffs later.

    Paths that settle the matter (vendored, images) go first, so their content is not looked at.

    Inner join on the blob: a change whose object is missing is dropped (only that row).  ``drops`` counts what is dropped
    and why, in the same pass.
    """
    settled = dropped_by_name(path_col)
    if drops is not None:
        changes = changes.observe(drops.observation("paths"), F.count(F.lit(1)).alias("changes"), F.count_if(F.col(blob_col).isNull()).alias("deleted"),
                                  F.count_if(F.col(blob_col).isNotNull() & settled).alias("vendored_or_image"))
    changes = changes.where(~settled & F.col(blob_col).isNotNull())
    if store is not None:
        ids = changes.select(F.col(blob_col).alias("blob_id")).distinct()
        facts = store.facts(blobs, ids, id_col, text_col, lines).select(F.col("blob_id").alias(blob_col), "_has_nul", "_shebang_lang")
    else:  # facts are computed where the blob is read (map side), so only narrow columns shuffle; a semi join with the
        # asked ids would be moved below them by the planner, and shuffle the texts
        facts = blobs.select(F.col(id_col).alias(blob_col), *blob_language_facts(text_col))
    if drops is None:
        met = changes.join(facts, blob_col, "inner")
    else:
        met = changes.join(facts.withColumn("_known", F.lit(True)), blob_col, "left")
        no_language = F.col("_known").isNotNull() & language_of_text(path_col, "_has_nul", "_shebang_lang").isNull()
        met = met.observe(drops.observation("contents"), F.count_if(F.col("_known").isNull()).alias("missing_object"),
                          F.count_if(no_language).alias("binary_or_unknown")).where("_known").drop("_known")
    return (met
            .withColumn("programming_language", language_of_text(path_col, "_has_nul", "_shebang_lang"))  # the rest is settled above
            .drop("_has_nul", "_shebang_lang")
            .where(F.col("programming_language").isNotNull()))


def normalise_languages(languages: Iterable[str]) -> list[str]:
    return sorted({x.strip().lower() for x in languages})


def supported_names(df: DataFrame, languages: Iterable[str] = DEFAULT_SUPPORTED, path_col: str = "file_path",
                    name: str = "_by_name") -> DataFrame:
    """The rows that ``classify_changes`` and ``supported_files`` can keep, by their names alone.  ``name``: whether the name
    settles the language, so that only a binary or missing content drops the row; else the content decides the language."""
    by_name = language_by_name(path_col)
    can_be = by_name.isNull() | F.lower(by_name).isin(normalise_languages(languages))
    return df.where(~dropped_by_name(path_col) & can_be).withColumn(name, by_name.isNotNull())


def supported_files(df: DataFrame, languages: Iterable[str] = DEFAULT_SUPPORTED,
                    lang_col: str = "programming_language") -> DataFrame:
    """Keep rows whose language is in the (stripped, lower-cased) list."""
    return df.where(F.lower(F.col(lang_col)).isin(normalise_languages(languages)))
