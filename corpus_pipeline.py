"""The corpus pipeline: documents -> identified -> distinct -> near-distinct -> mixed -> encoded.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

1. language_id: rows whose language is not accepted go (no letters, or a score under the calibrated threshold).
2. exact_dedup: one row of each group of equal texts stays.
3. simhash_near_dedup: one row of each component of near fingerprints stays (the smallest doc_id).
4. mix_sources: rows are taken to the sources' target weights, each as often as the mix says (up to three times, or not at all).
5. sentencepiece: token ids of every row, and the CRC of what they decode to.

Stages 1 and 5 cannot be said in SQL (a trained model; a tokenizer), so ORACLE_SQL is None; the tests run the
stages against brute-force versions.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from commitlens.llm import exact_dedup, langid, mixing, sentencepiece, simhash  # noqa: E402
from commitlens.llm.common import documents, materialize  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_and_decode(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
