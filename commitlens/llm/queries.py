"""Imports every operator module, so that its query (and SQL) is registered."""

from . import alignment, ann, exact_dedup, langid, lexical, lm_score, mixing, ngram_join, sentencepiece, sharding, simhash, token_rollups, warc  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
