"""Imported and declared names per file, by language (the reference's capture rules, §2.10).

``add_symbol_columns`` evaluates the per-language work in guarded projection
stages: a file only runs its own language's expressions, and every scrubbed /
blanked view of the text is computed once and reused by the rules that need it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import java, javascript, python
from .common import empty

KINDS = ("imports", "variables")
LANGUAGES = ("python", "java", "javascript")


def check_kinds(kinds: Sequence[str]) -> list[str]:
    """Validate requested kinds; unknown ones raise ``ValueError`` naming the valid kinds."""
    out = []
    for k in kinds:
        if k not in KINDS:
            raise ValueError(f"unknown symbol kind {k!r}; known kinds: {', '.join(KINDS)}")
        out.append(k)
    return out


def add_symbol_columns(df: DataFrame, lang_col: str = "programming_language", text_col: str = "text",
                       kinds: Sequence[str] = KINDS) -> DataFrame:
    """Add array<string> columns named after ``kinds`` (sets; empty for other languages)."""
    kinds = check_kinds(kinds)
    lang = F.lower(F.col(lang_col))
    text = F.col(text_col)
    stage1 = df.select(
        "*",
        F.when(lang == "python", python.scrub(text)).alias("_py"),
        F.when(lang == "java", java.scrub(text)).alias("_jv"),
        F.when(lang == "javascript", javascript.scrub_comments(text)).alias("_js"),
    )
    stage2 = stage1.select(
        "*",
        python.open_params(F.col("_py")).alias("_pyo"),
        java.declarations_view(F.col("_jv")).alias("_jvd"),
        javascript.blank_strings(F.col("_js")).alias("_jsn"),
    )
    stage3 = stage2.select("*", java.type_bodies_view(F.col("_jvd")).alias("_jvt"), python.close_params(F.col("_pyo")).alias("_pyb"),
                           javascript.shared_names(F.col("_js"), F.col("_jsn")).alias("_jss"))
    rules = {
        "imports": F.coalesce(python.imports(F.col("_py")), java.imports(F.col("_jv")),
                              javascript.imports(F.col("_js"), F.col("_jsn"), F.col("_jss")), empty()),
        "variables": F.coalesce(python.variables(F.col("_py"), F.col("_pyo"), F.col("_pyb")),
                                java.variables(F.col("_jv"), F.col("_jvd"), F.col("_jvt")),
                                javascript.variables(F.col("_js"), F.col("_jsn"), F.col("_jss")), empty()),
    }
    out = stage3.select("*", *[rules[k].alias(k) for k in kinds])
    return out.drop("_py", "_jv", "_js", "_pyo", "_pyb", "_jvd", "_jsn", "_jvt", "_jss")
