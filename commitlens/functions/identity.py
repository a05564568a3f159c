"""Author and repository identity, path parts (F1-F6).  All native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GITHUB_PREFIX = "https://github.com/"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Trim all leading/trailing whitespace (like Python's ``str.strip()``)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def author_name(raw: str | Column) -> Column:
    """Text before the first ``<``, trimmed; the whole text when there is no ``<``."""
    r = _col(raw)
    pos = F.instr(r, "<")
    return F.when(pos > 0, strip_ws(r.substr(F.lit(1), pos - 1))).otherwise(strip_ws(r))


def author_email(raw: str | Column) -> Column:
    """From after the first ``<`` up to, not including, the last character; null without ``<``."""
    r = _col(raw)
    pos = F.instr(r, "<")
    return F.when(pos > 0, r.substr(pos + 1, F.length(r) - pos - 1))


def repo_url_from_name(name: str | Column) -> Column:
    """``owner/repo`` -> ``https://github.com/owner/repo``; full URLs pass through."""
    n = _col(name)
    return F.when(n.startswith("https://"), n).otherwise(F.concat(F.lit(GITHUB_PREFIX), n))


def repo_full_name(url_or_name: str | Column) -> Column:
    """Last two ``/`` parts of a URL or name (``owner/repo``)."""
    parts = F.split(_col(url_or_name), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, -2, 2))).otherwise(_col(url_or_name))


def repo_slug(url_or_name: str | Column) -> Column:
    """Folder-safe key: ``owner_repo`` (``/`` replaced by ``_``)."""
    return F.regexp_replace(repo_full_name(url_or_name), "/", "_")


def repo_identity(origin_url: str | Column, path: str | Column) -> Column:
    """Configured origin URL, else the last part of a local path (``/`` or ``\\\\``)."""
    return F.coalesce(_col(origin_url), F.regexp_extract(_col(path), r"([^/\\]*)$", 1))


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem(path: str | Column) -> Column:
    """Part of the base name before the first dot."""
    return F.substring_index(base_name(path), ".", 1)


def suffix(path: str | Column) -> Column:
    """Part of the base name after the last dot (the whole name when there is no dot)."""
    return F.substring_index(base_name(path), ".", -1)
