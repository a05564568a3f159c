"""Line splitting with the semantics of Python's ``str.splitlines``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of Python's str.splitlines
# \r\n, \n, \r, \v (0x0b), \f (0x0c), 0x1c, 0x1d, 0x1e, 0x85, U+2028, U+2029
LINE_BREAK_REGEX = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def split_lines(text: str | Column) -> Column:
    """Array of lines; a trailing line break does not open an empty last line; '' -> []."""
    parts = F.split(_col(text), LINE_BREAK_REGEX, -1)
    return F.when(F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: str | Column) -> Column:
    parts = F.split(_col(text), LINE_BREAK_REGEX, -1)
    return (F.size(parts) - F.when(F.element_at(parts, -1) == F.lit(""), 1).otherwise(0)).cast("int")
