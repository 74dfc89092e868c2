"""Column expressions for lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered_lines(text: Column) -> Column:
    """``posexplode`` of the lines of ``text`` split at newline; positions count from 0."""
    return F.posexplode(F.split(text, "\n"))


def folded_line(line: Column) -> Column:
    """A line without letter case, amount of white space and the digits of its numbers."""
    spaces = F.regexp_replace(F.lower(line), r"(?U)\s+", " ")
    return F.regexp_replace(F.trim(spaces), r"(?U)\d+", "0")
