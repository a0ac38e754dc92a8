"""Small text expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions.dialect import SPACE_CHARS, translate


# Two Unicode noncharacters, which no text interchange may contain.  Should
# they occur all the same, they are read as the replacement character.
MARK, MUTED = "\uFDD0", "\uFDD1"
REPLACEMENT = "\uFFFD"


def java(pattern: str, flags: str = "") -> str:
    return translate(pattern, flags, "java")


def quoted(text: str) -> str:
    """A string literal for an expression text; ``$`` is spelled as an escape
    so that variable substitution finds nothing to replace."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return f"'{escaped}'"


def trim_all(c: Column) -> Column:
    """Strip every kind of white space (Spark's trim strips blanks only)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def lines_of(code: Column) -> Column:
    return F.split(code, "\n", -1)


def line_count(code: Column) -> Column:
    """Number of lines, without building the array of lines."""
    return (F.octet_length(code) - F.octet_length(F.replace(code, F.lit("\n"), F.lit(""))) + 1).cast("int")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def truncate(c: Column, n: int) -> Column:
    """The first ``n`` characters, marked when something was cut off."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("\n...[truncated]"))).otherwise(c)


def contains_any(c: Column, words) -> Column:
    out = None
    for w in words:
        hit = F.contains(c, F.lit(w))
        out = hit if out is None else out | hit
    return out


def fixed(c: Column, digits: int) -> Column:
    """A number as text with ``digits`` decimals and no grouping."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def trimmed_sql(expr: str) -> str:
    return f"btrim({expr}, {quoted(SPACE_CHARS)})"


def mark_first_line() -> str:
    """The file's first line, marked."""
    return f"concat({quoted(MARK)}, substring_index(code, '\\n', 1))"


def mark_lines(predicate: str) -> str:
    """The text with every line marked for which ``predicate`` holds.

    The predicate may use ``line``, ``i`` (from 0) and ``lines``.
    """
    return (
        "element_at(transform(array(split(code, '\\n', -1)), lines -> array_join(transform(lines, "
        f"(line, i) -> CASE WHEN {predicate} THEN concat({quoted(MARK)}, line) ELSE line END), '\\n')), 1)"
    )
