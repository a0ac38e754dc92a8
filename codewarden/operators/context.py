"""The lines of the function around a finding, cut out in the row of its file.

A file is cut into lines and its declarations are looked for once, whatever the number of its findings, and only if it has
any; a finding then costs the lines around it.  No finding holds the text of its file, and nothing is joined for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions.text import java, lines_of

# Frames and patterns of the context search.
LINES_BEFORE, LINES_AFTER = 80, 150
SHORT_BEFORE, SHORT_AFTER = 10, 20
DECLARATION = (r"^\s*(export\s+)?(default\s+)?(async\s+)?(function[\s*]|class\s+\w|const\s+\w+\s*=\s*(async\s+)?\("
               r"|[a-zA-Z_$][\w$]*\s*\([^)]*\)\s*[:{]|public\s|private\s|protected\s)")
CONTEXT_COLUMNS = ("first_line", "last_line", "context")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though it is used several times."""
    return F.transform(F.array(value), body)[0]


def _file(code: Column) -> Column:
    """The lines of a file, with whether each one begins a declaration."""
    return once(lines_of(code), lambda l: F.struct(
        l.alias("lines"), F.transform(l, lambda x: x.rlike(java(DECLARATION))).alias("declared")))


def _closing(lines: Column, first_at: Column, limit_at: Column, end_at: Column) -> Column:
    """The first line at or after ``end_at`` on which every brace opened since ``first_at`` is closed again, or null."""
    count = lambda l, brace: F.length(l) - F.length(F.replace(l, F.lit(brace), F.lit("")))
    start = F.struct(first_at.alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(None).cast("int").alias("stop"))

    def step(s: Column, l: Column) -> Column:
        braces = F.struct(count(l, "{").alias("up"), count(l, "}").alias("down"))
        return F.when(s["stop"].isNotNull(), s).otherwise(once(braces, lambda c: once(
            F.struct((s["depth"] + c["up"] - c["down"]).alias("depth"), (s["opened"] | (c["up"] > 0)).alias("opened")), lambda n: F.struct(
                (s["at"] + 1).alias("at"), n["depth"].alias("depth"), n["opened"].alias("opened"),
                F.when(n["opened"] & (n["depth"] <= 0) & (s["at"] >= end_at), s["at"]).alias("stop")))))

    return F.aggregate(F.slice(lines, first_at + 1, F.greatest(limit_at - first_at + 1, F.lit(0))), start, step, lambda s: s["stop"])


def _frame(f: Column, start_line: Column, end_line: Column) -> Column:
    """``first_line``, ``last_line`` (from 1) and ``context`` of a finding in ``f``, such a file."""
    lines, last = f["lines"], F.size(f["lines"]) - 1
    place = F.struct(F.greatest(F.lit(0), start_line - 1).alias("begin"), F.least(last, end_line - 1).alias("end"),
                     F.greatest(F.lit(0), start_line - 1 - LINES_BEFORE).alias("from"))

    def of_place(p: Column) -> Column:
        above = F.slice(f["declared"], p["from"] + 1, p["begin"] - p["from"] + 1)
        declared = F.array_max(F.transform(above, lambda d, i: F.when(d, p["from"] + i)))
        first = F.coalesce(declared, F.greatest(F.lit(0), p["begin"] - SHORT_BEFORE))
        return once(first, lambda a: once(
            F.coalesce(_closing(lines, a, F.least(last, p["end"] + LINES_AFTER), p["end"]), F.least(last, p["end"] + SHORT_AFTER)),
            lambda z: F.struct((a + 1).alias("first_line"), (z + 1).alias("last_line"),
                               F.array_join(F.slice(lines, a + 1, F.greatest(z - a + 1, F.lit(0))), "\n").alias("context"))))

    return once(place, of_place)


def framed(code: Column, found: Column, start: Callable[[Column], Column], end: Callable[[Column], Column]) -> Column:
    """``found``, an array in the row of a file, as structs of ``x``, the element, and its ``frame``; null if it is empty."""
    return once(found, lambda all_: F.when(F.size(all_) > 0, once(_file(code), lambda f: F.transform(
        all_, lambda x: F.struct(x.alias("x"), _frame(f, start(x), end(x)).alias("frame"))))))


def add_context(rows: DataFrame) -> DataFrame:
    """The context of rows that are the one finding of their file and hold its ``code``, which they lose."""
    one = framed(F.col("code"), F.array(F.struct("start_line", "end_line")), lambda x: x["start_line"], lambda x: x["end_line"])
    return rows.withColumn("_frame", one[0]["frame"]).select(*[c for c in rows.columns if c != "code"], "_frame.*")


def finding_context(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Lines of the function around each finding (``first_line``..``last_line``, from 1).

    Findings of a scan ``with_context`` have them already.  For a choice of other findings, those of a file meet its text
    once, by path.
    """
    if files is None:
        return findings
    wanted = [c for c in findings.columns if c not in CONTEXT_COLUMNS]
    of_file = findings.groupBy("file_path").agg(F.collect_list(F.struct(*wanted)).alias("found"))
    texts = files.filter(F.col("code").isNotNull()).select("file_path", "code").join(of_file, "file_path")
    cut = framed(F.col("code"), F.col("found"), lambda x: x["start_line"], lambda x: x["end_line"])
    return texts.select(F.explode(cut).alias("e")).select("e.x.*", "e.frame.*")
