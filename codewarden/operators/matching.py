"""Find every match of every rule, with its line.

A pattern is run once per file, in a scan with many rules only on the lines
that a match can reach (``places``).  It does not return positions; it puts a
marker in front of each match.  The text is then cut into lines, and only the
lines that hold a marker go on.  Line number, string-literal test and snippet
follow from such a line alone, so the work stays proportional to the text, and
no file is ever joined with a rule or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.catalog.model import Rule
from codewarden.functions.paths import basename, rule_extension
from codewarden.functions.text import MARK, MUTED, REPLACEMENT, contains_any, java, quoted, trim_all
from codewarden.operators.context import CONTEXT_COLUMNS, framed
from codewarden.operators.literals import open_gates
from codewarden.operators.places import reach

# Up to so many literals are looked for one by one, in the row; more of them together, in Arrow batches.
FEW_LITERALS = 20


def cleaned(code: Column, marked: Column) -> Column:
    """The text without markers of its own."""
    return F.when(marked, F.translate(code, MARK + MUTED, REPLACEMENT * 2)).otherwise(code)


def prepare(files: DataFrame, *extra: str, opened: Callable[..., Column] | None = None, gates: int = 0) -> DataFrame:
    """Files plus the helper columns the rules look at: the lower-cased text, or what is ``opened`` of so many gates.

    The gate after them is that of texts that hold a marker.
    """
    code = F.col("code")
    known = files.filter(code.isNotNull()).select(
        "file_path", *extra, "code",
        rule_extension(F.col("file_path")).alias("ext"),
        F.lower(basename(F.col("file_path"))).alias("base"),
    )
    if opened is None:
        return known.withColumns({"code": cleaned(code, contains_any(code, (MARK, MUTED))), "lowered": F.lower(code)})
    return known.withColumn("may_match", opened("code", "ext", "base")).withColumn(
        "code", cleaned(code, F.array_contains("may_match.gate", gates)))


def applies(rule: Rule) -> str:
    """The rule's file types, as a predicate."""
    if rule.file_types is None:
        return "true"
    dotted = [quoted(t) for t in rule.file_types if t.startswith(".")]
    names = [quoted(t) for t in rule.file_types if not t.startswith(".")]
    hit = f"ext IN ({', '.join(dotted)})"
    return f"({hit} OR base IN ({', '.join(names)}))" if names else hit


def words_of(need) -> tuple[str, ...]:
    return (need,) if isinstance(need, str) else need


def literals(rules: Sequence[Rule]) -> set[str]:
    return {w for r in rules for need in r.needs for w in words_of(need)}


def may_match(rule: Rule) -> str:
    """Cheap test: file type first, then the literals every match contains."""
    tests = [applies(rule)]
    tests += ["(" + " OR ".join(f"contains(lowered, {quoted(w)})" for w in words_of(need)) + ")" for need in rule.needs]
    return " AND ".join(tests)


def marked(ordinal: int, rule: Rule, gate: str, part: str = "code", above: str = "0") -> str:
    """The rule's ordinal, and a part of the text with its matches marked and the number of lines above it, or null."""
    if rule.check is not None:
        gate, text = f"{gate} AND {rule.check.gate}", rule.check.marked
    else:
        pattern = java(rule.linear or rule.pattern, rule.flags)
        text = f"regexp_replace({part}, {quoted(pattern)}, {quoted(MARK + '$0')})"
    return f"CASE WHEN {gate} THEN struct({ordinal} AS rule_ord, {above} AS above, {text} AS marked) END"


def picked(position: str, values: Sequence[str]) -> str:
    """The value at a position, of which only that one is worked out; ten at a time are passed over."""
    tens = [values[at:at + 10] for at in range(0, len(values), 10)]
    inner = [" ".join(f"WHEN {10 * k + i} THEN {v}" for i, v in enumerate(ten)) for k, ten in enumerate(tens)]
    return "CASE " + " ".join(f"WHEN {position} < {10 * (k + 1)} THEN CASE {position} {ten} END" for k, ten in enumerate(inner)) + " END"


def mute_in_strings(line: Column) -> Column:
    """Mute the markers that stand inside a string literal on their line.

    A backslash and the character after it do not count.  What is left of the
    line is its quotes and markers; between an odd quote and the next one of
    the same kind every marker is muted.  What stands behind the last marker
    changes none.
    """
    behind = F.substring_index(line, MARK, -1)
    kept = F.regexp_replace(F.left(line, F.length(line) - F.length(behind)), rf"\\({MARK}?)[^{MARK}]", "$1")
    kept = F.regexp_replace(kept, f"[^'\"`{MARK}]+", "")
    for quote in ("'", '"', "`"):
        pieces = F.transform(
            F.split(kept, quote, -1),
            lambda piece, i: F.when(i % 2 == 1, F.translate(piece, MARK, MUTED)).otherwise(piece),
        )
        kept = F.array_join(pieces, quote)
    return kept


def occurrences(text: Column, mark: str) -> Column:
    width = len(mark.encode())
    bare = F.octet_length(F.replace(text, F.lit(mark), F.lit("")))
    return ((F.octet_length(text) - bare) / width).cast("int")


def rule_lines(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = (), context: bool = False) -> DataFrame:
    """Lines on which a rule matches outside of strings, and how often.

    Columns: file_path, rule_ord (position in ``rules``), start_line, n_matches,
    snippet, the columns of the files named in ``keep``, and with ``context``
    the lines around each, cut out in the row of the file.
    """
    if not rules:
        none = [F.lit(0).alias("first_line"), F.lit(0).alias("last_line"), F.lit("").alias("context")] if context else []
        return files.limit(0).select("file_path", F.lit(0).alias("rule_ord"), F.lit(0).alias("start_line"),
                                     F.lit(0).alias("n_matches"), F.lit("").alias("snippet"), *keep, *none)
    # One expression text for all rules: built column by column it takes the
    # driver seconds.
    many = len(literals(rules)) > FEW_LITERALS
    if many:
        # only of the open gates, not of all of them in turn
        values = [marked(i, r, "true", "coalesce(cast(p.part as string), code)", "p.above") for i, r in enumerate(rules)]
        hits = F.expr(f"transform(filter(may_match, p -> p.gate < {len(rules)}), p -> {picked('p.gate', values)})")
        opened = open_gates([*((r.file_types, tuple(words_of(need) for need in r.needs)) for r in rules), (None, ((MARK, MUTED),))],
                            [*(None if r.check else reach(r.linear or r.pattern, r.flags) for r in rules), None], len(rules))
        ready = prepare(files, *keep, opened=opened, gates=len(rules))
    else:
        hits = F.expr("array(" + ", ".join(marked(i, r, may_match(r)) for i, r in enumerate(rules)) + ")")
        ready = prepare(files, *keep)
    found = F.transform(
        F.filter(hits, lambda h: h.isNotNull() & F.contains(h["marked"], F.lit(MARK))),
        # of the lines without a mark only nulls are made
        lambda h: F.struct(h["rule_ord"].alias("rule_ord"), F.filter(
            F.transform(F.split(h["marked"], "\n", -1), lambda x, i: F.when(
                F.contains(x, F.lit(MARK)), F.struct((h["above"] + i).alias("pos"), x.alias("line")))),
            lambda x: x.isNotNull()).alias("lines")))
    # The array goes straight into explode: as a named column it could be
    # evaluated a second time by a filter that the optimizer derives from it.
    # The lambda also keeps this one wide expression out of code generation,
    # where it would outgrow the size limit of a method.
    # Only marked lines leave it, whatever the size of the file.
    if context:
        flat = F.flatten(F.transform(found, lambda h: F.transform(h["lines"], lambda x: F.struct(
            h["rule_ord"].alias("rule_ord"), x["pos"].alias("pos"), x["line"].alias("line")))))
        cut = framed(F.col("code"), flat, lambda x: x["pos"] + 1, lambda x: x["pos"] + 1)
        per_line = (ready.select("file_path", *keep, F.explode(cut).alias("marked"))
                    .select("file_path", *keep, "marked.x.rule_ord", "marked.x.pos", "marked.x.line", "marked.frame.*"))
        keep = (*keep, *CONTEXT_COLUMNS)
    else:
        per_line = (ready.select("file_path", *keep, F.explode(found).alias("hit"))
                    .select("file_path", *keep, "hit.rule_ord", F.explode("hit.lines").alias("marked"))
                    .select("file_path", *keep, "rule_ord", "marked.pos", "marked.line"))
    line, rule = F.col("line"), F.col("rule_ord")
    everywhere = [i for i, r in enumerate(rules) if r.in_string]
    untrimmed = [i for i, r in enumerate(rules) if r.check is not None and r.check.raw_snippet]
    count = occurrences(mute_in_strings(line), MARK)
    if everywhere:
        count = F.when(rule.isin(*everywhere), occurrences(line, MARK)).otherwise(count)
    snippet = F.replace(line, F.lit(MARK), F.lit(""))
    trimmed = trim_all(snippet)
    if untrimmed:
        trimmed = F.when(rule.isin(*untrimmed), snippet).otherwise(trimmed)
    # Matches are counted in a generator, below which the filter cannot move: it would count them again.
    return per_line.select(
        "file_path", "rule_ord", (F.col("pos") + 1).alias("start_line"),
        F.explode(F.array(count)).alias("n_matches"), trimmed.alias("snippet"), *keep,
    ).filter(F.col("n_matches") > 0)


def find_all(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = (), context: bool = False) -> DataFrame:
    """One row per match; ``match_ord`` numbers the matches of a line from 0."""
    return rule_lines(files, rules, keep, context).select(
        "file_path", "rule_ord", "start_line",
        F.explode(F.sequence(F.lit(0), F.col("n_matches") - 1)).alias("match_ord"),
        "snippet", *keep, *(CONTEXT_COLUMNS if context else ()),
    )
