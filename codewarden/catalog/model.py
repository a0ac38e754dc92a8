"""Rule records shared by all catalogs."""

from __future__ import annotations

from dataclasses import dataclass

# Order of the analyzers in every stable sort of findings.
ANALYZER_ORDER = {"ai-generated": 0, "vulnerability": 1, "malicious": 2, "policy-violation": 3}

# A group of literals of which at least one must occur (lower-cased).
Needs = tuple["str | tuple[str, ...]", ...]


@dataclass(frozen=True)
class Check:
    """A procedural rule as two SQL expressions over one file.

    Both may use ``code``, ``lowered``, ``file_path``, ``ext`` and ``base``.
    ``gate`` says whether the file is looked at; ``marked`` gives its lines
    with a marker in front of each violation (``functions.text`` has helpers).
    """

    gate: str
    marked: str
    raw_snippet: bool = False


@dataclass(frozen=True)
class Rule:
    """One find-all rule.

    ``pattern`` is ECMAScript text.  ``needs`` lists literals that every match
    contains: a string, or a tuple of which one must occur.  They are looked
    for first, because a substring search is far cheaper than a pattern.
    ``linear`` replaces the Java pattern where an equivalent form avoids
    super-linear work.  A rule with a ``check`` has no pattern.
    """

    rule_id: str
    title: str
    severity: str
    pattern: str | None
    flags: str = "g"
    category: str = "vulnerability"
    cwe: str | None = None
    file_types: tuple[str, ...] | None = None
    needs: Needs = ()
    in_string: bool = False
    confidence: float = 0.85
    description: str = ""
    recommendation: str | None = None
    sub_category: str | None = None
    linear: str | None = None
    check: Check | None = None
