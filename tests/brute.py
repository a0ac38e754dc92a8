"""Plain definitions of the operators, one file at a time, to compare with."""

from __future__ import annotations

import math
import re

# White space as ECMAScript lists it.
SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                          0x205F, 0x3000, 0xFEFF]))


def compiled(pattern: str, flags: str) -> re.Pattern:
    """An ECMAScript pattern for Python."""
    space = "".join(f"\\u{ord(c):04x}" for c in SPACE)
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s":
            out.append(space if in_class else f"[{space}]")
        elif two == "\\S":
            out.append(r"\S" if in_class else f"[^{space}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            c = two[0]
            in_class = c == "[" or (in_class and c != "]")
            if c == "." and not in_class:
                c = "[^\\n\\r\\u2028\\u2029]"
            if c == "$" and not in_class and "m" not in flags:
                c = r"\Z"
            out.append(c)
            i += 1
            continue
        i += 2
    mode = re.ASCII | (re.IGNORECASE if "i" in flags else 0) | (re.MULTILINE if "m" in flags else 0)
    return re.compile("".join(out), mode)


def in_string(code: str, at: int) -> bool:
    head = code[code.rfind("\n", 0, at) + 1 : at]
    head = re.sub(r"\\.", "", head, flags=re.S)
    return any(head.count(q) % 2 for q in "'\"`")


def applies(rule, path: str) -> bool:
    base = re.split(r"[\\/]", path)[-1].lower()
    ext = base[base.rfind("."):] if "." in base else ""
    return rule.file_types is None or ext in rule.file_types or base in rule.file_types


def matches(rule, path: str, code: str) -> list[tuple[str, int, str]]:
    """(rule, line, snippet) of every match."""
    if not applies(rule, path):
        return []
    lines, out = code.split("\n"), []
    for m in compiled(rule.pattern, rule.flags).finditer(code):
        if rule.in_string or not in_string(code, m.start()):
            line = code.count("\n", 0, m.start()) + 1
            out.append((rule.rule_id, line, lines[line - 1].strip(SPACE)))
    return out


def entropy(tokens: list[str]) -> float:
    n = len(tokens)
    counts = [tokens.count(t) for t in set(tokens)]
    return -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0


def cv(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) / mean if mean > 0 else 1.0


def clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def signal_scores(code: str) -> dict[str, float]:
    from codewarden.catalog import authorship as A

    lines = code.split("\n")
    wide, narrow = (compiled(p, "") for p in (A.COMMENT_LINE_WIDE, A.COMMENT_LINE))
    own = [line for line in lines if not wide.search(line) and len(line.strip(SPACE)) > 5]
    score = 0.0
    if len(own) >= 5:
        trimmed = [line.strip(SPACE) for line in own]
        repeated = sum(1 for line in trimmed if trimmed.count(line) >= 2)
        values = []
        for line in own:
            tokens = [t for t in re.split(r"[\s(){}\[\],;:=+\-*/<>!&|.'\"\\@]+", line) if len(t) >= 2]
            if len(set(tokens)) > 1:
                values.append(entropy(tokens))
        even = clamp((0.40 - cv(values)) / 0.30) if len(values) >= 3 else 0.0
        score = 0.60 * min(repeated / len(own) / 0.20, 1) + 0.40 * even
    ids = re.findall(A.IDENTIFIER, code, re.ASCII)
    generic = sum(1 for w in ids if w.lower() in A.GENERIC_WORDS)
    lengths = [len(line) for line in lines if line.strip(SPACE)]

    def any_of(patterns):
        return sum(1 for p, f in patterns if compiled(p, f).search(code))

    return {
        "entropy_burstiness": score,
        "comment_patterns": min(any_of(A.COMMENT_PATTERNS) / 2, 1),
        "generic_identifier_score": clamp((generic / len(ids) - 0.10) / 0.20) if len(ids) >= 10 else 0.0,
        "boilerplate": min(any_of(A.BOILERPLATE_PATTERNS) / 2, 1),
        "structure_uniformity": min(sum(len(list(compiled(p, f).finditer(code))) for p, f in A.STRUCTURE_PATTERNS) / 3, 1),
        "comment_density": min(sum(1 for line in lines if narrow.search(line)) / len(lines) / 0.40, 1),
        "line_length_uniformity": clamp((0.65 - cv(lengths)) / 0.35) if len(lengths) >= 10 else 0.0,
    }
