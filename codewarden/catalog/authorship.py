"""Signals of machine authorship.

Fixed values: patterns, flags, the word set, weights, thresholds, offsets and
the constants of the scoring formulas.
"""

from __future__ import annotations

# (pattern, flags): any match counts once
COMMENT_PATTERNS = (
    (r"""\/\/\s*This (function|method|class|component|service|module)\s+(is|does|handles|provides|returns|creates|manages|implements)\b""", "i"),
    (r"""\/\/\s*A (simple|basic|custom|helper|utility)\s+(function|method|class|component)\s+(that|to|for|which)\b""", "i"),
    (r"""\*\s+@param\s+\{[\w|, ]+\}\s+\w+\s+-\s+The\s+""", "i"),
    (r"""\/\/\s*(Initialize|Create|Define|Set up|Configure)\s+the\s+\w+""", "i"),
    (r"""\/\/\s*(Return|Returns)\s+the\s+\w+""", "i"),
    (r"""\/\/\s*Helper (function|method)\s+to\s+\w+""", "i"),
    (r"""\/\/\s*(TODO|FIXME|NOTE|HACK):\s*$""", "m"),
    (r"""\/\/\s*(Handle|Process|Check|Get|Set|Update|Delete|Create|Build|Render|Fetch|Load|Save|Convert|Parse|Validate|Format)\s+\w""", "i"),
    (r"""\/\/\s*We (need to|can|should|will|use|check|handle)\s+\w""", "i"),
    (r"""\/\/\s*(Step \d|[1-9]\.|First[,:]|Second[,:]|Third[,:]|Then[,:]|Finally[,:]|Next[,:])""", "i"),
    (r"""\/\/\s*The following\s+(code|function|class|method|block|snippet|example|implementation)\b""", "i"),
    (r"""\*\s+@(description|summary|example)\s+\w.{10,}""", "i"),
)
COMMENT_NEEDS = ("//", "//", "@param", "//", "//", "//", "//", "//", "//", "//", "//", "@")
# How every match of a pattern that needs the literal begins, whatever its case, in UTF-8: an address goes on in other ways.
OPENINGS = {"//": r"//[\s\x80-\xff]*(?:this |a |initialize|create|define|set|configure|return|helper |todo|fixme|note|hack|handle|process|check"
                  r"|get|update|delete|build|render|fetch|load|save|convert|parse|validate|format|we |step |[1-9]\.|first|second|third|then"
                  r"|finally|next|the )"}

BOILERPLATE_PATTERNS = (
    (r"""export\s+default\s+function\s+\w+\([^)]*\)\s*\{[\s\S]{0,200}return\s*\([\s\S]{0,500}\);\s*\}""", ""),
    (r"""const\s+\w+\s*=\s*async\s*\([^)]*\)\s*=>\s*\{\s*try\s*\{""", "i"),
    (r"""interface\s+\w+(Props|State|Config|Options|Data|Request|Response)\s*\{[\s\S]{0,500}\}""", ""),
    (r"""console\.(log|error|warn)\s*\(\s*[`'"][\w\s]+(successfully|failed|error|complete|done|created|updated|deleted)""", "i"),
    (r"""\?\.\w+\?\.\w+\?\.\w+""", ""),
    (r"""if\s*\(\s*!\w+\s*\)\s*\{\s*(throw\s+new\s+\w*Error|return\s+(null|undefined|false|\{))""", "i"),
)
BOILERPLATE_NEEDS = ("export", "=>", "interface", "console.", "?.", "!")

# counted: every match
STRUCTURE_PATTERNS = (
    (r"""catch\s*\([^)]*\)\s*\{\s*console\.(error|log|warn)\([^)]*\);\s*(throw\s+\w+;)?\s*\}""", "g"),
    (r"""async\s+(function\s+\w+|\w+\s*=>|\(\s*\)\s*=>)[^{]*\{\s*try\s*\{""", "g"),
    (r"""\/\*\*\s*\n\s*\*\s*@(description|summary)[^*]*\n\s*\*\s*@param[^*]*\n\s*\*\s*@returns""", "g"),
)
STRUCTURE_NEEDS = ("console.", "async", "@returns")

IDENTIFIER = r"""\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b"""
GENERIC_WORDS = (
    "result", "response", "data", "error", "config", "options", "params", "payload",
    "output", "input", "value", "item", "items", "list", "arr", "obj", "ctx",
    "callback", "handler", "helper", "util", "utils", "service", "manager",
    "provider", "factory", "builder", "processor", "validator", "formatter",
    "parsed", "converted", "transformed", "normalized", "formatted", "filtered",
    "mapped", "reduced", "sorted", "updated", "created", "deleted", "fetched",
)

# Comment lines: the repetition signal also skips markup comments.
COMMENT_LINE_WIDE = r"""^\s*(\/\/|\/\*|\*|#|<!--)"""
COMMENT_LINE = r"""^\s*(\/\/|\/\*|\*|#)"""
TOKEN_SEPARATORS = r"""[\s(){}[\],;:=+\-*/<>!&|.'"\\@]+"""

# type -> weight, in reporting order
SIGNAL_WEIGHTS = (
    ("entropy-burstiness", 0.25),
    ("comment-patterns", 0.20),
    ("generic-identifiers", 0.15),
    ("boilerplate", 0.15),
    ("structure-uniformity", 0.15),
    ("comment-density", 0.10),
    ("line-length-uniformity", 0.10),
)

LANGUAGE_OFFSETS = {
    "ts": -0.02, "tsx": -0.02, "js": -0.01, "jsx": -0.01, "py": 0.02,
    "sh": 0.05, "bash": 0.05, "ps1": 0.04, "md": 0.03,
}

THRESHOLD_DETECTED = 0.72
THRESHOLD_UNCERTAIN = 0.45
INTERVAL_Z = 1.28
