"""Path expressions.

The data model has three notions of an extension; each is used where the
results depend on it, so they stay apart here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by base name and by extension.
BASENAME_LANGUAGE = {"Dockerfile": "Dockerfile", "Makefile": "Makefile", "Jenkinsfile": "Groovy"}
EXTENSION_LANGUAGE = {
    "ts": "TypeScript", "tsx": "TypeScript/JSX", "js": "JavaScript", "jsx": "JavaScript/JSX",
    "py": "Python", "java": "Java", "cs": "C#", "cpp": "C++", "c": "C", "go": "Go",
    "rs": "Rust", "rb": "Ruby", "php": "PHP", "swift": "Swift", "kt": "Kotlin",
    "sh": "Shell", "bash": "Bash", "ps1": "PowerShell", "sql": "SQL",
    "html": "HTML", "css": "CSS", "scss": "SCSS", "json": "JSON", "yaml": "YAML", "yml": "YAML",
    "md": "Markdown", "xml": "XML", "tf": "Terraform", "hcl": "HCL",
}

# What a project scan reads.
SCANNABLE_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".cs", ".cpp", ".c",
    ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".sh", ".ps1",
    ".html", ".vue", ".svelte",
    ".mjs", ".cjs", ".cc", ".cxx", ".h", ".hpp", ".phtml", ".rake", ".kts",
    ".scala", ".dart", ".bash",
    ".tf", ".hcl", ".yaml", ".yml", ".json",
)
SCANNABLE_BASENAMES = ("Dockerfile", "Makefile", "Jenkinsfile")
ALLOWED_HIDDEN = (".github", ".gitlab-ci.yml", ".circleci")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def rule_extension(path: Column) -> Column:
    """From the last dot of the base name on, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)\z", 1))


def file_extension(name: Column) -> Column:
    """Like ``rule_extension``, but a leading dot does not start an extension."""
    return F.lower(F.regexp_extract(name, r"[^./\\][^/\\]*?(\.[^./\\]*)\z", 1))


def last_dot_part(path: Column) -> Column:
    """Whatever follows the last dot of the whole path."""
    return F.substring_index(path, ".", -1)


def detect_language(path: Column) -> Column:
    base = basename(path)
    ext = F.lower(F.substring_index(base, ".", -1))
    return F.coalesce(
        F.try_element_at(_lookup(BASENAME_LANGUAGE), base),
        F.try_element_at(_lookup(EXTENSION_LANGUAGE), ext),
        F.when(ext == "", F.lit("Unknown")).otherwise(F.upper(ext)),
    )


def matches_name(component: Column, patterns) -> Column:
    """One path component against plain names and ``*`` patterns."""
    names = [p for p in patterns if "*" not in p]
    globs = [p for p in patterns if "*" in p]
    out = component.isin(*names) if names else F.lit(False)
    for g in globs:
        body = ".*".join(re.escape(part) for part in g.split("*"))
        out = out | component.rlike(r"\A" + body + r"\z")
    return out


def excluded(rel_path: Column, patterns) -> Column:
    """True when any component of the path is excluded or hidden."""

    def drop(c: Column) -> Column:
        hidden = c.startswith(".") & ~c.startswith(".env") & ~c.isin(*ALLOWED_HIDDEN)
        return matches_name(c, patterns) | hidden

    return F.exists(F.split(rel_path, "/"), drop)


def scannable(rel_path: Column) -> Column:
    base = basename(rel_path)
    ext = file_extension(base)
    return ext.isin(*SCANNABLE_EXTENSIONS) | ((ext == "") & base.isin(*SCANNABLE_BASENAMES))


def normalize(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and doubled slashes; the root is ''."""

    def step(acc: Column, part: Column) -> Column:
        return (F.when((part == "") | (part == "."), acc)
                .when(part == "..", F.regexp_replace(acc, r"/[^/]*\z", ""))
                .otherwise(F.concat(acc, F.lit("/"), part)))

    return F.aggregate(F.split(path, "/"), F.lit(""), step)


def resolve_against(root: Column, target: Column) -> Column:
    return normalize(F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", root, target)))


def is_inside(root: Column, absolute: Column) -> Column:
    """True for the root itself and for anything below it.

    A first component below the root that starts with two dots counts as
    outside, whatever follows the dots.
    """
    base = normalize(root)
    below = absolute.startswith(F.concat(base, F.lit("/")))
    rest = F.substring(absolute, F.length(base) + 2, F.length(absolute))
    return (F.length(root) > 0) & ((absolute == base) | (below & ~rest.startswith("..")))
