"""Policy rules.

Fixed values: ids, names, patterns, flags, severities, and the word and path
lists of the two procedural rules.
"""

from __future__ import annotations

from codewarden.catalog.model import Check, Rule
from codewarden.functions.text import java, mark_first_line, mark_lines, quoted


DEFAULT_ACTIVE = ("no-hardcoded-secrets", "no-eval", "no-innerHTML", "license-compliance")

# license-compliance
LICENSE_EXTENSIONS = (".ts", ".js", ".tsx", ".jsx", ".py", ".java", ".cs", ".go", ".rs")
LICENSE_SKIPPED_DIRS = ("coverage", "lcov-report", "node_modules", "dist", "build", ".next", "out",
                        "vendor", "__mocks__", "__tests__")
LICENSE_SKIPPED_FILES = r"""\.(test|spec)\.(ts|js|tsx|jsx)$"""
LICENSE_WORDS = r"""(?:MIT|Apache|GPL|BSD|LGPL|MPL|ISC|copyright|SPDX-License-Identifier)"""
LICENSE_HEADER_CHARS = 500

# no-async-without-await
ASYNC_FILES = r"""\.(ts|js|tsx|jsx)$"""
ASYNC_LINE = r"""async\s+function|async\s+\(|async\s+\w+\s*="""
AWAIT_WORD = r"""\bawait\b|Promise"""
ASYNC_FRAME_LINES = 20


def _license_check() -> Check:
    """Source files whose first characters name no license."""
    suffix = " OR ".join(f"endswith(file_path, {quoted(e)})" for e in LICENSE_EXTENSIONS)
    skipped = ", ".join(quoted(d) for d in LICENSE_SKIPPED_DIRS)
    return Check(
        gate=(f"({suffix})"
              f" AND NOT arrays_overlap(split(replace(file_path, '\\\\', '/'), '/'), array({skipped}))"
              f" AND NOT file_path RLIKE {quoted(java(LICENSE_SKIPPED_FILES))}"
              f" AND NOT left(code, {LICENSE_HEADER_CHARS}) RLIKE {quoted(java(LICENSE_WORDS, 'i'))}"),
        marked=mark_first_line(),
        raw_snippet=True,
    )


def _async_check() -> Check:
    """Async lines with no await in the frame that starts with them."""
    return Check(
        gate=f"file_path RLIKE {quoted(java(ASYNC_FILES))}",
        marked=mark_lines(
            f"contains(line, 'async') AND line RLIKE {quoted(java(ASYNC_LINE))} AND NOT exists(slice(lines, i + 1, {ASYNC_FRAME_LINES}),"
            f" x -> x RLIKE {quoted(java(AWAIT_WORD))})"),
    )


def _p(rule_id, title, severity, flags, needs, pattern, description, check=None, linear=None):
    return Rule(
        rule_id=rule_id, title=title, severity=severity, pattern=pattern, flags=flags, needs=needs,
        description=description, category="policy-violation", confidence=1.0, check=check, linear=linear,
    )


POLICY_RULES: tuple[Rule, ...] = (
    _p("no-hardcoded-secrets", "No Hardcoded Secrets", "critical", "gi",
       (("apikey", "api_key", "api-key", "password", "secret", "token", "credential"), (":", "="), ("'", '"', "`")),
       r"""(?:api[_-]?key|password|secret|token|credential)\s*[:=]\s*['"`][A-Za-z0-9_\-!@#$%^&*]{8,}['"`]""",
       "Keys, passwords and tokens do not belong in source code."),
    _p("no-eval", "No eval() Usage", "critical", "g",
       (("eval", "new"), ("eval", "function"), "("),
       r"""\beval\s*\(|new\s+Function\s*\(""",
       "Evaluating text as code is not allowed."),
    _p("no-innerHTML", "No Unsafe innerHTML", "high", "g",
       ("innerhtml",),
       r"""\.innerHTML\s*=\s*(?!['"`]\s*['"`])""",
       "Assigning dynamic markup to an element is not allowed."),
    _p("no-console-log", "No console.log in Production Code", "low", "g",
       ("console.",),
       r"""console\.(log|warn|error|info|debug)\s*\(""",
       "Console output must not ship."),
    _p("license-compliance", "License Header Required", "medium", "", (), None,
       "The file carries no license header.", check=_license_check()),
    _p("no-http-external", "No HTTP for External URLs", "medium", "g",
       ("http://",),
       r"""['"`]http:\/\/(?!localhost|127\.0\.0\.1|0\.0\.0\.0|www\.w3\.org|schemas?\.|xml\.)[^'"`]+['"`]""",
       "Outside addresses must be reached over HTTPS."),
    _p("no-any-typescript", "No TypeScript any Type", "low", "g",
       ("any",),
       r""":\s*any\b|\bas\s+any\b""",
       "The any type switches type checking off."),
    _p("no-async-without-await", "Async Functions Must Use await", "low", "", ("async",), None,
       "This async function seems to await nothing.", check=_async_check()),
    _p("gdpr-personal-data-logging", "GDPR: No Personal Data in Logs", "high", "gi",
       ("console.", ")", ("email", "phone", "ssn", "passport", "dob", "birthdate", "address", "creditcard")),
       r"""console\.[a-z]+\([^)]*(?:email|phone|ssn|passport|dob|birthdate|address|creditcard)[^)]*\)""",
       "Personal data must not reach a log.",
       # The call ends at its first closing bracket, so that part is never given back.
       linear=r"""console\.[a-z]+\((?=[^)]*(?:email|phone|ssn|passport|dob|birthdate|address|creditcard))[^)]*+\)"""),
    _p("no-synchronous-fs", "No Synchronous File Operations", "medium", "g",
       ("fs.", "sync"),
       r"""\bfs\.(readFileSync|writeFileSync|readdirSync|statSync|existsSync|unlinkSync|mkdirSync)\b""",
       "Synchronous file calls block the event loop."),
    _p("no-debugger", "No Debugger Statements", "medium", "gm",
       (("debugger", "breakpoint", "pdb"),),
       r"""^[ \t]*(?:debugger\b[ \t]*;?|breakpoint\s*\(\s*\)|(?:import\s+pdb;\s*)?pdb\.set_trace\s*\(\s*\))""",
       "Debugger stops must not be committed."),
    _p("no-todo-comments", "No Unresolved TODO/FIXME Comments", "low", "g",
       (("todo", "fixme"),),
       r"""(?:\/\/|\/\*+|#)[^\n]*\b(?:TODO|FIXME)\b""",
       "Open notes must be settled or tracked elsewhere before merging."),
    _p("no-sql-injection", "Parameterized Queries Required", "critical", "gi",
       (("query", "exec", "raw", "preparestatement"), ("select", "insert", "update", "delete")),
       r"""\b(?:query|execute|executeQuery|executeUpdate|exec|raw|prepareStatement)\s*\(\s*(?:"[^"\n]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^"\n]*"\s*\+|'[^'\n]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^'\n]*'\s*\+|`[^`\n]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^`\n]*\$\{|f["'][^"'\n]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^"'\n]*\{)""",
       "A statement is concatenated or interpolated where parameters are required."),
    _p("no-weak-crypto", "No Weak Cryptography", "high", "gi",
       (("createhash", "hashlib.", "messagedigest.getinstance"), ("md5", "sha1", "sha-1")),
       r"""(?:(?:createHash|hashlib\.new|MessageDigest\.getInstance)\s*\(\s*['"`](?:md5|sha1|sha-1)['"`]|\bhashlib\.(?:md5|sha1)\s*\()""",
       "MD5 and SHA-1 are broken."),
)
