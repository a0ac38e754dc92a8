"""Pattern text for Java (Spark) and RE2 (the checking engine).

Catalog patterns are written in ECMAScript syntax, because that is the
meaning the results must have.  Three engines disagree on a handful of
escapes; ``translate`` spells those out so that both other engines read a
pattern the ECMAScript way:

* ``\\s`` covers the Unicode spaces, ``.`` stops at four line terminators;
* ``\\b`` and ``\\w`` are ASCII only (Java 17's ``\\b`` is Unicode-aware);
* ``$`` without the ``m`` flag is the very end of the input;
* a bare ``[`` inside a class is a literal.
"""

from __future__ import annotations

# White space as ECMAScript defines it, as a class body and as characters.
SPACE_CLASS = (
    r"\x09-\x0D\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)
_LINE_END = r"\n\r\x{2028}\x{2029}"
_NOT_LINE_END = f"[^{_LINE_END}]"
_ANY = r"[\x{0}-\x{10FFFF}]"
_FULL_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _class_end(p: str, i: int) -> int:
    """Index just past the ``]`` that closes the class opened at ``p[i]``."""
    j = i + 1
    while p[j] != "]":
        j += 2 if p[j] == "\\" else 1
    return j + 1


def _branches(p: str, i: int) -> list[int]:
    """Start index of every alternative of the group whose body starts at ``i``."""
    starts, depth, j = [i], 0, i
    while j < len(p) and not (p[j] == ")" and depth == 0):
        if p[j] == "\\":
            j += 2
            continue
        if p[j] == "[":
            j = _class_end(p, j)
            continue
        depth += {"(": 1, ")": -1}.get(p[j], 0)
        if p[j] == "|" and depth == 0:
            starts.append(j + 1)
        j += 1
    return starts


def _begins_with_word(p: str, i: int) -> bool:
    """True when whatever matches at ``p[i:]`` must start with a word character."""
    if i >= len(p):
        return False
    if p.startswith("(?:", i):
        return all(_begins_with_word(p, s) for s in _branches(p, i + 3))
    if p[i] == "(" and not p.startswith("(?", i):
        return all(_begins_with_word(p, s) for s in _branches(p, i + 1))
    if p[i] == "[":
        body = p[i + 1 : _class_end(p, i) - 1]
        return all(c.isascii() and (c.isalnum() or c in "_-") for c in body)
    if p[i] == "\\":
        return p[i + 1] in "wd"
    return p[i].isascii() and (p[i].isalnum() or p[i] == "_")


def _ends_with_word(p: str, i: int) -> bool:
    """True when the literal just before ``p[i]`` is a word character."""
    if i == 0 or not (p[i - 1].isascii() and (p[i - 1].isalnum() or p[i - 1] == "_")):
        return False
    return i < 2 or p[i - 2] != "\\" or p[i - 1] in "wd"


def _boundary(p: str, i: int) -> str:
    """An ASCII ``\\b`` at ``p[i]``, one-sided when the other side is known."""
    if _begins_with_word(p, i + 2):
        return r"(?<!\w)"
    if _ends_with_word(p, i):
        return r"(?!\w)"
    return _FULL_BOUNDARY


def translate(pattern: str, flags: str = "", target: str = "java") -> str:
    """Rewrite an ECMAScript pattern for ``target`` ("java" or "re2")."""
    multiline = "m" in flags
    out: list[str] = ["(?i)"] if "i" in flags else []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(f"[{SPACE_CLASS}]")
            elif nxt == "S":
                out.append(f"[^{SPACE_CLASS}]")
            elif nxt == "b" and target == "java":
                out.append(_boundary(pattern, i))
            else:
                out.append("/" if nxt == "/" else c + nxt)
            i += 2
        elif c == "[":
            end = _class_end(pattern, i)
            out.append(_translate_class(pattern[i:end]))
            i = end
        elif c == ".":
            out.append(_NOT_LINE_END)
            i += 1
        elif c == "^" and multiline:
            out.append(f"(?<!{_NOT_LINE_END})" if target == "java" else "(?m:^)")
            i += 1
        elif c == "$":
            if not multiline:
                out.append(r"\z")
            else:
                out.append(f"(?!{_NOT_LINE_END})" if target == "java" else "(?m:$)")
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _translate_class(text: str) -> str:
    if text == r"[\s\S]":
        return _ANY
    body = text[1:-1].replace(r"\s", SPACE_CLASS).replace(r"\/", "/")
    out, i = [], 0
    while i < len(body):
        if body[i] == "\\":
            out.append(body[i : i + 2])
            i += 2
            continue
        out.append("\\" + body[i] if body[i] in "[&" else body[i])
        i += 1
    return "[" + "".join(out) + "]"
