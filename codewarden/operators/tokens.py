"""Counts over the lines, tokens and words of a text, in Arrow batches.

Tokens are the one thing of which a file has thousands: as Spark strings each costs microseconds, and a line some.  Here they
live only while their line is looked at, and a few numbers leave.  Separators, and tokens of one character, become blanks in the
bytes of the whole text first, which leaves its lines as long as they are.  Words are no objects at all, but places in the bytes.

The module is pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewarden.catalog import authorship as A
from codewarden.functions.dialect import SPACE_CHARS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Texts of so many bytes are looked at together.
PORTION = 1 << 20
_ascii = [chr(b) for b in range(128)]
_word = re.compile(r"\w", re.ASCII).match
_separator = re.compile("[" + A.TOKEN_SEPARATORS[1:-2].replace(r"\s", SPACE_CHARS).replace("[", r"\[") + "]").match
# separators but line ends as blanks
_TOKENS = bytes(32 if b < 128 and b != 10 and _separator(_ascii[b]) else b for b in range(256))
# words in lower case, all else as blanks
_WORDS = bytes(ord(_ascii[b].lower()) if b < 128 and _word(_ascii[b]) else 32 for b in range(256))
# spaces of more than one byte, as the numbers of their first three
_WIDE = np.array([int.from_bytes(c.encode().ljust(3, b"\0")) for c in SPACE_CHARS if c > "\x7f"], np.int32)
_generic = frozenset(w.encode() for w in A.GENERIC_WORDS)


def _shape(size, *first):
    """Length and first three letters of a word in 15 bits."""
    return ((first[0] & 31) << 10 | (first[1] & 31) << 5 | first[2] & 31) ^ size << 11


_LONGEST = max(map(len, _generic))
_SHAPES = np.zeros(1 << 15, bool)
_SHAPES[[_shape(len(w), *w[:3]) for w in _generic]] = True


def _starts(pattern: str) -> tuple[str, ...]:
    return tuple(s.replace("\\", "") for s in pattern.removeprefix(r"^\s*(").removesuffix(")").split("|"))


_comment_wide, _comment = _starts(A.COMMENT_LINE_WIDE), _starts(A.COMMENT_LINE)
_LN2 = math.log(2)


def _log2(x: int) -> float:
    return math.log(x) / _LN2


class _Weights(dict):
    """c * log2(c), worked out once."""

    def __missing__(self, c: int) -> float:
        self[c] = c * _log2(c)
        return self[c]


_weights = _Weights()
# one of these begins each kind of comment
_COMMENT_FIRST = frozenset(s[0] for s in _comment_wide)


def entropy(tokens: list[bytes]) -> float:
    """Shannon entropy; log2(n) when nothing repeats, as in most lines of code."""
    n = len(tokens)
    if n < 2:
        return 0.0
    if n < 16 and len(set(tokens)) == n:
        return _log2(n)
    counts = Counter(tokens)
    if len(counts) < 2:
        return 0.0
    if len(counts) == n:
        return _log2(n)
    return _log2(n) - sum([_weights[c] for c in counts.values() if c > 1]) / n


def _blank(b: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """Blanks for characters of some bytes."""
    for k in range(4):
        b[at[size > k] + k] = 32


def longer_tokens(raw: bytes) -> bytes:
    """The text with blanks for separators and for tokens of one character."""
    b = np.frombuffer(b"\n" + raw.translate(_TOKENS) + b"\n", np.uint8).copy()
    at = np.flatnonzero(b >= 0xC0)
    size = 2 + (b[at] >= 0xE0).astype(np.int64) + (b[at] >= 0xF0)
    wide = np.isin(b[at].astype(np.int32) << 16 | b[at + 1].astype(np.int32) << 8 | np.where(size > 2, b[np.minimum(at + 2, len(b) - 1)], 0), _WIDE)
    _blank(b, at[wide], size[wide])
    at, size = at[~wide], size[~wide]
    gap = (b == 32) | (b == 10)
    alone = gap[at - 1] & gap[at + size]
    b[1:-1][gap[:-2] & ~gap[1:-1] & gap[2:]] = 32
    _blank(b, at[alone], size[alone])
    return b[1:-1].tobytes()


def _of_lines(text: str, tokens: list[bytes]) -> dict:
    """Numbers of a text's lines; ``tokens`` are its lines with blanks between the tokens.

    ``entropy`` and ``lengths`` are count, sum and sum of squares: of the entropies, above 0, of the code lines, and of the
    characters of the lines that are not empty.  Code lines are ``repeated`` if their text occurs at least twice.
    """
    n, s, ss = 0.0, 0.0, 0.0
    filled, chars, squares, comments, code = 0, 0, 0, 0, []
    lines = text.split("\n")
    for line, parts in zip(lines, tokens):
        bare = line.strip(SPACE_CHARS)
        if not bare:
            continue
        size = len(line)
        filled, chars, squares = filled + 1, chars + size, squares + size * size
        maybe = bare[0] in _COMMENT_FIRST
        comments += maybe and bare.startswith(_comment)
        if len(bare) > 5 and not (maybe and bare.startswith(_comment_wide)):
            code.append(bare)
            e = entropy(parts.split())
            if e > 0:
                n, s, ss = n + 1, s + e, ss + e * e
    repeated = sum(c for c in Counter(code).values() if c > 1)
    return {"lines": len(lines), "code": len(code), "repeated": repeated, "comments": comments,
            "entropy": {"n": n, "s": s, "ss": ss}, "lengths": {"n": float(filled), "s": float(chars), "ss": float(squares)}}


def lines_in(texts: Sequence[bytes]) -> list[dict]:
    """The numbers of each text's lines."""
    decoded = [t.decode("utf-8", "replace") for t in texts]
    tokens, out, at = longer_tokens("\n".join(decoded).encode()).split(b"\n"), [], 0
    for text in decoded:
        begin, at = at, at + text.count("\n") + 1
        out.append(_of_lines(text, tokens[begin:at]))
    return out


def line_counts(raw: bytes) -> dict:
    return lines_in([raw])[0]


def words_in(texts: Sequence[bytes]) -> list[dict[str, int]]:
    """How many identifiers each text has, and how many of them say nothing."""
    text = b" " + b" ".join(texts).translate(_WORDS) + b" "
    b, ends = np.frombuffer(text, np.uint8), np.cumsum([len(t) + 1 for t in texts])
    inside = b != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, size = edges[::2], edges[1::2] - edges[::2]
    identifiers = (size > 2) & (b[begin] > 57)
    begin, size = begin[identifiers], size[identifiers]
    short = size <= _LONGEST
    at, n = begin[short], size[short]
    likely = _SHAPES[_shape(n, *(b[at + k].astype(np.int64) for k in range(3)))]
    at, n = at[likely], n[likely]
    generic = at[np.array([text[i:i + k] in _generic for i, k in zip(at.tolist(), n.tolist())], bool)]
    of_text = [np.bincount(np.searchsorted(ends, x), minlength=len(texts)).tolist() for x in (begin, generic)]
    return [{"identifiers": i, "generic_identifiers": g} for i, g in zip(*of_text)]


def word_counts(raw: bytes) -> dict[str, int]:
    return words_in([raw])[0]


def _per_text(body: Callable[[Sequence[bytes]], list[dict]], kind: pa.StructType) -> Callable[[pa.Array], pa.Array]:
    """A function of texts, of which `body` gets some at a time; null for null."""
    def run(texts: pa.Array) -> pa.Array:
        rows, out, begin = texts.cast(pa.binary()).to_pylist(), [], 0
        while begin < len(rows):
            end, size = begin, 0
            while end < len(rows) and size < PORTION:
                size, end = size + len(rows[end] or b""), end + 1
            part = rows[begin:end]
            out += [None if t is None else c for t, c in zip(part, body([t or b"" for t in part]))]
            begin = end
        return pa.array(out, kind)

    return run


_MOMENTS = T.StructType([T.StructField(name, T.DoubleType()) for name in ("n", "s", "ss")])
_LINES = T.StructType([*(T.StructField(name, T.IntegerType()) for name in ("lines", "code", "repeated", "comments")),
                       *(T.StructField(name, _MOMENTS) for name in ("entropy", "lengths"))])
_COUNTS = T.StructType([T.StructField(name, T.IntegerType()) for name in ("identifiers", "generic_identifiers")])
_moments = pa.struct([(f.name, pa.float64()) for f in _MOMENTS])
lines_of_text = F.arrow_udf(_per_text(lines_in, pa.struct(
    [*((name, pa.int32()) for name in ("lines", "code", "repeated", "comments")), ("entropy", _moments), ("lengths", _moments)])), _LINES)
words_of_text = F.arrow_udf(_per_text(words_in, pa.struct([(f.name, pa.int32()) for f in _COUNTS])), _COUNTS)


def holds(literals: Sequence[str], lowered: bool) -> Callable[[str], Column]:
    """A function of a column: which of the literals occur, in its text or its text in lower case (A to Z).

    One of ``OPENINGS`` must go on as all patterns that need it do.
    """
    words = [w.encode() for w in literals]
    goes_on = {w.encode(): re.compile(p.encode(), re.IGNORECASE) for w, p in A.OPENINGS.items()}

    def occurs(w: bytes, t: bytes) -> bool:
        return w in t and (w not in goes_on or goes_on[w].search(t) is not None)

    def run(texts: pa.Array) -> pa.Array:
        rows = (t.lower() if lowered and t is not None else t for t in texts.cast(pa.binary()).to_pylist())
        return pa.array([None if t is None else [occurs(w, t) for w in words] for t in rows], pa.list_(pa.bool_()))

    return F.arrow_udf(run, "array<boolean>")
