"""Which rules a file may match, by its type and the literals that every match contains, and where.

A catalog looks for some hundred literals in each file.  Here three characters of each are looked for in one go through the
bytes of an Arrow batch; only where a file has these is it searched for the literal itself, once per file and if a rule gets
to it.  Upper-case letters are A to Z: patterns that ignore case know no others.

The module is pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.operators.places import Branch, Places

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# File types, or None for all, and groups of literals of which one each must occur.
Gate = tuple["tuple[str, ...] | None", "tuple[tuple[str, ...], ...]"]

# So many bytes are searched at once; a longer file is one portion.
PORTION = 1 << 20
# A byte as one of 32 kinds, those of letters first; the rarer ones of text have kinds of their own.
_KINDS = np.full(256, 31, np.uint16)
for _k, _chars in enumerate([*"abcdefghijklmnopqrstuvwxyz", ".", "_-", "(", "0123456789"]):
    for _c in _chars + _chars.upper():
        _KINDS[ord(_c)] = _k
# How often a kind is found in a thousand characters of prose, about; the others are rare.
_COMMON = np.array([*(65, 12, 22, 34, 100, 18, 16, 48, 56, 1, 6, 32, 19, 56, 60, 15, 1, 48, 51, 72, 22, 8, 19, 1, 16, 1), 12, 2, 1, 8, 1, 190])


def three_kinds(kinds: np.ndarray) -> np.ndarray:
    """The kinds of each three bytes in a row, as one number."""
    return kinds[:-2] << 10 | kinds[1:-1] << 5 | kinds[2:]


def rarest_three(word: bytes) -> int | None:
    """The three characters by which a literal is found; a shorter one has none."""
    kinds = _KINDS[np.frombuffer(word, np.uint8)]
    if len(kinds) < 3:
        return None
    weight = _COMMON[kinds[:-2]] * _COMMON[kinds[1:-1]] * _COMMON[kinds[2:]]
    return int(three_kinds(kinds)[weight.argmin()])


class Gates:
    """The gates of a catalog; those of a type are picked once per type."""

    def __init__(self, gates: Sequence[Gate]) -> None:
        self.gates = [(types, [[w.encode() for w in group] for group in groups]) for types, groups in gates]
        self.types = {t for types, _ in gates for t in types or ()}
        self.of_type: dict[tuple, list] = {}
        words = {w for _, groups in self.gates for group in groups for w in group}
        threes = {w: three for w in words if (three := rarest_three(w)) is not None}
        #: the number of a literal's three characters, from 1
        self.number = {three: i for i, three in enumerate(sorted({*threes.values()}), 1)}
        self.three = {w: self.number[three] for w, three in threes.items()}
        self.numbers = np.zeros(1 << 15, np.uint16)
        self.numbers[list(self.number)] = list(self.number.values())
        # of each group the three characters of its literals, one of which is there; a literal without them may be in any file
        owners = [(i, group) for i, (_, groups) in enumerate(self.gates) for group in groups]
        self.one_of = np.zeros((len(self.number) + 1, len(owners)), np.float32)
        self.owner = np.zeros((len(owners), len(self.gates)), np.float32)
        for k, (i, group) in enumerate(owners):
            self.owner[k, i] = 1
            self.one_of[[self.three.get(w, 0) for w in group], k] = 1

    def chosen(self, ext: str, base: str) -> tuple[np.ndarray, list[int]]:
        """The gates of a type, as flags and positions."""
        key = tuple(t for t in (ext if ext.startswith(".") else "", "" if base.startswith(".") else base) if t in self.types)
        if key not in self.of_type:
            flags = np.array([types is None or any(t in types for t in key) for types, _ in self.gates], bool)
            self.of_type[key] = flags, np.flatnonzero(flags).tolist()
        return self.of_type[key]

    def threes(self, texts: Sequence[bytes]) -> np.ndarray:
        """Of each text, by their numbers, whether the three characters by which literals are found are in it; number 0 is set."""
        numbers = self.numbers[three_kinds(_KINDS[np.frombuffer(b"".join(texts), np.uint8)])]
        at = np.flatnonzero(numbers)
        found = np.zeros((len(texts), len(self.number) + 1), bool)
        found[:, 0] = True
        found[np.searchsorted(np.cumsum([len(t) for t in texts]), at, "right"), numbers[at]] = True
        return found

    def open(self, lowered: bytes, ext: str, base: str, threes: np.ndarray | None = None, among: Sequence[int] | None = None) -> list[int]:
        """The positions of the gates that the file passes; ``threes`` are those of the file and ``among`` those they leave open."""
        known: dict[bytes, bool] = {}

        def has(word: bytes) -> bool:
            if word not in known:
                known[word] = (threes is None or bool(threes[self.three.get(word, 0)])) and word in lowered
            return known[word]

        return [i for i in (self.chosen(ext, base)[1] if among is None else among) if all(any(map(has, group)) for group in self.gates[i][1])]

    def passed(self, texts: Sequence[bytes], ext: Sequence[str | None], base: Sequence[str | None]) -> Iterator[list[int]]:
        """The same of many files."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size < PORTION:
                size, end = size + len(texts[end]), end + 1
            found = self.threes(texts[begin:end])
            shut = (found.astype(np.float32) @ self.one_of == 0).astype(np.float32) @ self.owner > 0
            for text, threes, no, e, b in zip(texts[begin:end], found, shut, ext[begin:end], base[begin:end]):
                among = np.flatnonzero(self.chosen(e or "", b or "")[0] & ~no).tolist()
                yield self.open(text.lower(), e or "", b or "", threes, among) if among else []
            begin = end


def parts_of(text: bytes, passed: Sequence[int], places: Sequence[Places | None], whole: int) -> list[tuple[int, int, bytes | None]]:
    """(gate, lines above, lines) of the places at which the rules of open gates can match; no lines stand for the whole text.

    With the gate ``whole`` open every rule gets the whole text.
    """
    lowered, out = text.lower(), []
    for i in passed:
        found = places[i].of(text, lowered) if places[i] is not None and whole not in passed else None
        if found is None:
            out.append((i, 0, None))
            continue
        above = at = 0
        for begin, end in found:
            above, at = above + text.count(b"\n", at, begin), begin
            out.append((i, above, text[begin:end]))
    return out


def open_gates(gates: Sequence[Gate], reaches: Sequence[tuple[Branch, ...] | None], whole: int) -> Callable[..., Column]:
    """A function of the columns ``code``, ``ext`` and ``base``; of each gate it is known what its matches reach, or None."""
    def run(code: pa.Array, ext: pa.Array, base: pa.Array) -> pa.Array:
        texts, places = code.cast(pa.binary()).to_pylist(), [r and Places(r) for r in reaches]
        passed = Gates(gates).passed(texts, ext.to_pylist(), base.to_pylist())
        rows = [parts_of(text, p, places, whole) for text, p in zip(texts, passed)]
        flat = [part for row in rows for part in row]
        parts = pa.StructArray.from_arrays([pa.array([p[k] for p in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))],
                                           ["gate", "above", "part"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), parts)

    return F.arrow_udf(run, "array<struct<gate: int, above: int, part: binary>>")
