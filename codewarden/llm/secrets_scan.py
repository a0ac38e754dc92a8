"""Secrets in nested encodings: a worklist decodes layers until nothing new appears.

The text is layer 0. Each layer is searched by the three base rules; then its URL-escaped runs, Unicode escapes
(`\\xHH`, `\\uHHHH`, `\\u{H}`, `\\UHHHHHHHH`) and base64 words, also those wrapped over lines, are decoded to bytes. A
word that begins before its code is read in all four phases; a phase out of step counts if most of it is printable or
compressed. Bytes with a zip head (gzip of any number of members, zlib, bz2, xz) are inflated, and what comes out again,
until it no longer inflates. What is no text in UTF-8 is read with invalid bytes replaced, and as UTF-16 where it looks it.

A layer seen before in its run is not opened again, so cycles end. `STEPS` layers of escapes are taken one by one; what is
escaped deeper is unwrapped in one pass, and only its last layer is searched. Base64 makes a layer a quarter shorter, so
work is linear in the text and in what inflates from it. Inflated bytes are read in windows of `WINDOW` bytes that
overlap by `OVERLAP`: memory is bounded, and what is longer than the overlap may be cut at a window's end. Nothing is
refused unless the caller sets `most`: then bytes that inflate over `most` times their size are given up, and so are, in
any case, those that inflate over `LEVELS` times in a row; both count in `n_refused`. A finding in a nested layer has the
span, in the text, of the outermost encoded run that holds it; what the run shows undecoded is none.

Nulls: a null text is empty and has no findings. Repeated rows are scanned one by one, an empty table gives an empty
result, and other columns are not read. Very long texts are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# A run starts where its characters start, and gives nothing back: the search stays linear.
URL_RUN = re.compile(r"(?<![\w.~+/=&:'\"-])[\w.~+/=&:'\"-]*+(?:%[0-9A-Fa-f]{2}[\w.~+/=&:'\"-]*+)++", re.ASCII)
ESCAPES = r"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]{1,8}\}|U[0-9A-Fa-f]{8})"
UNICODE_RUN = re.compile(r"(?<![\x21-\x5b\x5d-\x7e])[\x21-\x5b\x5d-\x7e]*+(?:" + ESCAPES + r"[\x21-\x5b\x5d-\x7e]*+)++")
ESCAPE = re.compile(ESCAPES)
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 and nothing else between their indents; all but the last have one length.
BASE64_BLOCK = re.compile(r"(?<![^\n])[ \t]*+[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n(?:[ \t]*+[A-Za-z0-9+/_-]++[ \t]*+\r?\n)*+"
                          r"[ \t]*+[A-Za-z0-9+/_-]*+={0,2}")
#: Heads of compressed bytes that are looked for anywhere; zlib's is too short for that.
ZIP = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
UNPRINTABLE = bytes(b for b in range(256) if not 32 <= b < 127 and b not in b"\0\t\n\r")
STEPS, LEVELS, PIECE, WINDOW, OVERLAP = 4, 32, 1 << 16, 16 << 20, 1 << 20


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base rules, in the order of the digest."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


class Refused(Exception):
    """Compressed bytes that are given up."""


def _machine(head: bytes):
    if head.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if head.startswith(b"\xfd7zXZ\x00"):
        return lzma.LZMADecompressor()
    return zlib.decompressobj(15) if len(head) > 1 and head[0] & 15 == 8 and int.from_bytes(head[:2]) % 31 == 0 else None


def _inflated(pieces: Iterator[bytes], used: list[int]) -> Iterator[bytes]:
    """What the stream inflates to, member after member, up to its first fault; `used` counts the bytes read."""
    machine, data = None, b""
    for piece in pieces:
        data, used[0] = data + piece, used[0] + len(piece)
        if machine is None and len(data) < 10 and len(piece) == PIECE:
            continue
        while data or machine:
            if machine is None:
                machine = _machine(data)
                if machine is None:
                    used[0] -= len(data)
                    return
            try:
                out = machine.decompress(data, PIECE)
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                return
            if out:
                yield out
            if machine.eof:
                data, machine = machine.unused_data, None
                continue
            data = getattr(machine, "unconsumed_tail", b"")
            if not data and getattr(machine, "needs_input", len(out) < PIECE):
                break


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    held, fresh = bytearray(), False
    for piece in pieces:
        held += piece
        fresh = True
        if len(held) >= WINDOW:
            yield bytes(held)
            held, fresh = held[-OVERLAP:], False
    if fresh:
        yield bytes(held)


def _texts(data: bytes) -> Iterator[str]:
    yield data.decode("utf-8", "replace")
    if 4 * data.count(0) > len(data):
        for at in range(2):
            yield data[at:].decode("utf-16-le", "replace")


def _unzipped(make: Callable[[], Iterator[bytes]], most: int | None, level: int, above: set[bytes]) -> Iterator[str]:
    """The texts of a stream, and of those that it inflates to."""
    digest, size = hashlib.blake2b(digest_size=16), 0
    for window in _windows(make()):
        digest.update(window)
        size += len(window)
        if most is not None and size > most or level > LEVELS:
            raise Refused
        yield from _texts(window)
    if size and digest.digest() not in above:
        yield from _unzipped(lambda: _inflated(make(), [0]), most, level + 1, above | {digest.digest()})


def _opened(data: bytes, most: int | None) -> Iterator[tuple[str, bool] | None]:
    """(text, whether it was inflated) of the bytes and of all that inflates from them; None is a refusal."""
    for text in _texts(data):
        yield text, False
    end = 0
    for at in sorted({0, *(m.start() for m in ZIP.finditer(data))}):
        if at < end:
            continue
        used = [0]

        def stream(at=at, used=used) -> Iterator[bytes]:
            used[0] = 0
            return _inflated((data[i:i + PIECE] for i in range(at, len(data), PIECE)), used)

        try:
            for text in _unzipped(stream, most and most * len(data), 1, set()):
                yield text, True
        except Refused:
            yield None
        end = at + used[0] if used[0] < len(data) - at or at else end


def _opened_run(run: str, escape: str, plain: Callable[[str], bytes], most: int | None) -> Iterator[tuple[str, bool] | None]:
    """As `_opened`; zlib's bytes may also start at the first escape or, as zlib's x needs none, just before it."""
    yield from _opened(plain(run), most)
    first = run.index(escape)
    for at in sorted({first, max(0, first - 1)} - {0}):
        data = plain(run[at:])
        if _machine(data[:10]):
            yield from (found for found in _opened(data, most) if found is None or found[1])


def _character(escape: re.Match) -> str:
    code = int(escape[0].strip("\\uUx{}"), 16)
    return chr(code) if code < 0x110000 else escape[0]


def _unescaped(run: str, most: int | None) -> Iterator[tuple[str, bool] | None]:
    """A run without its escapes, as characters and, where all of them are bytes, as what the bytes hold."""
    text = lambda part: ESCAPE.sub(_character, part)
    yield text(run), False
    if max(text(run)) < "\u0100":
        yield from _opened_run(run, "\\", lambda part: text(part).encode("latin-1"), most)


def _settled(text: str) -> str:
    """The text without escapes of any depth, in one pass: what an escape leaves may complete another one."""
    out: list[str] = []
    digits = frozenset("0123456789abcdefABCDEF")
    for c in text:
        out.append(c)
        while True:
            if out[-1] in digits:
                size = next((n for n, head in ((3, ["%"]), (4, ["\\", "x"]), (6, ["\\", "u"]), (10, ["\\", "U"]))
                             if out[-n:len(head) - n] == head and digits.issuperset(out[len(head) - n:])), 0)
                code = "".join(out[(2 if size > 3 else 1) - size:]) if size else ""
            elif out[-1] == "}":
                size = next((n for n in range(5, 13) if out[-n:3 - n] == ["\\", "u", "{"]), 0)
                code = "".join(out[3 - size:-1]) if size and digits.issuperset(out[3 - size:-1]) else ""
            else:
                break
            if not code or int(code, 16) >= 0x110000:
                break
            out[-size:] = [chr(int(code, 16))]
    return "".join(out)


def _decoded(word: str, most: int | None) -> Iterator[tuple[str, bool] | None]:
    word = word.rstrip("=")
    if word.isalpha() and (word.islower() or word[1:].islower()):
        return  # plain words are no code
    word = word.replace("-", "+").replace("_", "/")
    for phase in range(min(4, len(word) - 11)):
        code = word[phase:]
        code = code[:-1] if len(code) % 4 == 1 else code
        try:
            data = base64.b64decode(code + "=" * (-len(code) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if not phase or ZIP.search(data) or 4 * len(data.translate(None, UNPRINTABLE)) >= 3 * len(data):
            yield from _opened(data, most)


def _blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, code) of base64 that is wrapped: lines of one length up to a last one that is not longer."""
    for m in BASE64_BLOCK.finditer(text):
        lines, at = [], m.start()
        for line in m[0].split("\n"):
            word = line.strip(" \t\r")
            if lines and (len(lines[-1][2]) < len(lines[0][2]) or len(word) > len(lines[0][2]) or lines[-1][2].endswith("=")):
                if len(lines) > 1:
                    yield lines[0][0], lines[-1][1], "".join(w for _, _, w in lines)
                lines = []
            if word:
                start = at + line.index(word)
                lines.append((start, start + len(word), word))
            at += len(line) + 1
        if len(lines) > 1:
            yield lines[0][0], lines[-1][1], "".join(w for _, _, w in lines)


def _layers(text: str, steps: int, most: int | None) -> Iterator[tuple[int, int, tuple[str, bool] | None, int]]:
    """(start, end, decoded, layers of escapes on top of it) of the encoded runs of a text."""
    if steps < STEPS:
        if "%" in text:
            for m in URL_RUN.finditer(text):
                yield from ((m.start(), m.end(), found, steps + 1) for found in _opened_run(m[0], "%", unquote_to_bytes, most))
        if "\\" in text:
            for m in UNICODE_RUN.finditer(text):
                yield from ((m.start(), m.end(), found, steps + 1) for found in _unescaped(m[0], most))
    elif steps == STEPS and ("%" in text or "\\" in text):
        last = _settled(text)
        yield 0, len(text), (last, False), STEPS + 1
        if max(last, default="\u0100") < "\u0100":
            yield from ((0, len(text), found, STEPS + 1) for found in _opened(last.encode("latin-1"), most))
    for m in BASE64_RUN.finditer(text):
        yield from ((m.start(), m.end(), found, 0) for found in _decoded(m[0], most))
    if "\n" in text:
        for a, b, word in _blocks(text):
            yield from ((a, b, found, 0) for found in _decoded(word, most))


def scan_text(text: str, most: int | None = None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int, int]], int]:
    """Base spans, nested findings (start, kind, end, depth) and the number of refused layers."""
    nested: set[tuple[int, str, int, int]] = set()
    refused, at, shown = 0, (0, 0), ""
    seen: set[bytes] = set()
    visible: set[str] = set()
    open_layers = [_layers(text, 0, most)]
    while open_layers:
        depth, layer = len(open_layers), next(open_layers[-1], None)
        if layer is None:
            open_layers.pop()
            continue
        start, end, found, steps = layer
        if found is None:
            refused += 1
            continue
        if depth == 1 and (start, end) != at:
            at, shown, seen, visible = (start, end), text[start:end], set(), set()
        decoded, inflated = found
        key = hashlib.blake2b(decoded.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        for a, kind, b in base_spans(decoded):
            if (at[0], kind, at[1], depth) not in nested and decoded[a:b] not in visible:
                if decoded[a:b] in shown:
                    visible.add(decoded[a:b])
                else:
                    nested.add((at[0], kind, at[1], depth))
        open_layers.append(_layers(decoded, 0 if inflated else steps, most))
    return base_spans(text), sorted(nested), refused


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, counts per kind and digest of the base spans, all spans, and the nested findings with their depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base, nested, refused = scan_text(text or "", most)
                spans = sorted({*base, *((a, k, b) for a, k, b, _ in nested)}, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in KINDS),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(nested),
                             max((x[3] for x in nested), default=0), refused))
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, types)]],
                                             ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in NAMES))


NAMES = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_nested", "depth", "n_refused")
