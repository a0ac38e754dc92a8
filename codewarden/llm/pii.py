"""Personal data: four base rules, and identifiers that contexts learned from the base findings point at.

Each base finding is a seed. The one and two words before it, without marks, are lexical patterns; their places are counted
by the same cut into words. Identifier-like are blank-free words with '@' or 5 digits, without a key before them, and groups
of digits joined by blanks, dots, brackets or hyphens. A pattern is scored per kind by the
share of all its places in the corpus that hold identifiers of the kind; an identifier-like word that no rule found is
scored by the patterns it stands after (noisy or); `ROUNDS` rounds over the pattern-instance graph follow. A word after
a pattern of at least `CONFIDENT` score, with at least `SUPPORT` different seeds, becomes a span of the kind.

The graph holds identifiers only, never texts, and all of its joins are by pattern or instance. Patterns with too few
seeds are left out before their places are counted; all others are counted, in blocks of about `PATTERNS` that are sent
to all tasks, one pass over the texts each. Nulls: a null text is empty; a null id is an id. Repeated rows get equal results, one row each, and count as
often as they occur; an empty table gives an empty result; other columns are kept by `redact` and not read by `find`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENT, ROUNDS, PATTERNS, LEAST_DIGITS = 5, 0.7, 3, 100_000, 5

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match starts where its digits start and gives nothing back, so that the search is linear. As a match takes all digits
# of its last run, the look back never hides the start of the next one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
EDGE = ".,;!?()[]{}\"'<>|"
WORD = re.compile(r"\w+")
KEY = re.compile(r"(?:[^\W\d_]+(?:[_-][^\W\d_]+)*+[:=](?!//)[\"'(<\[{]*)+")
# Groups of digits; a match starts where blanks or marks end and gives back one mark between groups at most.
DIGITS = re.compile(r"(?<![\w@%+.\-/])[+(\[]*+[0-9]++(?:(?: - | ?[(\[]|[)\]][ .-]?|[ .-])[0-9]++)*+")
FULL, MOST_DIGITS = 10, 19  # digits of an identifier that may be whole, and of the longest one


def _luhn(digits: str) -> bool:
    doubled = (2 * int(c) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), ordered."""
    found = []
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = at - (len(head) - len(head.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _digit_groups(text: str) -> list[tuple[int, int]]:
    """(start, end) of digit groups that blanks or brackets join to one identifier."""
    out = []
    for m in DIGITS.finditer(text):
        run, at = m[0], m.start()
        if sum(map(str.isdigit, run)) < LEAST_DIGITS or text[m.end():m.end() + 1].isalnum() or text.startswith(("@", "_"), m.end()):
            continue
        total, start, end, card = 0, 0, 0, False
        for piece in [*re.finditer(r"[^ ]+", run), None]:
            n = sum(map(str.isdigit, piece[0])) if piece else 0
            # a whole identifier ends at a blank, but a card goes on with further groups
            if not piece or n and total and (total + n > MOST_DIGITS or total >= FULL and not (card and n > 1)):
                part = run[start:end]
                a = start
                while part and part[0] in "([" and "])"["([".index(part[0]) - 1] not in part:
                    part, a = part[1:], a + 1
                if LEAST_DIGITS <= total <= MOST_DIGITS and any(c in part for c in " ()[]"):
                    out.append((at + a, at + end))
                total, start = 0, piece.start() if piece else 0
            if piece:
                card = n == 4 and piece[0].isdigit() if not total else card
                total, end = total + n, piece.end()
    return out


class _Contexts:
    """The one and two words before a place, on its line; lines are cut into words once, places come in any order."""

    def __init__(self, text: str) -> None:
        self.text, self.lines = text, {}

    def before(self, start: int) -> tuple[str, str]:
        at = self.text.rfind("\n", 0, start) + 1
        if at not in self.lines:
            stop = self.text.find("\n", at)
            words = [m.span() for m in WORD.finditer(self.text, at, len(self.text) if stop < 0 else stop)]
            self.lines[at] = words, [b for _, b in words]
        words, ends = self.lines[at]
        k = bisect_right(ends, start)
        found = [self.text[a:b].lower() for a, b in words[max(0, k - 2):k]]
        return (found[-1] if found else ""), (" ".join(found) if len(found) > 1 else "")


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str, str]]:
    """(start, end, kind or -1, value, one word before, two words before) of seeds and identifier-like words."""
    contexts = _Contexts(text)
    out = [(a, b, k, text[a:b].lower(), *contexts.before(a)) for a, k, b in base]
    taken = [(a, b) for a, _, b in base]

    def free(a: int, b: int, i: int) -> bool:
        return not any(x < b and a < y for x, y in taken[max(0, i - 4):i + 4])

    found, i = [], 0
    for a, b in _digit_groups(text):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if free(a, b, i):
            found.append((a, b))
    taken, i = sorted([*taken, *found]), 0
    for m in CANDIDATE.finditer(text):
        word = m[0].strip(EDGE)
        a = m.start() + m[0].index(word)
        key = KEY.match(word)
        if key:
            word, a = word[key.end():].rstrip(EDGE), a + key.end()
        if "@" not in word and sum(c.isdigit() for c in word) < LEAST_DIGITS:
            continue
        b = a + len(word)
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if free(a, b, i):
            found.append((a, b))
    return out + [(a, b, -1, text[a:b].lower(), *contexts.before(a)) for a, b in found]


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_SCANNED = ("key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans " + _SPANS
            + ", cands array<struct<start:int,end:int,kind:int,value:string,one:string,two:string>>")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: key of the text, counts, base spans and candidates. The only table that grows with texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()),
                                   ("one", pa.string()), ("two", pa.string())]))
        fields, names = [f.name for f in cand.value_type], [x.split()[0] for x in _SCANNED.split(", ")]
        for batch in batches:
            found = [(t or "", base_spans(t or "")) for t in batch["text"].to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in b) for _, b in found], pa.int64()) for kind in range(4)]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for _, b in found])
            spans = pa.array([[{"start": a, "kind": k, "end": e} for a, k, e in b] for _, b in found], span)
            cands = pa.array([[dict(zip(fields, c)) for c in candidates(t, b)] for t, b in found], cand)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], *counts, digests, spans, cands],
                                             ["doc_id", *(n for n in ("key", "n_email", "n_ip", "n_card", "n_phone",
                                                                      "base_sha256", "spans", "cands"))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return stored(keyed.mapInArrow(run, f"doc_id {kind}, {_SCANNED}"), "pii")


def _places(docs: DataFrame, patterns: set[str]) -> DataFrame:
    """(pattern, places): how often each pattern occurs in all texts, whatever follows."""
    shipped = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        last, total = {p.rsplit(" ", 1)[-1] for p in wanted}, Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                for line in (text or "").split("\n"):
                    words = [w.lower() for w in WORD.findall(line)]
                    for i, w in enumerate(words[:-1]):
                        if w in last:
                            if w in wanted:
                                total[w] += 1
                            two = f"{words[i - 1]} {w}" if i else w
                            if i and two in wanted:
                                total[two] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pattern", "places"])

    return (docs.select("text").mapInArrow(run, "pattern string, places long")
            .groupBy("pattern").agg(F.sum("places").alias("places")))


def discover(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(doc_id, key, extra): spans that confident patterns add, one row per document that has any."""
    flat = scanned.select("doc_id", "key", F.explode("cands").alias("c")).select("doc_id", "key", "c.*")
    ends = flat.select("doc_id", "key", "start", "end", "kind", "value", F.explode(F.array("one", "two")).alias("pattern"))
    ends = ends.where("pattern <> ''")
    edges = stored(ends.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")), "graph")
    rich = (edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
            .where(F.col("seeds") >= SUPPORT).select("pattern").distinct())
    # a pattern that stands before no unknown word can find nothing new
    useful = stored(rich.join(edges.where("kind < 0").select("pattern").distinct(), "pattern", "left_semi").select("pattern"), "useful")
    blocks = -(-useful.count() // PATTERNS)
    empty = ends.select("doc_id", "key", F.lit(None).cast(_SPANS).alias("extra")).limit(0)
    if not blocks:
        return empty
    places = None
    for block in range(blocks):
        chosen = {r["pattern"] for r in useful.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()}
        part = stored(_places(docs, chosen), "places")
        places = part if places is None else places.unionByName(part)
    graph = stored(edges.join(places, "pattern"), "graph")
    truth = graph.where("kind >= 0").select("pattern", "value", F.col("kind").alias("k"), "n", "places", F.lit(1.0).alias("score"))
    unknown = graph.where("kind < 0").select("pattern", "value", "n", "places",
                                                 F.explode(F.array(*map(F.lit, range(len(KINDS))))).alias("k"))
    scores = None
    for _ in range(ROUNDS):
        known = truth if scores is None else truth.unionByName(unknown.join(scores, ["value", "k"]).select(truth.columns))
        patterns = stored(known.groupBy("pattern", "k").agg(F.least(F.sum(F.col("score") * F.col("n")) / F.max("places"), F.lit(1.0)).alias("confidence"),
                                                            F.count(F.when(F.col("score") == 1, 1)).alias("seeds"))
                          .where(F.col("seeds") >= SUPPORT), "patterns")
        miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
        scores = (unknown.join(patterns, ["pattern", "k"]).groupBy("value", "k").agg((1 - F.exp(miss)).alias("score")))
    sure = patterns.where(F.col("confidence") >= CONFIDENT).select("pattern", F.col("k").alias("to"), "confidence")
    hits = ends.where("kind < 0").join(sure, "pattern").groupBy("doc_id", "key", "start", "end").agg(
        F.max(F.struct("confidence", (-F.col("to")).alias("order"))).alias("best"))
    return hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct(
        "start", (-F.col("best.order")).cast("int").alias("kind"), "end")).alias("extra"))


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    extra = extra.select(F.col("doc_id").alias("x_id"), F.col("key").alias("x_key"), "extra")
    return rows.join(extra, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("key") == F.col("x_key")), "left").drop("x_id", "x_key")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and digest, all spans as text, and the number of learned spans."""
    scanned = scan(docs)
    rows = _with_extra(scanned.drop("cands"), stored(discover(docs, scanned), "learned"))
    both = F.concat("spans", F.coalesce("extra", F.array().cast(_SPANS)))
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(F.sort_array(both), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(text, ",").alias("spans"),
                       F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_learned"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each span replaced by the name of its kind in brackets.

    Only the learned spans are joined to the texts; they are few, and Spark broadcasts them if their file is small.
    """
    extra = stored(discover(docs, scan(docs)), "learned")
    names = docs.columns
    extra = extra.select(F.col("doc_id").alias("_x_id"), F.col("key").alias("_x_key"), F.col("extra").alias("_x_extra"))
    same = F.col("doc_id").eqNullSafe(F.col("_x_id")) & (F.xxhash64("text") == F.col("_x_key"))
    keyed = docs.join(extra, same, "left").drop("_x_id", "_x_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, more in zip(batch["text"].to_pylist(), batch["_x_extra"].to_pylist()):
                spans = sorted([*base_spans(text or ""), *((x["start"], x["kind"], x["end"]) for x in more or ())])
                parts, free = [], 0
                for a, k, b in spans:
                    if a >= free:
                        parts += [text[free:a], f"[{KINDS[k]}]"]
                    free = max(free, b)  # of spans that overlap one name stays
                out.append("".join([*parts, text[free:]]) if spans else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string())).select(names)

    return keyed.mapInArrow(run, docs.schema)
