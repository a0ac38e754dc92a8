"""Collocations of 2 to 4 words, counted in FM-indexes over word ids, one per shard of the texts.

A shard holds up to `SHARD` words of a task as ids, a mark between pieces, and is sorted by the next `LONGEST` ids, forwards
and backwards. The two Burrows-Wheeler transforms answer phrases as intervals: a word put in front narrows the interval of the
forward index, a word put behind that of the backward one, and the other interval follows by the words that sort before.
Words a..b..c grow from the middle by turns, so both indexes are needed; an order of `LONGEST` ids is enough for phrases
of that length. The transforms are written once. A walk through them for each length sums counts by a 48-bit hash of the
phrase, which may be too high for a hash of two phrases but never too low; a last walk counts the phrases themselves, but
only those whose sums are high enough. A longer phrase is only visited if both phrases of one word less may be frequent.

Hashes are sent as sorted runs, one per task and range of hashes; there are as many ranges as `RANGE` words fit into the
texts, and a task merges one range at a time. Hashes have 32 to 48 bits, as many as the number of words asks for, and the
steps between them are compressed byte by byte: all first bytes, all second ones. What may be frequent goes to the tasks as a
filter of at most `FILTER_BITS` bits, whatever its size: it never refuses a frequent phrase, and what it lets through in error
is counted exactly and dropped by its sum. Phrases are sent in the same way, whole and sorted, in ranges by their first two
words: neighbours begin alike and take a few bytes each. They meet by language and phrase. Scores are whole numbers of up to
38 digits.

Nulls: a null text is empty and a null language is `und`, one with the texts of that name. Empty texts have no words; a
very long one is dealt to several shards, cut between two of its pieces. Repeated rows count each. Ties rank by count, then by phrase in byte
order. A language without candidates gives no rows, as does an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewarden.llm.common import LARGE_ROWS, batches_of, stored

LEAST, LONGEST, INSIDE, TOP, SCALE = 30, 4, 80, 2_000, 2_000_000
SHARD, RANGE, FILTER_BITS, SALTS, PARTS = 300_000, 1_000_000, 1 << 28, 4, 64
#: Phrases that a task hands over at once, and hashes that it holds.
CHUNK, HELD = 50_000, 2_000_000
#: Words that a task walks through at least, where that leaves a task for each core: what it merges is not sent.
TASK = 4_000_000
#: A full stop stands for every mark between pieces; A to Z are lower-cased.
LETTERS = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words of the texts per range of phrases.
PHRASE_RANGE = 16_000_000
RUNS = "range long, first long, dropped int, size int, step_width int, steps binary, counts binary"
PHRASE_RUNS = "range long, lang string, size int, text_size int, phrases binary, count_width int, counts binary"
SHARDS = "langs array<string>, starts array<int>, sizes array<long>, words binary, left binary, right binary"


# --- the index of a shard

def transform(ids: np.ndarray) -> np.ndarray:
    """The id before each place, in the order of the `LONGEST` ids from the place on."""
    rank, step, order = ids.astype(np.uint64), 1, np.zeros(0, np.int64)
    while step < LONGEST:  # prefix doubling
        key = rank << np.uint64(32) | np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.uint64)])
        order = np.argsort(key)
        if len(key):
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)]).astype(np.uint64) + np.uint64(1)
        step *= 2
    return np.concatenate([np.zeros(1, ids.dtype), ids[:-1]])[order]


class Shard:
    """The words of some texts, as they come."""

    def __init__(self) -> None:
        self.fresh, self.known, self.held, self.size = count(1), {}, [np.zeros(1, np.int64)], 1

    def add(self, lang: str, tokens: list[bytes]) -> None:
        if lang not in self.known:
            self.known[lang] = defaultdict(self.fresh.__next__, {b".": 0})
        self.held += [np.fromiter(map(self.known[lang].__getitem__, tokens), np.int64, len(tokens)), np.zeros(1, np.int64)]
        self.size += len(tokens) + 1

    def row(self) -> pa.RecordBatch:
        """Ids go by language and word; both ends are marks."""
        langs, words, starts = sorted(self.known), [], []
        ids = np.zeros(sum(map(len, self.known.values())) + 1, np.int32)
        for lang in langs:
            starts.append(len(words) + 1)
            own = sorted((w, i) for w, i in self.known[lang].items() if i)
            ids[[i for _, i in own]] = np.arange(len(words) + 1, len(words) + len(own) + 1)
            words += [w for w, _ in own]
        text = ids[np.concatenate(self.held)]
        of = np.searchsorted(starts, text[text > 0], "right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array([langs], pa.list_(pa.string())), pa.array([starts], pa.list_(pa.int32())),
             pa.array([np.bincount(of, minlength=len(langs)).tolist()], pa.list_(pa.int64())), pa.array([b".".join(words)], pa.binary()),
             pa.array([transform(text).tobytes()], pa.binary()), pa.array([transform(text[::-1]).tobytes()], pa.binary())],
            ["langs", "starts", "sizes", "words", "left", "right"])


def index(docs: DataFrame) -> DataFrame:
    """One row per shard: its languages, first id and words of each, the words in order of id, and both transforms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist()):
                    tokens, end = text.encode("utf-8", "surrogatepass").translate(LETTERS).replace(b".", b" . ").split(), 0
                    while end < len(tokens):
                        begin, end = end, min(end + SHARD, len(tokens))
                        while end < len(tokens) and tokens[end] != b".":
                            end += 1
                        shard.add(lang, tokens[begin:end])
                        if shard.size >= SHARD:
                            yield shard.row()
                            shard = Shard()
        if shard.size > 1:
            yield shard.row()

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return text.mapInArrow(run, SHARDS)


# --- frequent phrases as a filter

def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
    return np.array([zlib.crc32(w, seed) for w in words], np.uint64)


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """From the hashes of the words."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * FACTOR
        h ^= h >> np.uint64(31)
    return h * MIX >> np.uint64(16)


def merged(h: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, with its sum."""
    if (h[1:] > h[:-1]).all():
        return h, a
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(a[order], first) if len(h) else a


def tallied(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, with how often it is there; sorts the hashes where they lie."""
    h.sort()
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(first, append=len(h))


def dropped_bits(size: int, spare: int = 7, unit: int = 8) -> int:
    """Low bits of a hash that so many words do without, of which a whole number of units is left.

    Under one in 2 ** `spare` phrases shares the rest with another one.
    """
    return min(16, max(0, 48 - unit * -(-(size.bit_length() + spare) // unit)))


def squeezed(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True) if data else b""


def restored(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def packed(x: np.ndarray) -> tuple[int, bytes]:
    """The numbers in as few whole bytes as the largest needs; their first bytes come first, then their second ones."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return width, squeezed(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpacked(width: int, size: int, data: bytes) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = np.frombuffer(restored(data, width * size), np.uint8).reshape(width, size).T
    return out.view("<u8").ravel()


def runs(h: np.ndarray, a: np.ndarray, ranges: int, dropped: int = 0) -> pa.RecordBatch:
    """Hashes without their low bits, sorted, with their counts, cut into ranges: the first one, then steps.

    A count takes one byte; a higher one is sent in several parts.
    """
    low = np.uint64(dropped)
    h, a = merged(h >> low if dropped else h, a)
    if a.max(initial=0) > 255:
        times = np.maximum(1, -(-a // 255))
        counts = np.full(int(times.sum()), 255, np.uint8)
        counts[np.cumsum(times) - 1] = a - 255 * (times - 1)
        h = np.repeat(h, times)
    else:
        counts = a.astype(np.uint8)
    of = h << low
    of >>= np.uint64(16)
    of *= np.uint64(ranges)
    of >>= np.uint64(32)
    edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(h)]
    rows = [(int(of[i]), int(h[i]), dropped, j - i, *packed(np.diff(h[i:j])), squeezed(counts[i:j].tobytes()))
            for i, j in zip(edges, edges[1:]) if j > i]
    cols = list(zip(*rows)) or [()] * 7
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      ["range", "first", "dropped", "size", "step_width", "steps", "counts"])


def read_runs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a range with their sums."""
    hashes, sums = [], []
    for r in group.to_pylist():
        steps = np.concatenate([np.array([r["first"]], np.uint64), unpacked(r["step_width"], r["size"] - 1, r["steps"])])
        hashes.append(np.cumsum(steps, dtype=np.uint64) << np.uint64(r["dropped"]))
        sums.append(np.frombuffer(restored(r["counts"], r["size"]), np.uint8).astype(np.int64))
    return merged(np.concatenate(hashes), np.concatenate(sums))


def add_runs(group: pa.Table) -> pa.Table:
    """The hashes of a range whose sum is high enough."""
    h, a = read_runs(group)
    return pa.table({"hash": pa.array(h[a >= LEAST].view(np.int64))})


def as_filter(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """The hashes as bits: the first so many bits of a hash are its place."""
    bits = min(max(16, (16 * hashes.count()).bit_length()), FILTER_BITS.bit_length() - 1)
    place = F.shiftrightunsigned("hash", 48 - bits)
    slots = (hashes.select(F.shiftrightunsigned(place, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {48 - bits}) & 63 as int))").alias("bit"))
             .groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << bits - 6, np.uint64)
    out[slots["slot"].to_numpy()] = slots["bit"].to_numpy().view(np.uint64)
    return bits, out


# --- phrases of a length

class Walk:
    """Phrases of a shard as intervals of both indexes; columns of word ids, one row per phrase."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.bwt, self.inverse = {"left": left, "right": right}, {}
        n = np.bincount(left)
        first = np.cumsum(n) - n
        self.columns, self.size = [np.arange(1, len(n))], n[1:]
        self.lo = {"left": first[1:], "right": first[1:]}

    def keep(self, rows: np.ndarray) -> None:
        self.columns, self.size = [c[rows] for c in self.columns], self.size[rows]
        self.lo = {side: x[rows] for side, x in self.lo.items()}  # none after the last word

    def rank(self, side: str, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where the words' own intervals stand after as many occurrences as there are before the rows."""
        if side not in self.inverse:
            self.inverse[side] = np.sort(self.bwt[side].astype(np.int64) << 32 | np.arange(len(self.bwt[side])))
        return np.searchsorted(self.inverse[side], word << 32 | row)

    def extend(self, side: str, last: bool) -> None:
        """Each phrase with each word that stands on its `side`; the intervals of the `last` ones are not needed."""
        other = "right" if side == "left" else "left"
        begin = np.cumsum(self.size) - self.size
        of = np.repeat(np.arange(len(self.size)), self.size)
        key = np.sort(of << 32 | self.bwt[side][np.arange(len(of)) + (self.lo[side] - begin)[of]])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        phrase, word = key[first] >> 32, key[first] & 0xFFFFFFFF
        words = word > 0
        first, size, phrase, word = first[words], size[words], phrase[words], word[words]
        if last:
            self.lo = {}
        else:
            # in the other index the words that sort before come first
            self.lo = {other: self.lo[other][phrase] + first - begin[phrase], side: self.rank(side, word, self.lo[side][phrase])}
        columns = [c[phrase] for c in self.columns]
        self.columns, self.size = ([word, *columns] if side == "left" else [*columns, word]), size


class Visit:
    """A walk through a shard under the filters known so far."""

    def __init__(self, row: dict, filters: dict[int, tuple[int, np.ndarray]]) -> None:
        self.langs, self.starts, self.filters = row["langs"], row["starts"], filters
        self.words = row["words"].split(b".") if row["words"] else []
        ends = [*self.starts[1:], len(self.words) + 1]
        self.hashes = np.concatenate([np.zeros(1, np.uint64), *(
            word_hashes(g, self.words[a - 1:b - 1]) for g, a, b in zip(self.langs, self.starts, ends))])
        self.walk = Walk(np.frombuffer(row["left"], np.int32), np.frombuffer(row["right"], np.int32))

    def hashed(self, columns: list[np.ndarray]) -> np.ndarray:
        return phrase_hashes([self.hashes[c] for c in columns])

    def passes(self, columns: list[np.ndarray]) -> np.ndarray:
        bits, there = self.filters[len(columns)]
        at = self.hashed(columns) >> np.uint64(48 - bits)
        return there[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1

    def lengths(self, n: int) -> Iterator[int]:
        """Stops at each length up to `n`, at its phrases whose parts pass, and goes on from those that pass themselves."""
        for length in range(1, n + 1):
            if length > 1:
                side = "left" if length % 2 else "right"
                self.walk.extend(side, length == n)
                # the part that holds the new word: without the word at the other end
                self.walk.keep(np.flatnonzero(self.passes(self.walk.columns[:-1] if side == "left" else self.walk.columns[1:])))
            if length in self.filters:
                self.walk.keep(np.flatnonzero(self.passes(self.walk.columns)))
            yield length

    def phrases(self, ranges: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.walk.size), CHUNK):
            columns = [c[at:at + CHUNK] for c in self.walk.columns]
            texts = [[self.words[i - 1] for i in c.tolist()] for c in columns]
            of = pa.array(np.searchsorted(self.starts, columns[0], "right") - 1, pa.int32())
            begin = (self.hashed(columns[:2]) >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(begin.view(np.int64)), pa.DictionaryArray.from_arrays(of, pa.array(self.langs, pa.string())).cast(pa.string()),
                 pa.array(list(map(b" ".join, zip(*texts))), pa.binary()),
                 pa.array(self.walk.size[at:at + CHUNK], pa.int64())], ["range", "lang", "phrase", "a"])


def frequent_hashes(shards: DataFrame, n: int, filters: dict[int, tuple[int, np.ndarray]], ranges: int, dropped: int) -> DataFrame:
    """Hashes of phrases of `n` words that may be frequent."""
    shipped = shards.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                visit = Visit(row, shipped.value)
                for _ in visit.lengths(n):
                    pass
                held.append((visit.hashed(visit.walk.columns), visit.walk.size))
                if sum(len(h) for h, _ in held) > HELD:
                    yield runs(*map(np.concatenate, zip(*held)), ranges, dropped)
                    held = []
        if held:
            yield runs(*map(np.concatenate, zip(*held)), ranges, dropped)

    sent = shards.mapInArrow(run, RUNS)
    return sent.groupBy("range").applyInArrow(add_runs, "hash long")


def summed(held: list[pa.RecordBatch]) -> pa.Table:
    """Each phrase once, with its sum."""
    sums = pa.Table.from_batches(held).group_by(["range", "lang", "phrase"]).aggregate([("a", "sum")])
    return sums.select(["range", "lang", "phrase", "a_sum"]).rename_columns(["range", "lang", "phrase", "a"])


def phrase_runs(sums: pa.Table) -> pa.RecordBatch:
    """The phrases of each range and language, sorted, with their counts."""
    sums = sums.sort_by([(c, "ascending") for c in ("range", "lang", "phrase")])
    phrases, langs = sums["phrase"].combine_chunks(), sums["lang"].combine_chunks()
    of, a, lang = sums["range"].to_numpy(), sums["a"].to_numpy(), langs.dictionary_encode().indices.to_numpy()
    edges = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(lang) != 0)) + 1).tolist(), len(a)]
    rows = []
    for i, j in zip(edges, edges[1:]):
        if j > i:
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), phrases.slice(i, j - i)), b"\n")[0].as_py()
            rows.append((int(of[i]), langs[i].as_py(), j - i, len(text), squeezed(text), *packed(a[i:j])))
    cols = list(zip(*rows)) or [()] * 7
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      ["range", "lang", "size", "text_size", "phrases", "count_width", "counts"])


def add_phrases(group: pa.Table) -> pa.Table:
    """The phrases of a range whose sum is high enough."""
    held = []
    for r in group.to_pylist():
        phrases = restored(r["phrases"], r["text_size"]).split(b"\n")
        held.append(pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(r["range"], pa.int64()), r["size"]), pa.repeat(pa.scalar(r["lang"], pa.string()), r["size"]),
             pa.array(phrases, pa.binary()), pa.array(unpacked(r["count_width"], r["size"], r["counts"]).view(np.int64))],
            ["range", "lang", "phrase", "a"]))
    sums = summed(held)
    sums = sums.filter(pc.greater_equal(sums["a"], LEAST))
    phrase = sums["phrase"].cast(pa.string())
    words = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
    return pa.table({"lang": sums["lang"], "phrase": phrase, "words": words, "a": sums["a"]})


def count_phrases(shards: DataFrame, filters: dict[int, tuple[int, np.ndarray]], ranges: int) -> DataFrame:
    """(lang, phrase, words, a): the frequent phrases of all lengths."""
    shipped = shards.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for row in batch.to_pylist():
                visit = Visit(row, shipped.value)
                for _ in visit.lengths(LONGEST):
                    held += visit.phrases(ranges)
                if sum(b.num_rows for b in held) > HELD:
                    sums = summed(held)
                    held = sums.to_batches()
                    if sums.num_rows > HELD // 2:
                        yield phrase_runs(sums)
                        held = []
        if held:
            yield phrase_runs(summed(held))

    return shards.mapInArrow(run, PHRASE_RUNS).groupBy("range").applyInArrow(add_phrases, "lang string, phrase string, words int, a long")


def frequent(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of the words and phrases found `LEAST` times, and (lang, n): all occurrences of words."""
    spark = docs.sparkSession
    with batches_of(spark, 1000):
        shards = stored(index(docs), "shards", LARGE_ROWS)
    sizes = stored(shards.select(F.explode(F.arrays_zip("langs", "sizes")).alias("e")).groupBy(F.col("e.langs").alias("lang"))
                   .agg(F.sum("e.sizes").alias("n")), "sizes")
    size = sizes.agg(F.sum("n")).first()[0] or 0
    ranges, shards = 1 + size // RANGE, shards.coalesce(max(spark.sparkContext.defaultParallelism, size // TASK))
    filters: dict[int, tuple[int, np.ndarray]] = {}
    with batches_of(spark, 1):
        for n in range(1, LONGEST + 1):
            filters[n] = as_filter(stored(frequent_hashes(shards, n, filters, ranges, dropped_bits(size, 5, 1)), f"hashes{n}"))
        return stored(count_phrases(shards, filters, 1 + size // PHRASE_RANGE), "phrases"), sizes


# --- scores

def span(words: Column, begin: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def cuts(candidates: DataFrame, every: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each candidate with its lowest cut.

    A word's count is asked for by all phrases that begin or end with it, so it stands there `SALTS` times, and each
    phrase asks one of them.
    """
    w, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    salt = lambda part, other: F.when(F.contains(part, F.lit(" ")), 0).otherwise(F.pmod(F.xxhash64(other), F.lit(SALTS))).cast("int")
    known = every.select("lang", F.col("phrase").alias("part"), F.col("a").alias("n"), F.explode(
        F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    cut = (candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
           .select("lang", "a", "k", span(w, 1, F.col("k")).alias("x"), span(w, F.col("k") + 1, n - F.col("k")).alias("y")))
    asked = lambda part, count: known.select("lang", F.col("part").alias(part), "salt", F.col("n").alias(count))
    scored = (cut.withColumn("salt", salt(F.col("x"), F.col("y"))).join(asked("x", "l"), ["lang", "x", "salt"])
              .withColumn("salt", salt(F.col("y"), F.col("x"))).join(asked("y", "r"), ["lang", "y", "salt"])
              .withColumn("score", F.expr(
                  f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return (scored.groupBy("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a").agg(best)
            .select("lang", "phrase", "a", "b.l", "b.r", "b.score"))


def inside(every: DataFrame) -> DataFrame:
    """(lang, phrase, most): the highest count of a longer candidate that holds the phrase."""
    w, n = F.split("phrase", " "), F.col("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda size: F.transform(
        F.sequence(F.lit(1), n - size + 1), lambda begin: span(w, begin, size))))
    held = every.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a")
    return held.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def mine(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `TOP` collocations."""
    every, sizes = frequent(docs)
    candidates = every.where("words > 1").select("lang", "phrase", "a")
    free = candidates.join(inside(every), ["lang", "phrase"], "left").where(f"most is null or 100 * most < {INSIDE} * a").drop("most")
    scored = cuts(free, every)
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the first of each part hold the first of all, so no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = (scored.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
             .where(F.col("at") <= TOP))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= TOP)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
