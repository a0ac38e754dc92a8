"""Benchmark decontamination: rare n-gram seeds join passages to items, then Smith-Waterman alignment.

How rare an n-gram of the benchmark is, is the number of different neighbours (the word before and the word after) it has in
all documents and items: a copied passage always brings the same ones, however often it is copied, while a common phrase
has many. Seeds of an item are its n-grams with at most `RARE` neighbours, or no more than three quarters of all n-grams
of the benchmark have, or no more than the lower quartile of the item's own. Where `CLOSE` n-grams of the benchmark lie within
`REACH` words and none is a seed, the rarest one counts as seed, so a passage that was copied with many different edits is not
left out. A common phrase on its own costs a text nothing.

Documents are read twice, for any number of items: once for the neighbours of n-grams that pass a filter of the
benchmark's, once for the passages around seeds, as far as items of that size reach. Filters have at most `FILTER_BITS`
bits; what they let through in error meets nothing in the joins. Passages join seeds by n-gram, then items, both
salted, so that no passage in a third of the documents ends in one task. The words that passage and item share bound the score; what
can reach `LEAST` is aligned word by word (match 2, other word -1, gap -1). The score is the best local alignment over
that of a full copy; from `LEAST` on the document is contaminated.

A verdict belongs to the text: equal texts are aligned once, known by 128 bits. `clean` sends only documents through a join that
pass a filter of the contaminated texts. Words are lower-case, without marks at their ends. Nulls: a null text has no
words; items that are null or shorter than `WIDTH` words have no seeds and are never matched. Equal items match alike, and of
equal scores the first passage is given; repeated documents each get their rows, an empty table on either side gives no
matches, a very long text is read whole, and other columns are kept by `clean` and not read by `matches`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import stored

WIDTH, RARE, LEAST, CLOSE, REACH, SALTS = 4, 4, 0.5, 4, 24, 16
FILTER_BITS, PROBES = 28, 6
PORTION = 1 << 18
MATCH, OTHER, GAP = 2, -1, -1
MARKS = ".,;:!?()[]{}<>\"'`*_|~-"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: White space as `str.split` knows it: in ASCII, and beyond.
SPACES = [i for i in range(128) if chr(i).isspace()]
WIDE_SPACE = re.compile(f"[{''.join(c for c in map(chr, range(128, 1 << 16)) if c.isspace())}]")
CUT = re.compile(rb"\s")
TEXT = ("t1", "t2")


def words(text: str | None) -> list[str]:
    return [w for w in (p.strip(MARKS) for p in (text or "").lower().split()) if w]


# --- n-grams

class Hashes:
    """Odd hashes of the words of texts, from all their bytes at once: sums of powers, of which a word takes its share.

    Equal words have equal hashes. Two words may share one by chance; what meets by them is aligned by its words.
    """

    def __init__(self) -> None:
        byte = np.arange(256, dtype=np.uint8)
        self.value = mixed([np.arange(1, 257, dtype=np.uint64)])
        self.space, self.mark = np.isin(byte, SPACES), np.isin(byte, np.frombuffer(MARKS.encode(), np.uint8))
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.power):
            self.power, self.inverse = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, f, np.uint64))]) for f in (FACTOR, BACK))

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words begin, without the marks at their ends, and their hashes."""
        x = np.frombuffer(data, np.uint8)
        self.grow(len(x))
        space = self.space[x]
        inner = np.flatnonzero(~(space | self.mark[x]))
        if not len(inner):
            return inner, np.zeros(0, np.uint64)
        of = np.cumsum(space, dtype=np.int32)[inner]
        new = np.flatnonzero(of[1:] != of[:-1])
        first, last = inner[np.append(0, new + 1)], inner[np.append(new, len(inner) - 1)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[x] * self.power[:len(x)])])
        return first, mixed([(sums[last + 1] - sums[first]) * self.inverse[first]]) | np.uint64(1)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same of any length, in blocks that end between two words."""
        begins, codes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(data):
            cut = CUT.search(data, at + PORTION)
            end = cut.end() if cut else len(data)
            first, code = self.block(data[at:end])
            begins.append(first + at)
            codes.append(code)
            at = end
        return np.concatenate(begins), np.concatenate(codes)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * FACTOR
        h ^= h >> np.uint64(29)
    return h * FACTOR


def grams(texts: list[str | None], known: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram at each place of the texts' `words` in a row, the place where each text begins, and the words around the places.

    Ends of texts are words too, of hash 0, so n-grams across them are in no item.
    """
    data = [WIDE_SPACE.sub(" ", (t or "").lower()).encode("utf-8", "surrogatepass") for t in texts]
    begin, code = known.of(b" ".join(data))
    of = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), begin, "right")
    h = np.zeros(1 + len(code) + len(texts), np.uint64)
    h[1 + np.arange(len(code)) + of] = code
    n = max(0, len(h) - WIDTH - 1)
    return mixed([h[k + 1:n + k + 1] for k in range(WIDTH)]), np.flatnonzero(h == 0)[:-1], h


def neighbours(around: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed([around[at], around[at + WIDTH + 1]])


def portions(texts: list[str | None]) -> Iterator[slice]:
    """Ranges of about `PORTION` characters."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= PORTION or k == len(texts) - 1:
            yield slice(begin, k + 1)
            begin, held = k + 1, 0


def shifts(bits: int) -> list[int]:
    """Where in a code its places in a filter begin."""
    return [k * (64 - bits) // (PROBES - 1) for k in range(PROBES)]


def as_filter(codes: DataFrame) -> tuple[int, np.ndarray]:
    """The column `gram` as bits: each is known by several parts of its code."""
    bits = min(max(16, (32 * codes.count()).bit_length()), FILTER_BITS)
    mask = (1 << bits) - 1
    places = F.explode(F.array(*(F.shiftrightunsigned("gram", k).bitwiseAND(mask) for k in shifts(bits)))).alias("place")
    slots = (codes.select(places).select(F.shiftrightunsigned("place", 6).alias("slot"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
             .groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << bits - 6, np.uint64)
    out[slots["slot"].to_numpy()] = slots["bit"].to_numpy().view(np.uint64)
    return bits, out


def passes(code: np.ndarray, known: tuple[int, np.ndarray]) -> np.ndarray:
    """The places that the filter lets through."""
    bits, there = known
    at = np.arange(len(code))
    for k in shifts(bits):
        x = code[at] >> np.uint64(k) & np.uint64((1 << bits) - 1)
        at = at[there[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1) == 1]
        if not len(at):
            break
    return at


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


# --- seeds

def item_grams(items: DataFrame) -> DataFrame:
    """(item, words, size, gram, context): the n-grams of each different text of an item; `size` is a power of two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            for text in batch["text"].to_pylist():
                w = words(text)
                code, _, around = grams([text], known)
                if len(code):
                    item = int.from_bytes(hashlib.blake2b("\n".join(w).encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item], pa.int64()), pa.array([w], pa.list_(pa.string())), pa.array([len(w).bit_length()], pa.int32()),
                         pa.array([code.view(np.int64)], pa.list_(pa.int64())),
                         pa.array([neighbours(around, np.arange(len(code))).view(np.int64)], pa.list_(pa.int64())), pa.array([text], pa.string())],
                        ["item", "words", "size", "grams", "contexts", "text"])

    kind = "item long, words array<string>, size int, grams array<long>, contexts array<long>, text string"
    return items.select("text").where("text is not null").distinct().mapInArrow(run, kind)


def found_contexts(docs: DataFrame, known: tuple[int, np.ndarray]) -> DataFrame:
    """(gram, context): each n-gram of the benchmark in the documents with its neighbours."""
    shipped = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(), []
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in portions(texts):
                code, _, around = grams(texts[part], hashes)
                at = passes(code, shipped.value)
                held.append((code[at], neighbours(around, at)))
            if held:
                code, context = map(np.concatenate, zip(*held))
                _, first = np.unique(mixed([code, context]), return_index=True)
                yield pa.RecordBatch.from_arrays([long(code[first]), long(context[first])], ["gram", "context"])
                held = []

    return docs.select("text").mapInArrow(run, "gram long, context long")


def rarity(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(gram, item, size, n, seed): the n-grams of the items with their neighbours, and whether they are seeds."""
    places = own.select("item", "size", F.explode(F.arrays_zip("grams", "contexts")).alias("g")).select("item", "size", "g.*")
    of_item = places.select("item", "size", F.col("grams").alias("gram")).distinct()
    in_items = places.select(F.col("grams").alias("gram"), F.col("contexts").alias("context"))
    seen = found_contexts(docs, as_filter(in_items.select("gram").distinct()))
    n = seen.union(in_items).distinct().groupBy("gram").agg(F.count("*").alias("n"))
    counted = stored(of_item.join(n, "gram"), "grams")
    usual = counted.select("gram", "n").distinct().agg(F.percentile("n", 0.75)).first()[0] or 0
    of = counted.groupBy("item").agg(F.percentile("n", 0.25).alias("quartile"))
    return stored(counted.join(of, "item").select(
        "gram", "item", "size", "n", (F.col("n") <= F.greatest(F.lit(float(RARE)), F.lit(float(usual)), "quartile")).alias("seed")), "seeds")


# --- passages

def around_seeds(key: tuple, w: list[str], code: np.ndarray, hits: np.ndarray, rare: dict, own: dict) -> list[tuple]:
    """The passages of a text around its seeds and its stretches of close n-grams, for each size of items."""
    rows = []
    for size in own:
        at = hits[passes(code[hits], own[size])]
        start = np.zeros(len(at), bool)
        start[passes(code[at], rare[size])] = True
        dense = np.flatnonzero(at[CLOSE - 1:] - at[:max(0, len(at) - CLOSE + 1)] <= REACH)
        close = np.zeros(len(at), bool)
        close[(dense[:, None] + np.arange(CLOSE)).ravel()] = True
        start |= close
        reach, stop, begin, stretch = 3 << size - 1, -1, 0, False
        for p, c in [*zip(at[start].tolist(), close[start].tolist()), (None, False)]:
            if p is not None and p - reach <= stop:
                stop, stretch = p + WIDTH + reach, stretch or c
                continue
            if stop >= 0:
                inner = at[np.searchsorted(at, begin):np.searchsorted(at, stop)]
                rows.append((*key, size, begin, stretch, w[begin:stop], np.unique(code[inner]).view(np.int64)))
            if p is not None:
                begin, stop, stretch = max(0, p - reach), p + WIDTH + reach, c
    return rows


def passages(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(t1, t2, size, start, stretch, words, grams): for each size of items the passages that may hold one.

    `stretch` says whether one holds a stretch of close n-grams.
    """
    sizes = [r["size"] for r in seeds.select("size").distinct().orderBy("size").collect()]
    every = as_filter(seeds.select("gram").distinct())
    rare = {z: as_filter(seeds.where(F.col("seed") & (F.col("size") == z)).select("gram").distinct()) for z in sizes}
    own = {z: as_filter(seeds.where(F.col("size") == z).select("gram").distinct()) for z in sizes}
    shipped = docs.sparkSession.sparkContext.broadcast((every, rare, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, rare, own = shipped.value
        known = Hashes()
        for batch in batches:
            rows, texts, keys = [], batch["text"].to_pylist(), list(zip(*(batch[c].to_pylist() for c in TEXT)))
            for part in portions(texts):
                codes, starts, _ = grams(texts[part], known)
                there = passes(codes, every)
                of = np.searchsorted(starts, there, "right") - 1
                for i in np.unique(of).tolist():
                    rows += around_seeds(keys[part][i], words(texts[part][i]), codes[starts[i]:], there[of == i] - starts[i], rare, own)
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64())))],
                    [*TEXT, "size", "start", "stretch", "words", "grams"])

    texts = docs.select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).where("text is not null")
    return texts.mapInArrow(run, "t1 long, t2 long, size int, start long, stretch boolean, words array<string>, grams array<long>")


def row_salt() -> Column:
    return F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)).cast("int").alias("salt")


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def pairs(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(t1, t2, size, start, item, n_seeds): passages with the items whose seeds they hold.

    One without seeds meets the items of its rarest n-gram if it has a stretch; else the filter of seeds let it in by error.
    """
    place = [*TEXT, "size", "start"]
    hits = found.select(*place, "stretch", F.explode("grams").alias("gram")).distinct().withColumn("salt", F.pmod("t1", F.lit(SALTS)).cast("int"))
    known = seeds.groupBy("gram", "size").agg(F.min("n").alias("n"), F.bool_or("seed").alias("seed"))
    known = hits.join(salted(known), ["gram", "size", "salt"])
    chosen = (known.groupBy(*place).agg(F.bool_or("seed").alias("any"), F.bool_or("stretch").alias("close"), F.min_by("gram", F.struct("n", "gram")).alias("rarest"))
              .join(known.select(*place, "salt", "gram"), place).where("any or close and gram = rarest"))
    return (chosen.join(salted(seeds.select("gram", "item", "size", "seed")), ["gram", "size", "salt"])
            .where("seed or not any").groupBy(*place, "item").agg(F.count("*").alias("n_seeds")))


# --- alignment

def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score and its end in the text. One row of the table at a time."""
    steps = np.arange(len(text) + 1) * -GAP
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for x in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(text == x, MATCH, OTHER), row[1:] + GAP)
        # a gap in the item: the best earlier cell less the steps to here
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def most(item: np.ndarray, text: np.ndarray) -> int:
    """No alignment scores more: the words that both have, in any order."""
    own, n = np.unique(item, return_counts=True)
    there, m = np.unique(text, return_counts=True)
    _, a, b = np.intersect1d(own, there, assume_unique=True, return_indices=True)
    return MATCH * int(np.minimum(n[a], m[b]).sum())


def best(item: list[str], passage: list[str], least: float) -> tuple[float, int, int]:
    """Score and words of the best place; what cannot reach the least score is not aligned."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    own = np.array([number[w] for w in item], np.int64)
    text = np.array([number.get(w, -1) for w in passage], np.int64)
    if most(own, text) < least * MATCH * len(own):
        return 0.0, 0, 0
    score, end = align(own, text)
    _, back = align(own[::-1], text[:end][::-1])
    return score / (MATCH * len(own)), end - back, end


def verdicts(docs: DataFrame, items: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, item, score, n_seeds, word_start, word_end) of texts and items that align well enough, and (item, text)."""
    own = stored(item_grams(items), "items")
    seeds = rarity(docs, own)
    found = stored(passages(docs, seeds), "passages")
    place = [*TEXT, "size", "start"]
    meet = (pairs(found, seeds).join(found.select(*place, F.col("words").alias("passage")).dropDuplicates(place), place)
            .withColumn("salt", F.pmod("t1", F.lit(SALTS)).cast("int"))
            .join(salted(own.select("item", "words").dropDuplicates(["item"])), ["item", "salt"])
            .select(*TEXT, "item", "n_seeds", "start", "words", "passage"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [best(i, p, least) for i, p in zip(batch["words"].to_pylist(), batch["passage"].to_pylist())]
            start = batch["start"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in (*TEXT, "item")), pa.array([s for s, _, _ in scores], pa.float64()), batch["n_seeds"],
                 *(long(start + np.array([s[k] for s in scores], np.int64)) for k in (1, 2))],
                [*TEXT, "item", "score", "n_seeds", "word_start", "word_end"])

    aligned = meet.mapInArrow(run, "t1 long, t2 long, item long, score double, n_seeds long, word_start long, word_end long")
    top = F.max_by(F.struct("score", "word_start", "word_end"), F.struct("score", -F.col("word_start"))).alias("b")
    out = aligned.where(F.col("score") >= least).groupBy(*TEXT, "item").agg(top, F.sum("n_seeds").alias("n_seeds"))
    return stored(out.select(*TEXT, "item", "b.score", "n_seeds", "b.word_start", "b.word_end"), "verdicts"), own.select("item", "text")


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, word_start, word_end) of each document and item that align well enough."""
    out, own = verdicts(docs, items, least)
    named = items.select("item_id", "text").join(own, "text").select("item_id", "item")
    rows = suspects(docs, out, ("doc_id",)).select("row.doc_id", *TEXT, row_salt())
    met = rows.join(salted(out), [*TEXT, "salt"])
    return met.join(salted(named), ["item", "salt"]).select("doc_id", "item_id", "score", "n_seeds", "word_start", "word_end")


def suspects(docs: DataFrame, out: DataFrame, columns: tuple[str, ...] = ("*",), other: bool = False) -> DataFrame:
    """(row, t1, t2): columns of the documents, with their text's key, that pass a filter of contaminated texts; or of the others."""
    known = docs.sparkSession.sparkContext.broadcast(as_filter(out.select(F.col("t1").alias("gram")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.zeros(batch.num_rows, bool)
            there[passes(batch["t1"].to_numpy().view(np.uint64), known.value)] = True
            yield batch.filter(pa.array(there != other))

    keyed = docs.select(F.struct(*columns).alias("row"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    return keyed.mapInArrow(run, keyed.schema)


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, all columns, that hold no passage of an item."""
    out, _ = verdicts(docs, items, least)
    bad = salted(out.select(*TEXT).distinct())
    kept = suspects(docs, out).withColumn("salt", row_salt()).join(bad, [*TEXT, "salt"], "left_anti")
    return suspects(docs, out, other=True).select("row.*").union(kept.select("row.*"))
