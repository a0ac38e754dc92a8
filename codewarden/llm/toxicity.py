"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases and maps homoglyphs and digit substitutions to letters, one character to one, so spans stay. Terms
are whole words or word beginnings; their weight is the log odds of a toxic to a clean document. Of the terms that fit
well, a greedy cover keeps the fewest that explain each toxic document `COVER` times. Matches inside an exception phrase
do not count: phrases of two or three words that hold a term and stand in `LEAST_DOCS` clean documents of the sample but in
no toxic one, and those given. The sum of weights is divided by the logarithm of the number of words and calibrated by a logistic curve.

Fitting uses a sample of at most `SAMPLE` labelled rows, the smallest by a hash of the id; every text is scored.
Nulls: a null text is empty and gets the score of a text without matches; a null label or id is not learned from; of
several labels of an id the largest counts. Repeated rows are scored one by one, and an empty table gives an empty
result. Without labels of both kinds there is no lexicon and every score is 0. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, TERMS, COVER, LEAST_DOCS, LEAST_WEIGHT = 20_000, 20_000, 3, 5, 3.5
PREFIXES, THRESHOLD = range(4, 9), 0.7

#: Characters that stand for Latin letters.
HOMOGLYPHS = ("аa", "еe", "оo", "рp", "сc", "уy", "хx", "іi", "ѕs", "ԁd", "αa", "εe", "ιi", "κk", "νv", "οo", "ρp", "τt",
              "υu", "ıi", "０o", "@a", "$s")
DIGITS = ("0o", "1i", "3e", "4a", "5s", "7t")
WORD = re.compile(r"[^\W\d_](?:[^\W_]|[@$])*|[0-9](?=[^\W\d_])(?:[^\W_]|[@$])*")
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # a whole word ends with a blank
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    offset: float = -40.0


def fold_text(text: str) -> str:
    table = {ord(x[0]): x[1] for x in (*HOMOGLYPHS, *DIGITS)}
    table |= {0xFF41 + k: chr(97 + k) for k in range(26)}  # full-width letters
    return text.lower().translate(table)


def flat(folded: str) -> str:
    """Folded text with blanks for line breaks and tabs, one for one."""
    return folded.translate({9: " ", 10: " ", 13: " "})


def phrases_of(text: str, terms: set[str]) -> set[str]:
    """The phrases of two or three words, one blank between them, that hold a term."""
    line = flat(fold_text(text))
    words = list(WORD.finditer(line))
    out = set()
    for i, m in enumerate(words):
        w = m[0]
        if w + " " in terms or any(w[:k] in terms for k in PREFIXES if len(w) >= k):
            for size in (2, 3):
                for first in range(max(0, i - size + 1), min(i, len(words) - size) + 1):
                    phrase = line[words[first].start():words[first + size - 1].end()]
                    if phrase == " ".join(x[0] for x in words[first:first + size]):
                        out.add(phrase)
    return out


def terms_of(text: str) -> set[str]:
    """The words of a text (marked by a final blank) and their beginnings."""
    words = set(WORD.findall(fold_text(text)))
    return {w + " " for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) >= k}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                          pa.array([seen[0][k] for k in keys], pa.int64())], ["term", "bad", "good"])
        seen[0].clear()
        seen[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            seen[toxic].update(terms_of(text or ""))
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield flush()
    yield flush()


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the sample; the labels are few by their bound, so no text is shuffled."""
    few = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def cover(texts: list[set[str]], weights: dict[str, float]) -> list[str]:
    """Greedy: the fewest terms so that each set holds `COVER` of them, where it has as many."""
    where: dict[str, list[int]] = {}
    for i, terms in enumerate(texts):
        for t in terms:
            where.setdefault(t, []).append(i)
    need, chosen = [COVER] * len(texts), []
    order = lambda t: (sum(need[i] > 0 for i in where[t]), t.endswith(" "), len(t), t)
    gain = {t: order(t) for t in where}
    while gain:
        best = max(gain, key=lambda t: gain[t])
        now = order(best)
        if now < gain[best]:  # an old figure: put it right and look again
            gain[best] = now
            if now[0] < LEAST_DOCS:
                del gain[best]
            continue
        if now[0] < LEAST_DOCS:
            break
        chosen.append(best)
        del gain[best]
        # a term that says the same as the chosen one covers nothing more
        for t in [t for t in gain if t.rstrip().startswith(best.rstrip()) or best.startswith(t.rstrip())]:
            del gain[t]
        for i in where[best]:
            need[i] -= 1
    return chosen


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Model:
    spark = docs.sparkSession
    rows = sample(docs, labels)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n0 or not n1:
        return Model()
    odds = F.log((F.col("bad") + 0.5) / (n1 + 1)) - F.log((F.col("good") + 0.5) / (n0 + 1))
    least = min(LEAST_DOCS, max(1, n1 // 20))
    counted = (rows.select("text", F.col("toxic").cast("int").alias("toxic"))
               .mapInArrow(_count_terms, "term string, bad long, good long")
               .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    best = (counted.where(F.col("bad") >= least).withColumn("weight", odds).where(F.col("weight") >= LEAST_WEIGHT)
            .orderBy(F.desc("bad"), "term").limit(TERMS).collect())
    weights = spark.sparkContext.broadcast({r["term"]: r["weight"] for r in best})

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value.keys()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([list(terms_of(t or "") & known) for t in batch["text"].to_pylist()],
                                                       pa.list_(pa.string()))], ["terms"])

    toxic = rows.where("toxic = 1").select("text").mapInArrow(present, "terms array<string>").collect()
    chosen = cover([set(r["terms"]) for r in toxic], weights.value)
    excused = _learned_exceptions(rows, set(chosen), min(LEAST_DOCS, max(2, n0 // 20)))
    model = Model({t: weights.value[t] for t in chosen}, (*(flat(fold_text(x)) for x in exceptions), *excused))
    scored = score(rows.select("doc_id", "text", "toxic"), model, keep=("toxic",)).select("raw", "toxic").collect()
    model.slope, model.offset = _logistic(np.array([r["raw"] for r in scored]), np.array([r["toxic"] for r in scored]))
    return model


def _learned_exceptions(rows: DataFrame, terms: set[str], least: int) -> list[str]:
    """Phrases with a term in at least so many clean documents and in no toxic one; longer ones that hold such add nothing."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, t) for text, t in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()) for p in phrases_of(text or "", terms)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32())],
                                             ["phrase", "toxic"])

    counted = (rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "phrase string, toxic int")
               .groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(f"bad = 0 and n >= {least}"))
    phrases = {r["phrase"] for r in counted.collect()}
    inner = lambda p: [" ".join(w) for w in zip(p.split(" "), p.split(" ")[1:])] if p.count(" ") > 1 else []
    return sorted(p for p in phrases if not any(x in phrases for x in inner(p)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's steps with a small ridge."""
    data, at = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ at, -30, 30)))
        h = (data * (p * (1 - p))[:, None]).T @ data + ridge * np.eye(2)
        at = at - np.clip(np.linalg.solve(h, data.T @ (p - y) + ridge * at), -2, 2)
    return float(at[0]), float(at[1])


def _scorer(lexicon: dict[str, float], exceptions: tuple[str, ...]):
    """The sum of the weights in a text over the logarithm of its length."""
    import ahocorasick

    machine, excused = ahocorasick.Automaton(), ahocorasick.Automaton()
    for t, w in lexicon.items():
        key = t.rstrip()
        machine.add_word(key, (len(key), *(machine.get(key, (0,))[1:]), (t.endswith(" "), w)))
    for phrase in exceptions:
        excused.add_word(phrase, len(phrase))
    for a in (machine, excused):
        if len(a):
            a.make_automaton()

    def raw(text: str | None) -> float:
        if not text or not len(machine):
            return 0.0
        folded = fold_text(text)
        free = [(end + 1 - n, end + 1) for end, n in excused.iter(flat(folded))] if len(excused) else []
        free = [(a, b) for a, b in free if not folded[a - 1:a].isalnum() and not folded[b:b + 1].isalnum()]
        total, last = 0.0, len(folded)
        for end, (n, *entries) in machine.iter(folded):
            start, stop = end + 1 - n, end + 1
            if start and folded[start - 1].isalnum():
                continue
            if len(text) == last and not LETTER.search(text[start:stop]):
                continue  # digits alone are a number
            if any(a <= start and stop <= b for a, b in free):
                continue
            total += sum(w for whole, w in entries if not (whole and stop < last and folded[stop].isalnum()))
        return total / math.log2(2 + text.count(" ") + text.count("\n"))

    return raw


def _each(docs: DataFrame, model: Model, step, schema) -> DataFrame:
    """`step` of each batch of `docs`, with the raw sums and the scores of its texts."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.terms, model.exceptions, model.slope, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, exceptions, slope, offset = shipped.value
        raw = _scorer(lexicon, exceptions)
        for batch in batches:
            raws = np.array([raw(t) for t in batch["text"].to_pylist()], float)
            yield step(batch, raws, 1 / (1 + np.exp(-np.clip(slope * raws + offset, -40, 40))))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep.., raw, score): the lexicon's verdict on every text."""
    def step(batch: pa.RecordBatch, raws: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["doc_id"], *[batch[k] for k in keep], pa.array(raws, pa.float64()),
                                           pa.array(scores, pa.float64())], ["doc_id", *keep, "raw", "score"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in ("doc_id", *keep)), "raw double", "score double"])
    return _each(docs.select("doc_id", "text", *keep), model, step, schema)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    def step(batch: pa.RecordBatch, raws: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(scores < threshold))

    return _each(docs, model, step, docs.schema)
