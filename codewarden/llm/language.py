"""Language by word-first backoff.

A known word counts by its log frequency in each language. An unseen word counts by its character n-grams: the longest
order, from `ORDERS`, of which any is known. The sums of a text decide; the score is the winner's share after the sums
are scaled to at most `EVIDENCE` words.

The counts are fitted on a sample of about `PER_LANGUAGE` documents per language, chosen by a hash of the id, and the
model keeps at most `WORDS` words and `GRAMS` n-grams; every text is judged as a whole. Nulls: a null or empty text, or
one without letters, is `und` with score 0; rows without language or id are not learned from. Ties go to the smaller
language name. Without any learned language all are `und`; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import stored

PER_LANGUAGE, WORDS, GRAMS, LEAST_COUNT = 1_500, 60_000, 60_000, 3
ORDERS = (5, 4, 3, 2, 1)
EVIDENCE, CACHE = 30, 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out: Counter = Counter()
        for (lang, word), n in seen.items():
            out[lang, word + " "] += n
            for k in ORDERS:
                for g in grams(word, k):
                    out[lang, g] += n
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()),
                                           pa.array(list(out.values()), pa.int64())], ["lang", "unit", "n"])

    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            seen.update((lang, w) for w in LETTERS.findall((text or "").lower()))
            if len(seen) > 100_000:
                yield flush()
    yield flush()


def fit(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and the log frequency of each unit per language; a unit that ends with a blank is a word."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], {}
    share = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, PER_LANGUAGE / sizes[g]))])[F.col("lang")]
    taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    counted = taken.select("text", "lang").mapInArrow(_count, "lang string, unit string, n long").groupBy("lang", "unit").agg(
        F.sum("n").alias("n"))
    wide = stored(counted.groupBy("unit").agg(F.sum("n").alias("n"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("n") >= LEAST_COUNT), "units")
    top = lambda words, most: (wide.where(F.col("unit").endswith(" ") == words)
                               .orderBy(F.desc("n"), "unit").limit(most).collect())
    model: dict[str, np.ndarray] = {}
    for found in (top(True, WORDS), top(False, GRAMS)):
        counts = np.array([[r["by"].get(g, 0) for g in langs] for r in found], float).reshape(-1, len(langs)) + 0.05
        logs = np.log(counts / counts.sum(0)) if len(counts) else counts
        model |= {r["unit"]: x for r, x in zip(found, logs)}
    return langs, model


def predict(docs: DataFrame, langs: list[str], model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    shipped = docs.sparkSession.sparkContext.broadcast((langs, list(model), np.array(list(model.values()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units, known = shipped.value
        n_langs = len(names)
        rows = {u: i for i, u in enumerate(units)}
        # what stands between spaces -> its row: the sums of its words, and how many there are
        index, store = {}, np.zeros((CACHE, n_langs + 1))

        def backoff(word: str) -> np.ndarray | float:
            for n in ORDERS:
                hits = [rows[g] for g in grams(word, n) if g in rows]
                if hits:
                    return known[hits].sum(0) / len(hits)
            return 0.0

        def learn(piece: str) -> int:
            words = LETTERS.findall(piece)
            at = index[piece] = len(index)
            store[at] = 0
            for w in words:
                k = rows.get(w + " ")
                store[at, :n_langs] += backoff(w) if k is None else known[k]
            store[at, n_langs] = len(words)
            return at

        def judge(text: str | None) -> tuple[str, float]:
            pieces, total = text.lower().split() if text and names else [], np.zeros(n_langs + 1)
            for k in range(0, len(pieces), CACHE // 2):
                part = pieces[k:k + CACHE // 2]
                if len(index) + len(part) > CACHE:
                    index.clear()
                at = [index.get(p, -1) for p in part]
                if -1 in at:
                    at = [index[p] if p in index else learn(p) for p in part]
                total += store[at].sum(0)
            return verdict(total[:n_langs], int(total[n_langs])) if total[n_langs] else ("und", 0.0)

        def verdict(total: np.ndarray, n: int) -> tuple[str, float]:
            x = total * min(1.0, EVIDENCE / n)
            p = np.exp(x - x.max())
            k = int(p.argmax())
            return names[k], float(p[k] / p.sum())

        for batch in batches:
            out = [judge(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in out], pa.string()),
                                              pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
