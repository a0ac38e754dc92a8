"""Quality by naive Bayes support vectors.

A text is the set of its word n-grams (`ORDERS`), hashed into `BUCKETS`; words and runs of marks are tokens, letters A to Z
are lower-cased, line breaks count as a token. A bucket's log-count ratio is the logarithm of its share of the n-grams of
good texts over its share in bad ones, smoothed by `ALPHA`. Indicators scaled by these ratios, a row brought to length 1,
train a linear hinge-loss model by dual coordinate descent; the margins become scores by a logistic curve through those of
rows that the fold's model has not seen.

Fitting uses at most `SAMPLE` labelled rows, the smallest by a hash of the id, which bounds what the driver holds; every
text is scored as a whole, in time linear in its length. Nulls: a null text is empty, and empty texts get the score of the
model's offset; a null id or label is not learned from; of several labels of an id the largest counts. Repeated rows are
learned and scored one by one, equal texts get equal scores, and a margin of 0 counts as good. Without labels of both
kinds every score is the share of good labels (0.5 without any). An empty table gives an empty result, and other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, BUCKETS, ORDERS, ALPHA = 12_000, 1 << 20, (1, 2, 3), 1.0
COST, EPOCHS, GAP, FOLDS, THRESHOLD = 1.0, 20, 0.01, 3, 0.7
#: The smaller class weighs more, so that it is not outvoted, up to this factor.
BALANCE, CACHE = 4.0, 500_000
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|\n|[^\sa-z0-9\x80-\xff]+")
#: Odd factors, one per word of an n-gram.
FACTORS = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Hashes(dict):
    """token -> hash, computed when a token is new."""

    def __missing__(self, token: bytes) -> int:
        return self.setdefault(token, zlib.crc32(token) | 1 << 32)


@dataclass
class Model:
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))  # of the scaled indicators
    offset: float = 0.0
    slope: float = 0.0
    shift: float = 0.0


def indicators(text: str | None, hashes: Hashes) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    h = np.array([hashes[t] for t in TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())], np.uint64)
    if len(hashes) > CACHE:
        hashes.clear()
    found = [sum(h[k:len(h) - n + 1 + k] * FACTORS[k] for k in range(n)) * FACTORS[-n] for n in ORDERS if len(h) >= n]
    return np.unique(np.concatenate(found) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32) if found else np.zeros(0, np.int32)


def sample(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """(text, y) of the labelled sample; the labels are few by their bound, so no text is shuffled."""
    few = (labels.where(f"doc_id is not null and {target} in (0, 1)").groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y")


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log-count ratio per bucket."""
    share = []
    for side in (True, False):
        of_side = [r for r, g in zip(rows, good) if g == side]
        n = np.bincount(np.concatenate(of_side), minlength=BUCKETS) + ALPHA
        share.append(np.log(n / n.sum()))
    return (share[0] - share[1]).astype(np.float32)


def scaled(row: np.ndarray, r: np.ndarray) -> np.ndarray:
    x = r[row]
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def descend(rows: list[np.ndarray], xs: list[np.ndarray], good: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent: the weights, the offset and the dual variables.

    One dual variable a row, between 0 and its cost; each step solves for one of them. Ends when no projected gradient of
    a round is beyond `GAP`, or after `EPOCHS` rounds.
    """
    y = np.where(good, 1.0, -1.0)
    w, offset, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    square = np.array([float(x @ x) + 1.0 for x in xs])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, x, was = rows[i], xs[i], dual[i]
            slope = y[i] * (float(w[at] @ x) + offset) - 1.0
            now = min(max(was - slope / square[i], 0.0), cost[i])
            if now != was:
                worst = max(worst, min(abs(slope), abs(now - was) * square[i]))
                dual[i] = now
                w[at] += (now - was) * y[i] * x
                offset += (now - was) * y[i]
        if worst < GAP:
            break
    return w, offset, dual


def train(rows: list[np.ndarray], good: np.ndarray) -> Model:
    r = ratios(rows, good)
    share = good.mean()
    cost = COST * np.where(good, min(1.0, (1 - share) / share * BALANCE), min(1.0, share / (1 - share) * BALANCE))
    w, offset, _ = descend(rows, [scaled(x, r) for x in rows], good, cost)
    return Model(r, w.astype(np.float32), offset)


def margin(row: np.ndarray, model: Model) -> float:
    return float(scaled(row, model.ratios) @ model.weights[row]) + model.offset


def logistic(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margins to probabilities, by Newton's steps on slightly smoothed labels."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    data, at = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(data @ at, -30, 30)))
        h = (data * (p * (1 - p))[:, None]).T @ data + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, data.T @ (p - t) + 1e-3 * at)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 0.0), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """The model of `labels.target` (1 is good), from the sample."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = [indicators(t, hashes).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch["y"]], ["x", "y"])

    taken = sample(docs, labels, target).mapInArrow(encode, "x binary, y int").toArrow().sort_by([("x", "ascending"), ("y", "ascending")])
    rows = [np.frombuffer(x, np.int32) for x in taken["x"].to_pylist()]
    good = np.array(taken["y"].to_pylist(), int) == 1
    if not good.any() or good.all():
        share = min(max(float(good.mean()) if len(good) else 0.5, 1e-6), 1 - 1e-6)
        return Model(shift=float(np.log(share / (1 - share))))
    fold = np.random.default_rng(5).permutation(len(rows)) % FOLDS
    unseen = np.full(len(rows), np.nan)
    for k in range(FOLDS):
        inner = np.flatnonzero(fold != k)
        if good[inner].any() and not good[inner].all():
            part = train([rows[i] for i in inner], good[inner])
            unseen[fold == k] = [margin(rows[i], part) for i in np.flatnonzero(fold == k)]
    model = train(rows, good)
    # a fold without both kinds has no model: its rows are read by the whole one
    unseen = np.where(np.isnan(unseen), [margin(x, model) for x in rows], unseen)
    model.slope, model.shift = logistic(unseen, good)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, margin, score) of every text."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.ratios, model.weights, model.offset, model.slope, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = Hashes(), Model(*shipped.value)
        for batch in batches:
            margins = np.array([margin(indicators(t, hashes), m) for t in batch["text"].to_pylist()], float)
            scores = 1 / (1 + np.exp(-np.clip(m.slope * margins + m.shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(margins), pa.array(scores)], ["doc_id", "margin", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, margin double, score double")
