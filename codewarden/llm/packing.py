"""Mixture-controlled packing: deficit round robin over source queues, in closed form.

A document is its token ids and one end id. The queue of a source holds its documents in the order of the input. Windows
of `WINDOW` sequences are filled to the target proportions: after k windows, queue j has given `floor(k * size * share)`
tokens, so what a window owes a queue, a fraction of a token, is carried to the next one, over all windows and
partitions. A queue that runs dry leaves its share to the others. Within a window the queues follow each other; the
stream of windows is cut into sequences without gaps, so only the last sequence is padded.

One pass writes the ids with each document's place in the queue of its partition; token sums per partition and source
then give every document its place in the stream, from which its pieces follow without another look at other documents.
Ids are neither shuffled nor sorted. Sources beyond the `QUEUES` - 1 largest share one queue, which bounds what is sent
to the tasks. By default the targets are the shares of the input.

Nulls: a null text is empty and gives the end id alone; a null source is the empty name; null ids are kept. Equal rows
are packed once each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.llm.common import stored

SEQUENCE, WINDOW, END, QUEUES, CACHE = 2048, 16, 1, 4096, 300_000
VOCABULARY = "byte_bpe_50k.tiktoken"
REST = "\x00"
#: White space next to a blank may join it in one token; such texts are encoded as a whole.
JOINED = re.compile(r"\s\x20|\x20\s")


class Encoder:
    """Token ids of whole texts as unsigned 16-bit numbers: those of `tokenizers` with the byte-level vocabulary.

    The same vocabulary as ranks lets tiktoken give the same ids in a fraction of the time; tests hold the two against
    each other. A blank starts a token, so what stands between blanks is encoded once and remembered; texts where white
    space meets a blank are encoded as a whole.
    """

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("H", self.coder.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if JOINED.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        pieces = self.pieces
        if len(pieces) > CACHE:
            pieces.clear()
        for p in set(rest).difference(pieces):
            pieces[p] = self._whole(" " + p)
        return self._whole(first) + b"".join([pieces[p] for p in rest])


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n, block, place, ids): the written ids; `place` is the start in the block's queue of the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
        end = np.array([END], "<u2").tobytes()
        block, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [(encoder.encode(t) if t else b"") + end for t in part["text"].to_pylist()]
                sizes, places = [len(x) // 2 for x in ids], []
                for source, n in zip(part["source"].to_pylist(), sizes):
                    places.append(given.get(source, 0))
                    given[source] = places[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["source"], pa.array(sizes, pa.int64()), pa.array([block] * len(ids), pa.int32()),
                     pa.array(places, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "n", "block", "place", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return stored(rows.mapInArrow(run, f"doc_id {kind}, source string, n long, block int, place long, ids binary"), "tokens")


class Schedule:
    """How much each queue has given after k windows."""

    def __init__(self, totals: list[int], weights: list[int], size: int) -> None:
        self.totals, self.weights, self.size = totals, weights, size
        # phases: (start in the stream, given so far, weight of the queues that still give)
        self.phases: list[tuple[int, list[int], int]] = []
        at, given = 0, [0] * len(totals)
        while any(g < t for g, t in zip(given, totals)):
            active = [j for j, t in enumerate(totals) if given[j] < t]
            weight = sum(weights[j] for j in active)
            self.phases.append((at, given, weight))
            # until the first of the queues runs dry
            step = min(-(-(totals[j] - given[j]) * weight // weights[j]) for j in active)
            at, given = at + step, self._after(given, step, weight)
        self.starts = [p[0] for p in self.phases]
        self.windows = -(-at // size)
        self.given = lru_cache(4096)(self._given)

    def _after(self, given: list[int], step: int, weight: int) -> list[int]:
        return [min(t, g + step * w // weight) for g, t, w in zip(given, self.totals, self.weights)]

    def _given(self, k: int) -> tuple[list[int], list[int], int]:
        """After k windows: what each queue gave, the sums over the queues before it, and the sum of all."""
        if k >= self.windows:
            given = self.totals
        else:
            at, base, weight = self.phases[bisect_right(self.starts, k * self.size) - 1]
            given = self._after(base, k * self.size - at, weight)
        sums = [0]
        for g in given:
            sums.append(sums[-1] + g)
        return given, sums, sums[-1]

    def one(self, j: int, k: int) -> int:
        return self.given(k)[0][j]

    def pieces(self, j: int, a: int, b: int) -> Iterator[tuple[int, int]]:
        """(place in the stream, length) of tokens a to b of queue j, in order, cut at windows and sequences."""
        low, high = 0, self.windows
        while high - low > 1:  # the window that holds a
            mid = (low + high) // 2
            low, high = (mid, high) if self.one(j, mid) <= a else (low, mid)
        while a < b:
            given, sums, before = self.given(low)
            then, then_sums, _ = self.given(low + 1)
            stop = min(b, then[j])
            place = before + then_sums[j] - sums[j] + a - given[j]
            while a < stop:
                n = min(stop - a, SEQUENCE - place % SEQUENCE)
                yield place, n
                a, place = a + n, place + n
            low += 1


def pack(docs: DataFrame, targets: dict[str, float] | None = None, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, the ids."""
    stream = tokens(docs, path)
    sums = stored(stream.groupBy("source", "block").agg(F.sum("n").alias("n")), "sums")
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    large = totals.orderBy(F.desc("n"), "source").limit(QUEUES).collect()
    names = sorted(r["source"] for r in (large if len(large) < QUEUES else large[:-1]))
    queue = F.when(F.col("source").isin(names), F.col("source")).otherwise(REST) if len(large) == QUEUES else F.col("source")
    # places of the blocks in their queues: one small row per block and source
    order = Window.partitionBy("queue").orderBy("source", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sums.withColumn("queue", queue).withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)))
                   .select("source", "block", "queue", "base"), "bases")
    held = {r["queue"]: r["n"] for r in sums.withColumn("queue", queue).groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    queues = sorted(held)
    weights = [held[q] if targets is None else max(1, round(targets.get(q, 0) * 1_000_000)) for q in queues]
    shipped = docs.sparkSession.sparkContext.broadcast((queues, [held[q] for q in queues], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, totals, weights = shipped.value
        schedule, number = Schedule(totals, weights, WINDOW * SEQUENCE), {q: i for i, q in enumerate(names)}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, which = [], []
                for i, (q, n, place, base, ids) in enumerate(zip(*(part[c].to_pylist() for c in ("queue", "n", "place", "base", "ids")))):
                    wide, start = np.frombuffer(ids, "<u2").astype("<u4").tobytes(), 0
                    for stream_at, length in schedule.pieces(number[q], base + place, base + place + n):
                        piece = wide[4 * start:4 * (start + length)]
                        rows.append((start, length, zlib.crc32(piece), n, stream_at // SEQUENCE, stream_at % SEQUENCE,
                                     *([piece] if with_ids else [])))
                        which.append(i)
                        start += length
                columns = list(zip(*rows))
                take = pa.array(which, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(take), part["source"].take(take), *[pa.array(c, pa.int64()) for c in columns[:6]],
                     *[pa.array(c, pa.binary()) for c in columns[6:]]], fields)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"`{f}` " + {"doc_id": kind, "source": "string", "ids": "binary"}.get(f, "long") for f in fields)
    return stream.join(bases, ["source", "block"]).select("doc_id", "source", "queue", "n", "place", "base", "ids").mapInArrow(run, schema)
