"""Divergence of sources by a frequent-pattern tree of term rows.

A kept term of a language is a row: its sources in order, each with its count. Equal rows are one with a multiplicity, and
the sorted rows are a frequent-pattern tree: a node is a run of rows that share a prefix. A pair of sources differs from
the value of a term that neither has by three corrections: one for each source's own counts, from a table of how many
terms have a count, and one for terms that both have, which each node gives once for itself and every ancestor, times the
terms below it. So no term meets a source that lacks it.

Rows meet by term, by row, and in sums per pair of sources. A share is `1 + floor(10^9 (count + 1) / (N + V))`, a value
`floor((p - q)^2 / q)`; all sums are whole numbers (38 digits in Spark, limbs of 21 bits in numpy).

Null text, language or source is the empty string, a group like others. A row is a document, also when its id repeats;
empty texts have no terms, but their group occurs. Very long texts are counted whole, in linear time. Ties rank by item,
in byte order. A language without kept terms has value 0 for every pair; a source alone in its language has no pair. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewarden.llm.common import stored

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: A task holds so many counts before it sends them; a piece of the tree has so many row entries at most, and one row.
HELD, PIECE = 400_000, 200_000
#: Bytes of terms stay, with A to Z lower-cased; all others separate.
TERMS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
LIMB, MASK = 21, (1 << 21) - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.string()),
                 pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        seen.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for lang, source, text in zip(*(part[c].to_pylist() for c in ("lang", "source", "text"))):
                words = text.encode("utf-8", "surrogatepass").translate(TERMS).split()
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in seen.values()) > HELD:
                yield from flush()
    yield from flush()


def terms(docs: DataFrame) -> DataFrame:
    """(lang, term, total, row): the kept terms, each with its sources in order and its counts there."""
    text = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = text.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    placed = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                                               F.sort_array(F.collect_list(F.struct("source", "n"))).alias("row"))
            .where(F.col("docs") >= LEAST_DOCS).drop("docs"))


def whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def share(n: str, size: str) -> Column:
    """1 + floor(10^9 (n + 1) / size); null for size 0."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20,0)) * cast({n} + 1 as decimal(18,0))) div nullif({size}, 0)")


def value(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, zero, v, lang_size) of every group: its denominator, the share of a term it lacks, and V."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.select("lang", F.explode("row").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    some = lambda c: F.coalesce(c, F.lit(0))
    return (groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", (some("n") + some("v")).alias("size"), some("v").alias("v"), (some("lang_n") + some("v")).alias("lang_size"))
            .withColumn("zero", share("0", "size")))


def _shared(code: np.ndarray, p: np.ndarray, z: np.ndarray, first: np.ndarray, m: np.ndarray) -> dict[tuple[int, int], int]:
    """What terms in both sources of a pair correct: the tree of sorted rows, walked level by level.

    `code`, `p` and `z` are the sources, shares and shares of absence of all entries, `first` where each row begins (and
    the end), `m` the rows' multiplicities.
    """
    n, length = len(m), np.diff(first)
    below = np.concatenate([[0], np.cumsum(m)])
    total: dict[tuple[int, int], int] = {}
    f = lambda a, b: (a - b) * (a - b) // b
    # how many first entries a row has in common with the one before it
    common = np.zeros(n, np.int64)
    alike = np.ones(n, bool)
    alike[0] = False
    for depth in range(int(length.max(initial=0))):
        rows = np.flatnonzero(alike)
        rows = rows[(length[rows] > depth) & (length[rows - 1] > depth)]
        a, b = first[rows] + depth, first[rows - 1] + depth
        rows = rows[(code[a] == code[b]) & (p[a] == p[b])]
        alike = np.zeros(n, bool)
        alike[rows] = True
        common[rows] += 1
    for depth in range(1, int(length.max(initial=0))):
        start = np.flatnonzero(common <= depth)  # a node of this depth begins where the prefix through it is new
        times = below[np.append(start[1:], n)] - below[start]
        deep = length[start] > depth
        node, times = first[start[deep]] + depth, times[deep]
        up = (node[:, None] - depth + np.arange(depth)).ravel()
        node, times = np.repeat(node, depth), np.repeat(times, depth)
        for s, t in ((up, node), (node, up)):
            d = f(p[s], p[t]) - f(p[s], z[t]) - f(z[s], p[t]) + f(z[s], z[t])
            pairs, at = np.unique(code[s].astype(np.int64) << 32 | code[t], return_inverse=True)
            # limbs times multiplicities stay below 2^53, so these sums of doubles are exact
            limbs = [np.bincount(at, x * times.astype(float)) for x in (d & MASK, d >> LIMB & MASK, d >> 2 * LIMB)]
            for k, pair in enumerate(pairs.tolist()):
                key = (pair >> 32, pair & 0xFFFFFFFF)
                total[key] = total.get(key, 0) + sum(int(x[k]) << LIMB * i for i, x in enumerate(limbs))
    return total


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, m, row) to corrections per pair of sources, a piece of the tree at a time."""
    found: dict[tuple[str, str, str], int] = {}

    def piece(lang: str, part: pa.RecordBatch) -> None:
        rows = part["row"]
        flat = rows.flatten()
        names = flat.field("source").dictionary_encode()
        first = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        m = part["m"].to_numpy(zero_copy_only=False)
        if int(m.sum()) >= 1 << 32:
            raise OverflowError("a piece of the tree stands for 2^32 terms or more")
        labels = names.dictionary.to_pylist()
        got = _shared(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("p").to_numpy(zero_copy_only=False),
                      flat.field("z").to_numpy(zero_copy_only=False), first, m)
        for (s, t), d in got.items():
            key = (lang, labels[s], labels[t])
            found[key] = found.get(key, 0) + d

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in found], pa.string()) for i in range(3)), pa.array([str(v) for v in found.values()], pa.string())],
            ["lang", "source", "item", "d"])
        found.clear()
        return out

    for batch in batches:
        langs = batch["lang"].to_pylist()
        ends = np.cumsum(batch["row"].value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            end = next((i for i in range(at + 1, end) if langs[i] != langs[at]), end)
            piece(langs[at], batch.slice(at, end - at))
            at = end
            if len(found) > HELD:
                yield flush()
    yield flush()


def pairs(kept: DataFrame, entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each group against each other source of its language."""
    rows = (entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("row")).where("size(row) > 1")
            .groupBy("lang", "row").agg(F.count("*").alias("m")))
    both = (rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
            .mapInArrow(_walk, "lang string, source string, item string, d string")
            .select("lang", "source", "item", whole(F.col("d")).alias("d")))
    side = lambda name, z: groups.select("lang", F.col("source").alias(name), F.col("zero").alias(z), "v")
    grid = side("source", "zs").join(side("item", "zt").drop("v"), "lang").where("source <> item")
    none = F.coalesce(whole(F.col("v")) * whole(value("zs", "zt")), F.lit(0)).alias("d")
    # terms by their share in a source: each corrects the pairs where that source is the group, and where it is the other
    table = entries.groupBy("lang", F.col("source"), "p").agg(F.count("*").alias("m"))
    alone = table.join(grid, ["lang", "source"])
    as_group = alone.select("lang", "source", "item", (whole(F.col("m")) * whole(value("p", "zt") - value("zs", "zt"))).alias("d"))
    as_other = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                            (whole(F.col("m")) * whole(value("zt", "p") - value("zt", "zs"))).alias("d"))
    parts = [grid.select("lang", "source", "item", none), as_group, as_other, both]
    total = parts[0]
    for x in parts[1:]:
        total = total.unionByName(x.withColumn("d", whole(F.col("d"))))
    return total.groupBy("lang", "source", "item").agg(F.sum("d").cast("long").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources, and each group's terms above its language's share."""
    kept = stored(terms(docs), "terms")
    groups = stored(sizes(docs, kept), "sizes")
    entries = (kept.select("lang", "term", "total", F.explode("row").alias("e")).select("lang", "term", "total", "e.source", "e.n")
               .join(groups, ["lang", "source"])
               .select("lang", "source", "term", share("n", "size").alias("p"), F.col("zero").alias("z"), share("total", "lang_size").alias("q")))
    entries = stored(entries, "entries")
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = (entries.where("p > q").select("lang", "source", F.col("term").alias("item"), value("p", "q").alias("value"))
             .withColumn("rank", rank()).where(F.col("rank") <= TOP))
    of_pairs = pairs(kept, entries, groups).withColumn("rank", rank())
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shape(of_pairs, "pair").unionByName(shape(above, "term"))
