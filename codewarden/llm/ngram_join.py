"""N-gram Jaccard join over count vectors, down to groups of linked documents.

A document is the set of its distinct shingles of `width` words; two link if their sets' similarity is at least `least`, a
fraction as (above, below) the line. op7 takes 3 words and 0.9. Shingles are hashed into groups and a set becomes a point, its count per group. The overlap of two sets is at most the sum of the
smaller coordinates, and that of two boxes of points at most the sum of their smaller upper corners: a tree of boxes
over the points finds the pairs that may link, which are then verified on the sets.

A tree over all points cannot be held by one task, and low-dimensional boxes of it do not separate texts of like length.
Its top level is therefore exact instead of geometric: sets that link differ in at most D shingles, so if the shingles
are hashed into more than D groups, some group has the same members in both. Groups of equal members connect sets into
families; one tree is built per family, or per pair of blocks of a large family, so that no task holds more than two
blocks. D is taken for the largest size of a size band; sets near the next band are entered there as well.

Below a similarity of 0.9 these groups get so small that one common shingle connects families. There a set is entered by
its rarest shingles instead, as many as two sets that link cannot differ in: they share one of them. Any one order of the
shingles is exact; here they go by classes of how many documents hold them (`CLASSES`), counted over all documents as
sorted runs of 48-bit hashes and known to the tasks as one filter per class. A shingle of one document connects nothing and is
not entered. What a filter lets through in error is the same for all documents, so it costs time, not links.

Equal sets are one class and meet once, by their hash. Links inside what is already connected need no verification, as
the result is the connected groups; `links` are enough to connect every linked document.

Nulls: a null, empty or blank text has no set, links with nothing and is its own component; a null id stays and is never
the smallest of others. Repeated rows fall into one class. An empty table gives an empty result; other columns are not
read. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.llm.collocations import RANGE, RUNS, as_filter, read_runs, runs, tallied
from codewarden.llm.common import components, stored

WIDTH, LEAST, GROUPS, LEAF = 3, (9, 10), 64, 16
#: A block of a family: so many sets or shingles at most.
BLOCK_SETS, BLOCK_SHINGLES = 2_000, 2_000_000
#: Hashes that a task holds at most, and some texts' more, before it sends their counts.
HELD = 1_000_000
MASK = (1 << 64) - 1
#: Least documents of a shingle in each class; a class is one filter of at most 2^28 bits.
CLASSES = (2, 4, 16, 128)
#: Odd factors, one per word of a shingle.
FACTORS = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, so that group numbers and sums are as good as random."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes; bytes are lower-cased and split as the contract's letters and spaces are."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    if len(h) < width:
        return _mix(np.array([sum((k + 2) * int(x) for k, x in enumerate(h)) + len(h) & MASK], np.uint64), 7) if len(h) else h
    end = len(h) - width + 1
    return np.unique(_mix(sum(h[k:end + k] * f for k, f in enumerate(FACTORS[:width])), 1))


def bands(least: tuple[int, int] = LEAST) -> list[int]:
    """Lower ends of the size bands. Below the first one, sets of different members never link."""
    low = [-(-least[0] // (least[1] - least[0]))]
    while low[-1] < 1 << 40:
        low.append(-(-low[-1] * 3 // 2))
    return low


def signatures(h: np.ndarray, low: list[int], least: tuple[int, int] = LEAST) -> np.ndarray:
    """One number per group of shingles: two sets that may link share one of them."""
    (x, y), n, out = least, len(h), []
    b = int(np.searchsorted(low, n, "right")) - 1
    for band in ([b] if b >= 0 else []) + ([b + 1] if y * n >= x * low[b + 1] else []):
        differ = 2 * (low[band + 1] - 1) * (y - x) // (y + x)
        m = differ + 3 + differ // 10
        group = (_mix(h, 2) % np.uint64(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        which, first = np.unique(group[order], return_index=True)
        sums = np.add.reduceat(_mix(h, 3)[order], first)
        if len(which) <= differ:  # too few groups have members: empty ones count as well
            full = np.zeros(m, np.uint64)
            full[which] = sums
            which, sums = np.arange(m), full
        out.append(_mix(sums ^ _mix(which.astype(np.uint64) + np.uint64(band << 40), 4), 5))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def class_filters(docs: DataFrame, width: int) -> list[tuple[int, np.ndarray]]:
    """For each class the filter of the shingles that so many documents hold."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = 1 + chars // (8 * RANGE)

    def taken(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        held.clear()
        return runs(*tallied(h), ranges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held += [shingles(t, width) >> np.uint64(16) for t in batch["text"].slice(at, 500).to_pylist()]
                if sum(map(len, held)) > HELD:
                    yield taken(held)
        if held:
            yield taken(held)

    def add(group: pa.Table) -> pa.Table:
        h, n = read_runs(group)
        some = n >= CLASSES[0]
        return pa.table({"hash": pa.array(h[some].view(np.int64)), "n": pa.array(n[some])})

    counted = stored(docs.select("text").mapInArrow(count, RUNS).groupBy("range").applyInArrow(add, "hash long, n long"), "counted")
    return [as_filter(counted.where(F.col("n") >= least).select("hash")) for least in CLASSES]


def rarest(h: np.ndarray, low: list[int], least: tuple[int, int], filters: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The rarest shingles with the size band: two sets that may link share one of them."""
    (x, y), n = least, len(h)
    common = np.zeros(n, np.int64)
    for bits, there in filters:
        at = h >> np.uint64(64 - bits)
        common += (there[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(np.int64)
    order = np.lexsort((h, common))[:n - -(-x * n // y) + 1]
    first = h[order[common[order] > 0]]
    b = int(np.searchsorted(low, n, "right")) - 1
    in_bands = ([b] if b >= 0 else []) + ([b + 1] if y * n >= x * low[b + 1] else [])
    return np.concatenate([_mix(first, 11 + band) for band in in_bands]) if in_bands else np.zeros(0, np.uint64)


def sign(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, text_key, n, cls, node, sigs): cls is the 128-bit hash of the set, node its first half."""
    few = 10 * least[0] >= 9 * least[1]
    shipped = None if few else docs.sparkSession.sparkContext.broadcast(class_filters(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        low = bands(least)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t, width) for t in part["text"].to_pylist()]
                cls = [xxhash.xxh128_hexdigest(h.tobytes()) for h in sets]
                node = np.array([int(c[:16], 16) for c in cls], np.uint64).view(np.int64)
                sigs = [(signatures(h, low, least) if few else rarest(h, low, least, shipped.value)).view(np.int64) for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_key"], pa.array([len(h) for h in sets], pa.int64()), pa.array(cls), pa.array(node),
                     pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "cls", "node", "sigs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, text_key long, n long, cls string, node long, sigs array<long>"), "signed")


def families(signed: DataFrame) -> DataFrame:
    """(node, root): sets connected by groups with equal members."""
    nodes = stored(signed.where("size(sigs) > 0").select("node", "sigs").dropDuplicates(["node"]), "nodes")
    entered = nodes.select("node", F.explode("sigs").alias("sig"))
    # counted first, so that a group that very many sets share arrives as one row; the join splits such a group
    cells = entered.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    met = (entered.join(cells.select("sig", "lo"), "sig").where("node <> lo")
           .select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct())
    return stored(components(met), "families")


class Tree:
    """Leaves of like points with their upper corners; bounds of overlaps are sums of coordinate minima."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        n = np.array([len(h) for h in sets])
        counts = np.stack([np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=GROUPS) for h in sets]).astype(np.int32)
        self.order = np.lexsort((*counts.T[:4], n))
        self.counts, self.n = counts[self.order], n[self.order]
        starts = np.arange(0, len(n), LEAF)
        self.upper = np.maximum.reduceat(self.counts, starts)
        self.least, self.most = np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts)

    def search(self, counts: np.ndarray, n: int, least: tuple[int, int] = LEAST) -> np.ndarray:
        """Positions of the points whose set may have the least similarity with a set of these counts."""
        x, y = least
        fits = (y * self.most >= x * n) & (x * self.least <= y * n)
        leaves = np.flatnonzero(fits)
        bound = np.minimum(self.upper[leaves], counts).sum(1)
        leaves = leaves[(x + y) * bound >= x * (self.least[leaves] + n)]
        points = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        points = points[points < len(self.n)]
        bound = np.minimum(self.counts[points], counts).sum(1)
        return points[(x + y) * bound >= x * (self.n[points] + n)]


def linked(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    same = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return least[1] * same >= least[0] * (len(a) + len(b) - same)


def spanning_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
                   least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links between a set marked left and one marked right that connect all that such links connect."""
    if not len(sets):
        return []
    root, out = list(range(len(sets))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    targets = np.flatnonzero(right)
    tree = Tree([sets[i] for i in targets])
    for i in np.flatnonzero(left):
        counts = np.bincount((sets[i] >> np.uint64(58)).astype(np.int64), minlength=GROUPS)
        for p in tree.search(counts, len(sets[i]), least):
            j = int(targets[tree.order[p]])
            if find(i) != find(j) and linked(sets[i], sets[j], least):
                root[find(i)] = find(j)
                out.append((int(i), j))
    return out


def links(docs: DataFrame, signed: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """(a, b): classes that link, enough of them to connect all that link."""
    family = families(signed)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    whole = signed.join(family, "node").groupBy("cls").agg(F.min("root").alias("root"), F.max("n").alias("n"), one.alias("one"))
    whole = stored(whole, "members")
    sizes = whole.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
                                      .cast("int").alias("blocks"))
    members = stored(whole.join(sizes, "root").select("cls", "root", F.col("one.doc_id").alias("m_id"), F.col("one.text_key").alias("m_text"), "blocks",
                                                      F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block")), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingles(t, width).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("cls", "root", "blocks", "block")), pa.array(found, pa.binary())],
                                                 ["cls", "root", "blocks", "block", "set"])

    # one document stands for each class; of rows that repeat its id and text one stays
    same = F.xxhash64("text").eqNullSafe(F.col("m_text")) & F.col("doc_id").eqNullSafe(F.col("m_id"))
    texts = (docs.select("doc_id", "text").join(members, same)
             .select("cls", "root", "blocks", "block", "text").dropDuplicates(["cls"])
             .mapInArrow(sets, "cls string, root long, blocks int, block int, set binary"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = (texts.select("cls", "root", "block", "set", other)
             .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "set"))

    def compare(group: pa.Table) -> pa.Table:
        rows: dict[str, tuple[int, bytes]] = dict(zip(group["cls"].to_pylist(), zip(group["block"].to_pylist(), group["set"].to_pylist())))
        names = sorted(rows)
        block = np.array([rows[c][0] for c in names])
        found = spanning_links([np.frombuffer(rows[c][1], np.uint64) for c in names], block == block.min(), block == block.max(), least)
        return pa.table({"a": pa.array([names[i] for i, _ in found], pa.string()), "b": pa.array([names[j] for _, j in found], pa.string())})

    return stored(pairs.groupBy("root", "i", "j").applyInArrow(compare, "a string, b string"), "links")


def _grouped(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, text_key, n, grp) per document; grp is null without a set."""
    signed = sign(docs, width, least)
    roots = stored(components(links(docs, signed, width, least)), "roots").withColumnsRenamed({"node": "r_cls"})
    rows = signed.select("doc_id", "text_key", "n", "cls").join(roots, F.col("cls") == F.col("r_cls"), "left")
    return stored(rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("grp")), "grouped")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest id that links lead to."""
    rows = _grouped(docs)
    least = stored(rows.where("grp is not null").groupBy(F.col("grp").alias("g")).agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, F.col("grp") == F.col("g"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def dedupe(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """The documents, all columns, one of each group: that of the smallest id. Documents without a set stay."""
    rows = _grouped(docs, width, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("f")
    kept = rows.where("grp is not null").groupBy("grp").agg(first).select("f.doc_id", "f.text_key", F.lit(True).alias("grouped"))
    kept = kept.unionByName(rows.where("grp is null").select("doc_id", "text_key", F.lit(False).alias("grouped")).distinct())
    kept = stored(kept, "kept").withColumnsRenamed({"doc_id": "_k_id", "text_key": "_k_text", "grouped": "_k_grouped"})
    same = F.xxhash64("text").eqNullSafe(F.col("_k_text")) & F.col("doc_id").eqNullSafe(F.col("_k_id"))
    # of rows with the same id and text, which fall into the same partition, one stays
    copy = F.row_number().over(Window.partitionBy("_k_text", "_k_id").orderBy(F.lit(1)))
    return docs.join(kept, same).withColumn("_k_copy", copy).where("_k_copy = 1 or not _k_grouped").select(docs.columns)
