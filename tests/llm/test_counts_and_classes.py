"""The quality classifier, the source audit and the collocations against plain loops, and their defined results on odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codewarden.llm import collocations, nb_svm, source_audit
from tests.llm.test_operators import EDGE, LONG, frame


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, text string")


# --- 11

def random_rows(rng, n):
    rows, good = [], rng.random(n) < 0.6
    for g in good:
        x = rng.choice(300, rng.integers(3, 30), replace=False) + (0 if g else 40)
        rows.append(np.unique(x).astype(np.int32))
    return rows, good


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows, good = random_rows(rng, 120)
    r = nb_svm.ratios(rows, good)
    xs, cost = [nb_svm.scaled(x, r) for x in rows], np.where(good, 1.0, 2.0)
    w, offset, dual = nb_svm.descend(rows, xs, good, cost)
    y = np.where(good, 1, -1)
    # the weights are those of the dual variables, and primal and dual values meet
    again = np.zeros_like(w)
    for a, x, d, s in zip(rows, xs, dual, y):
        again[a] += d * s * x
    assert np.allclose(w, again) and np.isclose(offset, (dual * y).sum()) and (dual >= 0).all() and (dual <= cost).all()
    margins = np.array([w[a] @ x + offset for a, x in zip(rows, xs)])
    square = w @ w + offset ** 2
    primal, lower = square / 2 + (cost * np.maximum(0, 1 - y * margins)).sum(), dual.sum() - square / 2
    assert lower <= primal + 1e-6 and primal - lower < 0.02 * primal


def test_ratios_are_smoothed_shares():
    rows, good = [np.array([1, 2], np.int32), np.array([2], np.int32), np.array([3], np.int32)], np.array([True, True, False])
    n = nb_svm.BUCKETS
    want = np.log((2 + 1) / (3 + n)) - np.log(1 / (1 + n))
    assert np.isclose(nb_svm.ratios(rows, good)[2], want, atol=1e-5)


def test_indicators_are_distinct_ngrams():
    hashes = nb_svm.Hashes()
    short, twice = nb_svm.indicators("Alpha beta!! gamma", hashes), nb_svm.indicators("alpha BETA!! gamma", hashes)
    assert np.array_equal(short, twice) and len(short) == 4 + 3 + 2
    assert len(nb_svm.indicators("x " * 50, hashes)) == 3 and not len(nb_svm.indicators(None, hashes))


def test_quality_classifier(spark, edge, nothing):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    text = lambda bad: " ".join(rng.choice(words) + ("$$ %" if bad and rng.random() < 0.3 else "") for _ in range(40))
    rows = [(i, text(i % 4 == 0), "en", "a") for i in range(400)]
    marks = labels(spark, [(i, int(i % 4 != 0), "clash") for i in range(300)] + [(5, 0, "c"), (None, 1, "c"), (7, None, "c"), (8, 1, "c"), (10**9, 0, "c")])
    model = nb_svm.fit(frame(spark, rows), marks)
    got = {r["doc_id"]: r["score"] for r in nb_svm.score(frame(spark, rows), model).collect()}
    unseen = [(got[i] >= nb_svm.THRESHOLD) == (i % 4 != 0) for i in range(300, 400)]
    assert np.mean(unseen) > 0.95
    hashes = nb_svm.Hashes()
    for i in (0, 1, 350):  # the score by the formula
        at = nb_svm.indicators(rows[i][1], hashes)
        x = model.ratios[at] / np.linalg.norm(model.ratios[at])
        assert np.isclose(got[i], 1 / (1 + np.exp(-(model.slope * (x @ model.weights[at] + model.offset) + model.shift))), atol=1e-5)
    odd = nb_svm.score(edge, model).collect()
    assert len(odd) == len(EDGE) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] in (1, 2)}) == 1
    assert nb_svm.score(nothing, model).count() == 0
    flat = nb_svm.fit(frame(spark, rows), marks.where("quality = 1"))
    assert {round(r["score"], 5) for r in nb_svm.score(edge, flat).collect()} == {1.0}
    assert {r["score"] for r in nb_svm.score(edge, nb_svm.fit(nothing, marks)).collect()} == {0.5}


# --- 12

def brute_audit(rows, top=source_audit.TOP):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = find.findall((text or "").translate(low))
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
    kept = {g: {t for t, n in in_docs[g].items() if n >= 3} for g, _ in groups}
    of_lang = defaultdict(Counter)
    for (g, s), c in counts.items():
        of_lang[g].update({t: n for t, n in c.items() if t in kept[g]})
    share = lambda c, g, t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept[g]) + len(kept[g]))
    p = {(g, s): {t: share(counts[g, s], g, t) for t in kept[g]} for g, s in groups}
    q = {g: {t: share(of_lang[g], g, t) for t in kept[g]} for g in kept}
    f = lambda a, b: (a - b) ** 2 // b
    out = set()
    for g, s in groups:
        pairs = [(o, sum(f(p[g, s][t], p[g, o][t]) for t in kept[g])) for h, o in groups if h == g and o != s]
        above = [(t, f(p[g, s][t], q[g][t])) for t in kept[g] if counts[g, s][t] and p[g, s][t] > q[g][t]]
        for part, items, most in (("pair", pairs, None), ("term", above, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(g, s, part, item, v, k) for k, (item, v) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("piece", [1, 7, source_audit.PIECE])
def test_source_audit(spark, nothing, monkeypatch, piece):
    monkeypatch.setattr(source_audit, "PIECE", piece)
    rng = random.Random(piece)
    word = lambda: rng.choice(["a", "Éa", "éa", "b", "B", "straße", "x"]) * rng.choice([1, 1, 1, 2, 3]) + rng.choice(["", "", " 9", "-", "Z"])
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 30, 90]))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None]))
            for i in range(120)]
    rows += [r for r in EDGE if r[1] != LONG] + [(9, "", "en", "empty group"), (9, "lonely words here", "xx", "one"), (9, None, "yy", "1"), (9, None, "yy", "2")]
    got = [tuple(r) for r in source_audit.audit(frame(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows)
    assert source_audit.audit(nothing).count() == 0


def test_source_audit_of_a_long_text(spark):
    rows = [(i, LONG, "en", s) for i, s in enumerate("aabc")]
    assert {tuple(r) for r in source_audit.audit(frame(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()} == brute_audit(rows)


def test_tree_adds_large_numbers_exactly():
    rng = random.Random(5)
    big, zero = 10**9, [1, 3, 2, 1, 5]
    rows = sorted({tuple((s, rng.choice([1, 7, big, big + 1])) for s in sorted(rng.sample(range(5), rng.randrange(1, 6)))) for _ in range(60)})
    m = np.array([rng.choice([1, 2, 10**6]) for _ in rows])
    want = Counter()
    f = lambda a, b: (a - b) ** 2 // b
    for r, n in zip(rows, m.tolist()):
        for s, ps in r:
            for t, pt in r:
                if s != t:
                    want[s, t] += n * (f(ps, pt) - f(ps, zero[t]) - f(zero[s], pt) + f(zero[s], zero[t]))
    code, p = (np.array([e[k] for r in rows for e in r]) for k in range(2))
    got = source_audit._shared(code, p, np.array(zero)[code], np.concatenate([[0], np.cumsum([len(r) for r in rows])]), m)
    assert max(want.values()) > 1 << 63
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# --- 13

def brute_counts(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f["und" if lang is None else lang].update(tuple(w[i:i + n]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    return f


def brute_collocations(rows):
    out = set()
    for lang, f in brute_counts(rows).items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= collocations.LEAST}
        inner = lambda p, x: any(x[i:i + len(p)] == p for i in range(len(x) - len(p) + 1))
        kept = []
        for p, a in long.items():
            if not any(len(x) > len(p) and inner(p, x) and 100 * b >= 80 * a for x, b in long.items()):
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for k, (s, a, p, l, r) in enumerate(sorted(kept)[:collocations.TOP], 1):
            out.add((lang, k, p.decode(), -a, l, r, n, -s))
    return out


def phrase_rows(rng, n):
    words = ["the", "Of", "de", "é", "|", "\x01", "a b", "rare"]
    joint = lambda: rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\r\n", "!"])
    rows = [(i, "".join(rng.choice(words) + joint() for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"]), "s") for i in range(n)]
    return rows + [(9, "in the long run it is " * 40, "en", "s"), (9, "in the long run it is " * 40, "en", "s")]


def test_runs_hold_hashes_and_counts():
    rng = np.random.default_rng(5)
    for size, ranges in ((0, 1), (10 ** 6, 1), (10 ** 8, 7), (10 ** 13, 300)):
        low = collocations.dropped_bits(size)
        h = np.concatenate([rng.integers(0, 1 << 48, 3000, np.uint64), np.array([0, 0, 1, (1 << 48) - 1], np.uint64)])
        a = np.concatenate([rng.integers(1, 9, 3000), [255, 1, 70_000, 510]])
        want = {}
        for x, n in zip((h >> np.uint64(low) << np.uint64(low)).tolist(), a.tolist()):
            want[x] = want.get(x, 0) + n
        sent = collocations.runs(h, a, ranges, low)
        assert len(set(sent["range"].to_pylist())) == sent.num_rows <= ranges
        got = {}
        for k in range(sent.num_rows):
            hashes, sums = collocations.read_runs(pa.Table.from_batches([sent.slice(k, 1)]))
            got |= dict(zip(hashes.tolist(), sums.tolist()))
        assert got == want
    assert collocations.runs(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3, 8).num_rows == 0
    assert [collocations.dropped_bits(n) for n in (0, 1 << 27, 1 << 33)] == [16, 8, 0]


@pytest.mark.parametrize("shard", [5, 400, collocations.SHARD])
def test_collocations(spark, nothing, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    rows = phrase_rows(random.Random(shard), 150) + EDGE
    got = [tuple(r) for r in collocations.mine(frame(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_collocations(rows) and len(got) > 50
    assert collocations.mine(nothing).count() == 0


def test_collocations_in_a_coarse_filter(spark, monkeypatch):
    """What a small filter lets through is dropped by its count."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    rows = phrase_rows(random.Random(9), 100)
    got = {tuple(r) for r in collocations.mine(frame(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == brute_collocations(rows)


def test_walk_finds_all_phrases_of_an_index():
    rng = random.Random(3)
    rows = [(0, "".join(rng.choice("abcd") + rng.choice([" ", " ", " ", "."]) for _ in range(300)), "en", None)]
    shard = collocations.Shard()
    shard.add("en", rows[0][1].encode().translate(collocations.LETTERS).replace(b".", b" . ").split())
    row = shard.row()
    words = [None, *row["words"][0].as_py().decode().split(".")]
    walk = collocations.Walk(*(np.frombuffer(row[c][0].as_py(), np.int32) for c in ("left", "right")))
    want = brute_counts(rows)["en"]
    for n, side in ((1, None), (2, "right"), (3, "left"), (4, "right")):
        if side:
            walk.extend(side, n == 4)
        got = {tuple(words[c[i]] for c in walk.columns): int(a) for i, a in enumerate(walk.size)}
        assert got == {p: a for p, a in want.items() if len(p) == n}
        if n < 4:  # both intervals hold the phrase's occurrences
            for i in range(len(walk.size)):
                lo, size = walk.lo["left"][i], walk.size[i]
                before = Counter(walk.bwt["left"][lo:lo + size].tolist())
                phrase = tuple(words[c[i]] for c in walk.columns)
                for word, a in before.items():
                    assert not word or want[(words[word], *phrase)] == a or len(phrase) == 4


def test_a_long_text_fills_several_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 1000)
    rows = [(1, "one two three. " * 2000 + "no marks " * 3000, "en", "s")]
    df = frame(spark, rows)
    assert collocations.index(df).count() >= 6
    assert {tuple(r) for r in collocations.mine(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == brute_collocations(rows)



def test_runs_take_few_bytes():
    """Steps between hashes and neighbouring phrases are sent compressed; every hash and phrase arrives with its count."""
    rng = np.random.default_rng(6)
    h, low = np.unique(rng.integers(0, 1 << 48, 200_000, np.uint64)), collocations.dropped_bits(1 << 26, 5, 1)
    sent = collocations.runs(h, np.ones(len(h), np.int64), 1, low)
    assert low == 16 and sum(len(sent[c][0].as_py()) for c in ("steps", "counts")) < 2.2 * len(h)
    hashes, sums = collocations.read_runs(pa.Table.from_batches([sent]))
    assert sums.sum() == len(h) and (hashes == np.unique(h >> np.uint64(low)) << np.uint64(low)).all()
    words = [b"w%d" % i for i in range(40)]
    phrases = [b" ".join(words[i] for i in rng.integers(0, 40, rng.integers(1, 5))) for _ in range(20_000)] + ["é \x01".encode()] * 70_000
    ranges = [len(p.split()[0]) % 2 for p in phrases]
    rows = [pa.RecordBatch.from_arrays([pa.array(ranges), pa.array([lang] * len(phrases)), pa.array(phrases), pa.array([3] * len(phrases))],
                                       ["range", "lang", "phrase", "a"]) for lang in ("en", "de")]
    sent = collocations.phrase_runs(collocations.summed(rows))
    assert sent.num_rows == 4 and sum(map(len, sent["phrases"].to_pylist())) < 8 * 2 * len(set(phrases))
    got = [collocations.add_phrases(pa.Table.from_batches([sent.slice(k, 1)] * 2)).to_pylist() for k in range(4)]
    want = {(lang, p.decode(), len(p.split()), 6 * n) for lang in ("en", "de") for p, n in Counter(phrases).items() if 6 * n >= collocations.LEAST}
    assert {tuple(r.values()) for rows in got for r in rows} == want
    assert collocations.phrase_runs(collocations.summed(rows).slice(0, 0)).num_rows == 0
