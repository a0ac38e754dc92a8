"""The operators against brute force, and their defined results on nulls, empty texts, ties, copies and empty tables."""

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import time
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codewarden.llm import (decontaminate, language, licences, ngram_join, packing, pii, quality, secrets_scan, toxicity,
                            urls)
from codewarden.llm.common import components
from codewarden.llm.oracle import ORACLE
from codewarden.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, extra string"
LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", None, "b"), (5, LONG, "en", None),
        (None, "no id here at all but some words", "en", "a"), (7, "same text twice " * 5, "en", "a"),
        (7, "same text twice " * 5, "en", "a"), (8, "SAME TEXT TWICE " * 5, "en", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "s", "k", "e") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    tables = "/root/testdata/sf0.01" if name.startswith("op13") else SMALL  # few phrases are frequent in the smallest
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    twin = con.sql(ORACLE[name])
    rows = QUERIES[name](spark, tables).select(*twin.columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, twin.fetchall()))


# --- 1

def test_decontaminate(spark, nothing):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(40)) for _ in range(6)]
    items = spark.createDataFrame([*enumerate(texts), (98, None), (99, "too short"), (None, "a null id with words enough")],
                                  "item_id long, text string")
    noise = lambda n=30: " ".join(word() for _ in range(n))
    edited = texts[1].split()
    for k in range(5, 40, 8):
        edited[k] = word()
    docs = [(i, noise(60)) for i in range(20)]
    docs += [(100, f"{noise()} {texts[0].upper()}, {noise()}"), (101, f"{noise()} {' '.join(edited)}"), (102, texts[2]),
             (103, f"{texts[3]} {noise(400)} {texts[4]}"), (104, None), (105, "")] + [(200 + i, texts[5]) for i in range(30)]
    frame_ = frame(spark, [(i, t, None, None) for i, t in docs])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame_, items).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (103, 3), (103, 4)} | {(200 + i, 5) for i in range(30)}
    kept = decontaminate.clean(frame_, items)
    assert kept.columns == frame_.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(20), 104, 105]
    assert decontaminate.matches(nothing, items).count() == 0
    assert decontaminate.matches(frame_, items.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [1, 5, 1000])
def test_decontaminate_copied_leaks(spark, copies):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(n)) for n in (40, 40, 15)]
    items = spark.createDataFrame([*enumerate(texts)], "item_id long, text string")
    edited, short = texts[0].split(), texts[2].split()
    for k in range(5, 40, 8):
        edited[k] = word()
    short[7] = word()
    leaks = [" ".join(edited), " ".join(texts[1].split()[:24]), " ".join(short)]
    noise = lambda: " ".join(word() for _ in range(30))
    docs = [(10 * c + i, f"{noise()} {leak} {noise()}") for c in range(copies) for i, leak in enumerate(leaks)]
    frame_ = frame(spark, [(i, t, None, None) for i, t in [*docs, (9, noise())]])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame_, items).collect())
    assert got == [(i, i % 10) for i, _ in docs]
    assert [r["doc_id"] for r in decontaminate.clean(frame_, items).collect()] == [9]


def test_words_and_their_hashes():
    texts = [None, "", " ... -- ", "The cat, the hat; (THE) cat-flap", "a\x1cb\u00a0c\u2003d\u3000e\u0085f", "act cat tac\ncat\tact", "ΟΔΟΣ ΑΣ. é.è \ud800 É.È",
             "word " * 200_000 + "end", "x" * 600_000 + " cat", "line\n" * 100_000]
    known = decontaminate.Hashes()
    code, starts, around = decontaminate.grams(texts, known)
    want = [None, *(w for t in texts for w in (*decontaminate.words(t), None))]
    number = {w: i for i, w in enumerate(dict.fromkeys(want))}
    own = dict(zip(around.tolist(), (number[w] for w in want)))
    assert len(around) == len(want) and len(own) == len(number) and [own[h] for h in around.tolist()] == [number[w] for w in want]
    ends = [i for i, w in enumerate(want) if w is None]
    assert starts.tolist() == ends[:-1] and len(code) == len(want) - decontaminate.WIDTH - 1
    # the same in other portions and another process
    for text in texts:
        assert set(decontaminate.grams([text], decontaminate.Hashes())[2].tolist()) <= set(own)


def test_decontaminate_against_all_pairs(spark, small):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = {r["doc_id"]: decontaminate.words(r["text"]) for r in small.collect()}
    want = set()
    for r in items.collect():
        item = decontaminate.words(r["text"])
        for doc, text in texts.items():
            if len(item) >= decontaminate.WIDTH:
                score = decontaminate.best(item, text, decontaminate.LEAST)[0]
                want |= {(doc, r["item_id"], round(score, 9))} if score >= decontaminate.LEAST else set()
    got = decontaminate.matches(small, items).collect()
    assert want and {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in got} == want


def test_a_common_phrase_is_no_seed(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{noise(8)} how many did he {noise(8)}" for _ in range(500)]
    items = spark.createDataFrame([*enumerate(texts)], "item_id long, text string")
    clash = [f"{noise(40)} how many did he {noise(40)}" for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in enumerate([*clash, f"{noise(40)} {texts[7]}", LONG, LONG])],
                                 "doc_id long, text string, t1 int, t2 int, salt int, row string")
    own = decontaminate.item_grams(items).cache()
    seeds = decontaminate.rarity(docs, own)
    met = decontaminate.pairs(decontaminate.passages(docs, seeds), seeds)
    assert met.select("t1").distinct().count() == met.select("item").distinct().count() == 1
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()] == [(40, 7)]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 41, 42]


@pytest.mark.parametrize("part", [40, 24])
def test_copies_with_different_edits(spark, part):
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    docs = []
    for i in range(400):
        copy = item[:part]
        for k in rng.sample(range(part), 3 if part == 40 else 1):
            copy[k] = word()
        docs.append((i, " ".join([*(word() for _ in range(20)), *copy, *(word() for _ in range(20))]), None, None))
    items = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    want = [i for i, t, _, _ in docs if decontaminate.best(item, t.split(), decontaminate.LEAST)[0] >= decontaminate.LEAST]
    assert len(want) > 300 and sorted(r["doc_id"] for r in decontaminate.matches(frame(spark, docs), items).collect()) == want


def test_align_is_smith_waterman():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(0, table[i][j] + (2 if x == y else -1), table[i][j + 1] - 1, table[i + 1][j] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, table))


# --- 2

def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, x in enumerate(windows) for k in range(5) if windows.count(x) > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality(spark, edge, nothing):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "#", "| ", "é", "\t", "x y z u v "]) for _ in range(60)), "en", "a")
            for i in range(60)] + [r for r in EDGE if r[1] != LONG]
    got = quality.judge(frame(spark, rows)).collect()
    key = lambda r: str(r)
    base = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got]
    assert sorted(base, key=key) == sorted((brute_quality(t) for _, t, _, _ in rows), key=key)
    assert all(not r["kept"] for r in got if r["base_failed"]) and len(got) == len(rows)
    assert quality.judge(edge).count() == len(EDGE) and quality.judge(nothing).count() == 0


# --- 3

def test_encoder_gives_the_tokenizer_ids(small):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    ours = packing.Encoder(P.path(packing.VOCABULARY), P.PATTERN)
    texts = [r["text"] for r in small.collect()] + ["", " ", "a  b", " a", "a ", "a\n b", "a \nb", "it's you'll\n\n x\n \ny",
             "<|endoftext|> 3x9", "ªº² Ⅷ\u00a0 x", "tab\t x", "日本 語"]
    for t in texts:
        assert ours.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes()


def test_packing(spark, small, edge, nothing):
    for docs in (small, edge):
        rows = packing.pack(docs).collect()
        by_seq = {}
        for r in rows:
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert 0 < r["length"] and r["offset"] + r["length"] <= 2048 and len(r["ids"]) == 4 * r["length"]
        for s, parts in by_seq.items():
            parts.sort()
            assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert s == max(by_seq) or sum(n for _, n in parts) == 2048
        assert sorted(by_seq) == list(range(len(by_seq)))
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    P = pytest.importorskip("public_tokenizers")
    enc, ids = packing.Encoder(P.path(packing.VOCABULARY), P.PATTERN), {}
    for r in sorted(packing.pack(small).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert len(ids.get(r["doc_id"], b"")) == 4 * r["start"]
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + bytes(r["ids"])
    assert ids.keys() == texts.keys()
    for i, t in texts.items():
        assert ids[i] == np.array([*np.frombuffer(enc.encode(t), "<u2"), 1], "<u4").tobytes()
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("totals,weights", [([5000, 100, 7], [5000, 100, 7]), ([9000, 9000], [1, 3]), ([1], [1]), ([50, 0, 2000], [9, 1, 1])])
def test_schedule(totals, weights):
    size = 512
    s = packing.Schedule(totals, weights, size)
    taken = sorted(p for j, t in enumerate(totals) if t for p in s.pieces(j, 0, t))
    assert [p for p, _ in taken] == [sum(n for _, n in taken[:k]) for k in range(len(taken))]
    for k in range(s.windows + 1):
        given = s.given(k)[0]
        assert given == totals or all(g <= k * size * w / sum(weights) + 1 for g, w in zip(given, weights) if min(totals) > max(given))


# --- 4

def brute_pii(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
             r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule, t):
            d = re.sub(r"\D", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d)
                    or k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base():
    rng = random.Random(4)
    for _ in range(5000):
        t = "".join(rng.choice("1234567890.+-() @ab_%\n25é") for _ in range(50))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@") == []


def test_pii_learns_contexts(spark, edge, nothing):
    rows = [(100 + i, f"some text {i} here\nplease call phone: +1 (555) 010-{1000 + i} today", "en", "a") for i in range(30)]
    rows += [(50, "my phone: 555-010-9999 ok", "en", "a"), (51, "number 123456789 alone", "en", "a")]
    docs = frame(spark, rows + EDGE)
    got = {r["doc_id"]: r for r in pii.find(docs).collect() if r["doc_id"] not in (7, None)}
    assert got[50]["spans"] == "phone:10:22" and got[50]["n_phone"] == 0 and got[51]["spans"] == ""
    assert got[103]["n_phone"] == 1 and got[50]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    hidden = pii.redact(docs)
    assert hidden.columns == docs.columns and hidden.count() == docs.count()
    texts = {r["doc_id"]: r for r in hidden.collect()}
    assert texts[50]["text"] == "my phone: [phone] ok" and texts[1]["text"] is None and texts[50]["key"] == "k"
    assert pii.find(edge).count() == len(EDGE) and pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_pii_usual_forms(spark):
    rows = [(100 + i, f"some text {i} here\nplease call phone: +1 (555) 010-{1000 + i} today", "en", "a") for i in range(30)]
    rows += [(200 + i, f"write to mail <user{i}@some.org> or email:me{i}@some.org", "en", "a") for i in range(30)]
    cards = [x for x in (f"4111111111{k:06d}" for k in range(300)) if pii._luhn(x)]
    rows += [(300 + i, f'the card "{x[:4]} {x[4:8]} {x[8:12]} {x[12:]}" is mine', "en", "a") for i, x in enumerate(cards)]
    forms = {"phone": ["phone: (743) 555-3824", "phone:743.555.3824", "(phone [743] 555 3824)", "phone: 743 555 3824 12 people"],
             "card": ["card 4111 1111 1111 1112", "card: '4111-1111-1111-1112'", "card=3782 822463 10006"],
             "email": ["mail <john@localhost>", "email:john@localhost", "email: 'john@localhost'"]}
    values = ["(743) 555-3824", "743.555.3824", "[743] 555 3824", "743 555 3824", "4111 1111 1111 1112", "4111-1111-1111-1112",
              "3782 822463 10006", *["john@localhost"] * 3]
    flat = [(kind, x, v) for (kind, x), v in zip(((kind, x) for kind, xs in forms.items() for x in xs), values)]
    rows += [(i, f"the {x} there", "en", "a") for i, (_, x, _) in enumerate(flat)] + [(99, "in 2019 12000 people", "en", "a")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, rows)).collect()}
    at = [f"the {x} there".index(v) for _, x, v in flat]
    assert [got[i] for i in range(len(flat))] == [f"{kind}:{a}:{a + len(v)}" for (kind, _, v), a in zip(flat, at)]
    assert got[99] == ""
    assert pii.candidates("1 " * 200_000 + "x" + "(" * 100_000 + "a=" * 100_000, []) is not None


def test_pii_counts_all_patterns(spark, monkeypatch):
    rows = [(i, f"the 10.0.{i}.1 the word", "en", "a") for i in range(40)] + [(50, "the 123456 the word", "en", "a")]
    rows += [(100 + i, f"dial +1 555 010-{1000 + i} now", "en", "a") for i in range(8)] + [(60, "dial 555-010-9999 now", "en", "a")]
    monkeypatch.setattr(pii, "PATTERNS", 1)
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, rows)).collect()}
    assert got[60] == "phone:5:17" and got[50] == ""


# --- 5

def brute_secrets(t):
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(a, secrets_scan.KINDS[k], b) for a, k, b in sorted(out)]


def test_secrets(spark, edge, nothing):
    rng = random.Random(5)
    parts = ["token", "Api_Key", "PASSWD", "=", " : ", '"', "abcdef", "0" * 13, "9a8b7c", "AKIA", "ABCDEF123", " ", "\n", "é", "ſecret"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(14))
        assert secrets_scan.base_spans(t) == brute_secrets(t), t
    inner = 'password = "hunter2hunter2"'
    layers = [quote(inner, safe=""), "".join(f"\\u{ord(c):04x}" for c in inner), base64.b64encode(inner.encode()).decode(),
              base64.b64encode(gzip.compress(inner.encode())).decode(), quote(base64.b64encode(quote(inner, safe="").encode()).decode(), safe="")]
    for x in layers:
        t = f"see {x} here"
        _, nested, _ = secrets_scan.scan_text(t)
        assert ("assign", x) in [(k, t[a:b]) for a, k, b, _ in nested], x
    bomb = base64.b64encode(gzip.compress(b"a" * 5_000_000)).decode()
    assert secrets_scan.scan_text(bomb, most=1000)[2] >= 1 and secrets_scan.scan_text(bomb)[2] == 0
    assert secrets_scan.scan_text("a" * 300_000 + "%" + "b" * 300_000 + "\\u")[1] == []
    assert secrets_scan.scan(edge).count() == len(EDGE) and secrets_scan.scan(nothing).count() == 0


def test_secrets_in_bytes():
    rng = random.Random(15)
    inner = 'password = "hunter2hunter2"'
    filler = " ".join(str(rng.random()) for _ in range(60))
    escaped = lambda data: "".join(f"%{b:02X}" for b in data)
    packed = gzip.compress(f"{filler} {inner} {filler}".encode())
    wrapped = lambda data, end="\n": end.join(re.findall(".{1,76}", base64.b64encode(data).decode()))
    layers = [escaped(packed), escaped(zlib.compress(inner.encode())), "".join(f"\\x{b:02x}" for b in packed),
              base64.b64encode(gzip.compress(gzip.compress(inner.encode()))).decode(), "caf%E9&" + quote(inner, safe=""),
              base64.b64encode(bytes(range(128, 256)) + inner.encode()).decode(), wrapped(packed), wrapped(packed, "\r\n  "),
              wrapped(f"{'x' * 45} {inner}".encode()), "data=" + escaped(packed), "z=" + quote(zlib.compress(inner.encode()), safe="")]
    for x in layers:
        for t in (f"see\n{x}\nhere", x):
            _, nested, _ = secrets_scan.scan_text(t)
            assert "assign" in [k for a, k, b, _ in nested if t[a:b] == x], x
    assert secrets_scan.scan_text("\n".join(["word" * 5] * 30_000) + "!")[1] == []
    twice = base64.b64encode(gzip.compress(gzip.compress(b"a" * 50_000_000))).decode()
    assert secrets_scan.scan_text(twice, most=1000)[2] >= 1


def test_secrets_in_more_forms():
    inner = 'password = "hunter2hunter2"'
    b64 = lambda data: base64.b64encode(data).decode()
    packed = gzip.compress(b"some more " * 9) + gzip.compress(inner.encode())
    layers = [f"{head}{b64(inner.encode())}" for head in ("data/", "x_", "a-", "ab_c/")]
    layers += [f"data/{b64(gzip.compress(inner.encode()))}", b64(packed), b64(bz2.compress(inner.encode())),
               b64(lzma.compress(inner.encode())), b64(bz2.compress(gzip.compress(inner.encode()))),
               b64(inner.encode("utf-16")), b64(inner.encode("utf-16-be")), b64(b"\1" + inner.encode("utf-16-le")),
               "".join(f"\\U{ord(c):08x}" for c in inner), "".join(f"\\u{{{ord(c):x}}}" for c in inner),
               b64(gzip.compress(b"a" * 5_000_000 + inner.encode())), b64(gzip.compress(inner.encode())[:-9])]
    for x in layers:
        for t in (f"see\n{x}\nhere", x):
            assert "assign" in [k for a, k, b, _ in secrets_scan.scan_text(t)[1] if t[a:b] == x], x
    far = gzip.compress(b"b" * (2 * secrets_scan.WINDOW - 9) + inner.encode())  # lies across the end of a window
    assert "assign" in [k for _, k, _, _ in secrets_scan.scan_text(b64(far))[1]]
    assert secrets_scan.scan_text("\\Uffffffff%zz\\u{}" * 50)[1] == []


def brute_settled(text):
    escape = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,8})\}")
    while m := escape.search(text):
        text = text[:m.start()] + chr(int(next(filter(None, m.groups())), 16)) + text[m.end():]
    return text


def test_deep_escapes_settle_in_one_pass():
    rng = random.Random(16)
    for _ in range(2000):
        t = "".join(rng.choice(["%", "25", "%25", "5c", "%5C", "x", "\\", "\\x25", "u0025", "\\u{5c}", "41", "z"]) for _ in range(12))
        assert secrets_scan._settled(t) == brute_settled(t), t
    deep = quote('password = "hunter2hunter2"', safe="")
    for _ in range(30):
        deep = deep.replace("%", "%25").replace("\\", "%5C")
    assert [(a, k, b) for a, k, b, _ in secrets_scan.scan_text(f"see {deep}!")[1]] == [(4, "assign", 4 + len(deep))]
    begin = time.time()
    secrets_scan.scan_text("%" + "25" * 500_000)
    secrets_scan.scan_text("\\" + "x5c" * 300_000)
    secrets_scan.scan_text("%5C" + "x255C" * 200_000)
    assert time.time() - begin < 60


# --- 6

def test_urls(spark):
    words = ["cheap", "news", "blog", "win"]
    rows = [(i, f"https://{words[i % 4]}.{'example.' if i % 2 else 'site.'}{['net', 'org', 'com'][i % 3]}/{['en', 'fr', 'de'][i % 5 % 3]}/{i}?a={i}")
            for i in range(300)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "http://EXAMPLE.net"), (904, "http://a.net/x"), (905, "x://y://z.org/fr/?q#h"),
             (906, "http://x.example.net/en/1"), (None, "http://badnet/en/"), (904, "http://a.net/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)

    def brute(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
                and path.startswith("/" + r.partition("/")[2])]
        return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))

    want = sorted(map(str, (brute(u)[:3] for _, u in rows)))
    assert sorted(str((r["host"], r["path"], r["rule"])) for r in got) == want
    assert all(r["verdict"] == dict(urls.RULES)[r["rule"]] for r in got if r["rule"]) and {r["verdict"] for r in got} == {"allow", "block"}
    assert urls.judge(pages.limit(0)).count() == 0
    x = "aab?c=1&d=2"
    row = urls.features(urls.parts(spark.createDataFrame([(1, x)], "page_id long, url string"))).first()
    assert row["params"] == 2 and math.isclose(row["entropy"], -sum(x.count(c) / len(x) * math.log2(x.count(c) / len(x)) for c in set(x)))


# --- 7

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root)]


def test_ngram_join(spark, small, edge, nothing):
    rng = random.Random(7)
    rows = []
    for f in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 9, 10, 12, 30, 150, 400]))]
        for c in range(9):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(50)}"
            rows.append((f * 10 + c, " ".join(t)))
    rows += [(i, t) for i, t, _, _ in EDGE] + [(r["doc_id"], r["text"]) for r in small.limit(120).collect()]
    rows = [(i if k < 120 else (None if i is None else i + 1000), t) for k, (i, t) in enumerate(rows)]
    got = ngram_join.join(frame(spark, [(i, t, None, None) for i, t in rows]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_components(rows)))
    assert ngram_join.join(nothing).count() == 0 and ngram_join.dedupe(nothing).count() == 0
    kept = ngram_join.dedupe(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]


def test_near_copies_stage(spark, small):
    rng = random.Random(17)
    rows = [(r["doc_id"], r["text"]) for r in small.orderBy("doc_id").limit(120).collect()]
    for f in range(40):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 5, 8, 9, 12, 30, 60, 150, 400]))]
        for c in range(5):
            t = list(base)
            for _ in range(rng.randrange(max(1, len(t) // 25) + 1)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(50)}"
            head = [f"h{rng.randrange(10**6)}" for _ in range(rng.randrange(len(t) // 4 + 1))]
            rows.append((10_000 + f * 10 + c, " ".join(head + t)))
    sets = [frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
            for w in ("".join(c.lower() if c.isascii() else c for c in t or "").split() for _, t in rows)]
    root, links = list(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y, links = root[i], root[j], links + (10 * len(a & b) < 9 * len(a | b))
                root = [y if r == x else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, [(i, t, None, None) for i, t in rows]), SMALL)
    assert links > 20 and sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())


def test_large_families_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i % 30], f"x{i}", *base[i % 30 + 1:]])) for i in range(25)]
    rows += [(100 + i, " ".join([*base[:30 - i], *(f"y{k}" for k in range(i)), *base[30:]])) for i in range(6)]
    got = ngram_join.join(frame(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (20, 30), (30, 40), (40, 50), (50, 60), (60, 20), (2, 1)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), *((k, 20) for k in (20, 30, 40, 50, 60))}


# --- 8

def test_toxicity(spark, edge, nothing):
    rng = random.Random(8)
    clean = lambda: [f"word{rng.randrange(400)}" for _ in range(30)]
    rows, labels = [], []
    for i in range(400):
        w = clean()
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["grumbold", "snarkel", "vexing"])
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, int(i % 4 == 0)))
    labels += [(None, 1), (5000, None)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), table, exceptions=("snarkel tree",))
    assert {t.strip() for t in model.terms} == {"grumbold", "snarkel", "vexing"}
    texts = ["a grumbold here", "GRUMB0LD", "gr\u0443mbold and ѕnarkel", "the snarkel tree", "nothing", "", None, "ungrumbolding 1234"]
    got = [r["score"] >= 0.7 for r in toxicity.score(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]).coalesce(1), model)
           .orderBy("doc_id").collect()]
    assert got == [True, True, True, False, False, False, False, False]
    kept = toxicity.clean(edge, model)
    assert kept.columns == edge.columns and kept.count() == len(EDGE)
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(frame(spark, rows), table.limit(0))
    assert toxicity.score(edge, none).where("score < 0.01").count() == len(EDGE)


def test_toxicity_learns_exceptions(spark):
    rng = random.Random(18)
    rows, labels = [], []
    for i in range(700):
        w = [f"word{rng.randrange(400)}" for _ in range(30)]
        if i < 100:
            w[rng.randrange(30)] = "snarkel"
        elif i < 106:
            w[3:5] = ["snarkel", "tree"]
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, int(i < 100)))
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.exceptions == ("snarkel tree",)
    texts = ["a snarkel here", "the snarkel tree", "The SNARKEL\ntree.", "a snarkel treetop", "snarkel tree and snarkel"]
    got = {r["doc_id"] for r in toxicity.clean(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), model).collect()}
    assert got == {1, 2}


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op8_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    wrong, rows = got.agg(F.sum(F.when(F.col("toxic") != F.col("predicted"), 1).otherwise(0)), F.count("*")).first()
    assert rows > 50 and wrong <= 0.15 * rows


# --- 9

def test_language(spark, small, edge, nothing):
    got = QUERIES["op9_language"](spark, SMALL).join(small.select("doc_id", "lang"), "doc_id").where("held_out")
    right, rows = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * rows
    langs, model = language.fit(small)
    rows = {r["doc_id"]: r for r in language.predict(edge, langs, model).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und" and rows[1]["score"] == 0 and rows[5]["lang_pred"] in langs
    assert language.predict(frame(spark, [(1, "12 34 !", None, None)]), langs, model).first()["lang_pred"] == "und"
    assert language.fit(nothing) == ([], {}) and language.predict(edge, [], {}).where("lang_pred = 'und'").count() == len(EDGE)


# --- 10

def test_licences(spark, edge, nothing):
    known = licences.known_licences(spark)
    mit = dict(licences.KNOWN)["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Somebody\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,")),
            (3, "text before\nReleased under the MIT Licence.\nand after\nReleased under the MIT License."), (4, mit + " more"), (5, None)]
    got = {r["doc_id"]: r for r in licences.scan(frame(spark, [(i, t, None, None) for i, t in rows]), known).collect()}
    assert [got[i]["license_id"] for i in range(1, 6)] == ["MIT", "MIT", None, None, None]
    assert (got[3]["n_notices"], got[3]["notices"]) == (2, "MIT-notice")
    assert licences.scan(edge, known).count() == len(EDGE) and licences.scan(nothing, known).count() == 0
    assert licences.scan(edge, known.limit(0)).where("license_id is null").count() == len(EDGE)


# --- the pipeline

def test_pipeline(spark, small):
    docs, sizes = small, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == small.columns, name
        docs = after.cache()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()
    hidden = docs.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9]'").count()
    assert hidden == 0 and docs.where("n_chars <> length(text)").count() == 0
