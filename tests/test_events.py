"""Streams with state and windows, the gate, and the literal index."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from codewarden.catalog import MALICIOUS_RULES, POLICY_RULES, VULNERABILITY_RULES, Rule
from codewarden.operators import index
from codewarden.operators.scan import catalog, scan_rules
from codewarden.sources import tree
from codewarden.streaming import events
from workloads.snippets import SNIPPETS

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "file_path string, code string, ts timestamp"


def save(spark, folder, name, *rows):
    data = [(p, c, DAY + dt.timedelta(hours=h)) for p, c, h in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_replayed_batches_give_each_content_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def writer():
        first = events.first_saves(stream(spark, inbox), delay="10 hours").select("file_path", "digest", "ts")
        return first.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)

    got = lambda: sorted((r.file_path, r.ts.hour + 24 * (r.ts.day - 1)) for r in spark.read.parquet(out).collect())
    save(spark, inbox, "1", ("a.js", "x", 0), ("b.js", "y", 1), ("n.js", None, 1))
    events.run_available(writer())
    save(spark, inbox, "2", ("a.js", "x", 2), ("b.js", "z", 2), ("n.js", None, 3))  # a replay and a new content
    events.run_available(writer())
    assert got() == [("a.js", 0), ("b.js", 1), ("b.js", 2), ("n.js", 1)]
    save(spark, inbox, "3", ("c.js", "q", 40))  # event time moves on: the first contents are forgotten
    events.run_available(writer())
    save(spark, inbox, "4", ("late.js", "w", 5), ("a.js", "x", 41))  # late, and the same content after the delay
    events.run_available(writer())
    assert got() == [("a.js", 0), ("a.js", 41), ("b.js", 1), ("b.js", 2), ("c.js", 40), ("n.js", 1)]


def test_first_saves_of_a_table(spark):
    df = spark.createDataFrame([("a", "x", DAY), ("a", "x", DAY), ("a", "y", DAY), ("b", None, DAY), ("b", None, DAY)], SCHEMA)
    assert sorted(map(tuple, events.first_saves(df).select("file_path", "code").collect()), key=str) == [("a", "x"), ("a", "y"), ("b", None)]


def test_windows_equal_the_batch_twin_without_late_rows(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    keys = ["begin", "end", "severity"]
    rows = [[(f"f{n}{k}.js", "eval(x)\n" * (k + 1), 6 * n + k) for k in range(3)] for n in range(6)]
    for n, part in enumerate(rows):
        save(spark, inbox, str(n), *part)
        found = scan_rules(stream(spark, inbox), VULNERABILITY_RULES, ("ts",))
        events.run_available(events.keep_updates(events.window_counts(found, width="8 hours", delay="12 hours"), out, state))
    table = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(inbox)
    want = events.window_counts(scan_rules(table, VULNERABILITY_RULES, ("ts",)), width="8 hours")
    last = lambda: sorted(map(tuple, events.last_updates(spark, out, keys).select(*want.columns).collect()))
    assert last() == sorted(map(tuple, want.collect())) and len(last()) > 3
    before = last()
    save(spark, inbox, "late", ("late.js", "eval(x)", 1))  # its window is closed
    found = scan_rules(stream(spark, inbox), VULNERABILITY_RULES, ("ts",))
    events.run_available(events.keep_updates(events.window_counts(found, width="8 hours", delay="12 hours"), out, state))
    assert last() == before


def test_a_repeated_batch_changes_no_verdict(spark, tmp_path):
    rows = [(s, d) for d, n in (("d1", 4), ("d2", 20)) for s in ["high"] * n] + [("new", "d2")]
    found = spark.createDataFrame(rows, "severity string, day string")
    expected = events.baseline(spark.createDataFrame([("high",)] * 12 + [("low",)] * 3, "severity string"), 3)
    check = lambda batch: events.gate(batch, F.col("day"), expected, tolerance=0.5, allowance=2)
    got = {(r.period, r.severity): (r.findings, r.expected, r.deviation, r.passed) for r in check(found).collect()}
    assert got == {("d1", "high"): (4, 4.0, 1.0, True), ("d2", "high"): (20, 4.0, 5.0, False), ("d2", "new"): (1, 0.0, None, True)}
    found.write.parquet(str(tmp_path / "in"))
    seen = []

    def write_twice(batch):
        seen.append(batch.count())
        return check(batch)

    for state in ("s1", "s2"):  # the second run works the same batch off again, as after a lost checkpoint
        arriving = spark.readStream.schema(found.schema).parquet(str(tmp_path / "in"))
        events.run_available(events.gated(arriving, str(tmp_path / "out"), str(tmp_path / state), write_twice))
    assert seen == [25, 25] and spark.read.parquet(str(tmp_path / "out")).count() == 3


# --- literal index

def test_the_index_passes_every_file_with_a_finding(spark, make_files, tmp_path):
    rng = random.Random(3)
    bodies = [(ext, body) for ext, body in SNIPPETS] + [(".ts", ""), (".js", "ab"), (".py", "İ ſ K eval(x)"), (".js", "z" * 50_000)]
    files = make_files(*[(f"d/f{i}{ext}", body + "\n" + "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 50, 5000]))))
                         for i, (ext, body) in enumerate(bodies)], ("null.js", None))
    known = index.literal_index(files).cache()
    for rules in (catalog(), MALICIOUS_RULES, POLICY_RULES[:2], [r for r in VULNERABILITY_RULES if r.needs][:5]):
        whole = {r.file_path for r in scan_rules(files, rules).collect()}
        passed = {r.file_path for r in index.candidates(known, rules).collect()}
        assert whole <= passed
    few = Rule(rule_id="r", title="t", severity="low", pattern="AKIA", flags="g", category="policy-violation", confidence=1.0, needs=("akia",), description="d")
    passed = {r.file_path for r in index.candidates(known, [few]).collect()}
    assert {r.file_path for r in files.filter("lower(code) like '%akia%'").collect()} <= passed and len(passed) < len(bodies) / 4
    assert index.candidates(known, []).count() == 0 and index.literal_index(files.limit(0)).count() == 0


def test_only_candidates_are_opened(spark, make_files, tmp_path):
    files = make_files(("a/eval.js", "eval(x)"), ("b/other.js", "var a"), ("c/.x/eval.js", "eval(y)"))
    tree.write_tree(files, str(tmp_path))
    known = index.literal_index(tree.every_file(spark, str(tmp_path))).cache()
    known.count()
    rules = [r for r in VULNERABILITY_RULES if r.rule_id == "EVAL-001"]
    (tmp_path / "b" / "other.js").unlink()
    chosen = tree.read_paths(index.candidates(known, rules), str(tmp_path))
    assert sorted((r.file_path, r.code) for r in chosen.collect()) == [("a/eval.js", "eval(x)"), ("c/.x/eval.js", "eval(y)")]
    assert sorted(r.file_path for r in scan_rules(chosen, rules).collect()) == ["a/eval.js", "c/.x/eval.js"]
