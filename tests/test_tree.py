"""The folder-tree source and sink, comparisons of scans, contexts and fixes by pieces."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from codewarden.config import MANDATORY_EXCLUDES, ScanConfig
from codewarden.functions.paths import excluded, scannable
from codewarden.operators import compare, context, remedy, rollup
from codewarden.operators.scan import vulnerability_findings
from codewarden.plans.project import scan_files
from codewarden.sources import tree


def put(root, files):
    for rel, text in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def found(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_names_are_tested_as_in_tables(spark):
    rng = random.Random(1)
    parts = ["src", ".github", ".env", ".envrc", ".hidden", "a.min.js", "node_modules", "Dockerfile", "x.PY", "y.ts", ".gitlab-ci.yml", "no ext",
             "a.b.c.go", ".js", "..ts", "bußß.rs", "a?b.js", "Makefile.am"]
    paths = sorted({"/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(300)})
    patterns = [*MANDATORY_EXCLUDES, *ScanConfig().exclude_patterns, "a?b*"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    want = {r.file_path for r in df.filter(scannable(F.col("file_path")) & ~excluded(F.col("file_path"), patterns)).collect()}
    dropped = tree.name_test(patterns)
    assert {p for p in paths if tree.is_scannable(p) and not any(dropped(c) for c in p.split("/"))} == want


@pytest.mark.parametrize("shares", [1, 2, 5, 100])
def test_every_file_is_read_once(spark, tmp_path, monkeypatch, shares):
    monkeypatch.setattr(tree, "TASK_BYTES", 40)
    files = {f"{'/'.join('abc'[: n % 4])}/f{n}.py".lstrip("/"): "x" * n for n in range(30)} | {"_x/__init__.py": "", "deep/" * 9 + "end.js": "1"}
    put(tmp_path, files)
    tree.register(spark)
    read = spark.read.format(tree.FORMAT).option("shares", shares).load(str(tmp_path))
    assert sorted((r.file_path, r.code, r.size_bytes) for r in read.collect()) == sorted((k, v, len(v)) for k, v in files.items())
    slim = spark.read.format(tree.FORMAT).option("content", "false").load(str(tmp_path))
    assert slim.columns == ["file_path", "size_bytes"] and slim.count() == len(files)


def test_filters_reach_the_listing(spark, tmp_path):
    put(tmp_path, {"a/x.py": "1", "a/b/y.py": "22", "c/z.py": "333", "c/long.py": "4" * 50})
    files = tree.read_tree(spark, str(tmp_path))
    for condition, want in (("file_path like 'a/%'", ["a/b/y.py", "a/x.py"]), ("file_path = 'c/z.py'", ["c/z.py"]), ("size_bytes > 2", ["c/long.py", "c/z.py"]),
                            ("file_path in ('a/x.py', 'c/long.py') and size_bytes <= 1", ["a/x.py"]), ("not file_path like '%y.py'", ["a/x.py", "c/long.py", "c/z.py"]),
                            ("code = '22'", ["a/b/y.py"]), ("size_bytes = 2 or code = '1'", ["a/b/y.py", "a/x.py"]), ("file_path is null", [])):
        assert sorted(r.file_path for r in files.filter(condition).collect()) == want, condition
    plan = files.filter("file_path like 'a/%' and size_bytes < 9 and code <> ''")._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.split("\n") if "Filter" in line and "BatchScan" not in line]
    assert not any("StartsWith" in line or "size_bytes" in line for line in above) and any("code" in line for line in above)


def test_a_pushed_filter_does_not_enter_other_folders(tmp_path):
    put(tmp_path, {"a/x.py": "1", "b/y.py": "2", "a/deep/z.py": "3"})
    reader = tree.TreeReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([ds.StringStartsWith(("file_path",), "a/d"), ds.EqualTo(("code",), "3")])) == [ds.EqualTo(("code",), "3")]
    entered, inner = [], reader._entries
    reader._entries = lambda system, base, folder: entered.append(folder) or inner(system, base, folder)
    rows = [r for share in reader.partitions() for batch in reader.read(share) for r in batch.to_pylist()]
    assert [r["file_path"] for r in rows] == ["a/deep/z.py"] and set(entered) == {"", "a", "a/deep"}


def test_written_files_replace_whole_files(spark, tmp_path):
    put(tmp_path, {"keep.py": "old", "src/a.py": "long old text"})
    files = spark.createDataFrame([("src/a.py", "new"), ("new/deep/.x/b.py", "é\r\n"), ("c.py", ""), ("null.py", None), ("./d/../e.py", "e")],
                                  "file_path string, code string").repartition(3)
    tree.write_tree(files, str(tmp_path))
    want = {"keep.py": "old", "src/a.py": "new", "new/deep/.x/b.py": "é\r\n", "c.py": "", "e.py": "e"}
    assert {k: (tmp_path / k).read_bytes().decode() for k in found(tmp_path)} == want
    assert not list(tmp_path.glob(".staging*"))
    back = {r.file_path: r.code for r in tree.every_file(spark, str(tmp_path)).collect()}
    assert back == want
    tree.write_tree(files.limit(0), str(tmp_path / "empty"))
    assert tree.every_file(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("bad", ["../out.py", "/abs.py", "a/../../out.py", "", "."])
def test_a_failed_job_changes_no_file(spark, tmp_path, bad):
    root = tmp_path / "root"
    put(root, {"a.py": "old"})
    files = spark.createDataFrame([(f"n{i}.py", "new") for i in range(20)] + [("a.py", "new"), (bad, "x")], "file_path string, code string")
    with pytest.raises(Exception, match="path"):
        tree.write_tree(files.repartition(4), str(root))
    assert found(tmp_path) == {"root/a.py": "old"} and not list(root.glob(".staging*"))
    with pytest.raises(Exception, match="append"):
        files.write.format(tree.FORMAT).mode("overwrite").save(str(root))


def test_a_folder_for_each_file_is_no_task_for_each(tmp_path):
    put(tmp_path, {f"src/d{n}/main.py": str(n) for n in range(40)} | {"src/own.py": "x"})
    reader = tree.TreeReader({"path": str(tmp_path), "shares": "5"})
    shares = reader.partitions()
    assert len(shares) == 5 + 1  # and the files beside the folders
    rows = [r for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert sorted(r["file_path"] for r in rows) == sorted(found(tmp_path))


def test_files_are_moved_by_tasks_that_may_be_repeated(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree.TreeWriter, "commit", lambda *_: 1 / 0)  # nothing is moved on the driver
    files = spark.createDataFrame([(f"d{n}/f.py", str(n)) for n in range(30)], "file_path string, code string").repartition(4)
    tree.write_tree(files, str(tmp_path))
    assert found(tmp_path) == {f"d{n}/f.py": str(n) for n in range(30)}
    system, base = tree._system(str(tmp_path))
    put(tmp_path / "st", {"1": "moved now", "list": '["d0/f.py", "new/g.py"]'})
    assert tree._place(system, f"{base}/st", base) == 2 and found(tmp_path)["new/g.py"] == "moved now"
    put(tmp_path / "st", {"list": '["lost.py"]'})
    with pytest.raises(OSError):
        tree._place(system, f"{base}/st", base)


def test_an_attempt_that_does_not_count_leaves_nothing(tmp_path):
    writer = tree.TreeWriter({"path": str(tmp_path)})
    put(tmp_path / writer.stage, {"1/0": "good", "1/list": '["a/b.py"]', "2/0": "lost attempt", "2/list": '["a/b.py"]'})
    writer.commit([tree.Staged("1", 1), None, tree.Staged("7", 0)])
    assert found(tmp_path) == {"a/b.py": "good"}
    other = tree.TreeWriter({"path": str(tmp_path)})
    put(tmp_path / other.stage, {"1/0": "half"})
    other.abort([])
    assert found(tmp_path) == {"a/b.py": "good"}


# --- comparison of scans

def test_lines_on_top_are_no_new_findings(make_files):
    code = "eval(x)\nvar a\neval(x)\n  eval(x)\n"
    before = vulnerability_findings(make_files(("a.js", code), ("b.js", "eval(y)"), ("d.js", "var z")))
    after = vulnerability_findings(make_files(("a.js", "// one\n// two\n" + code + "eval( z )"), ("c.js", "eval(y)"), ("d.js", "var z")))
    got = {(r.status, r.file_path, r.ordinal, r.old_line, r.new_line) for r in compare.compare_scans(before, after).collect() if r.rule_id == "EVAL-001"}
    assert got == {("kept", "a.js", 1, 1, 3), ("kept", "a.js", 2, 3, 5), ("kept", "a.js", 3, 4, 6), ("new", "a.js", 1, None, 7), ("gone", "b.js", 1, 1, None),
                   ("new", "c.js", 1, None, 1)}
    same = compare.compare_scans(before, before)
    assert {r.status for r in same.collect()} == {"kept"} and same.count() == before.count()
    assert compare.compare_scans(before.limit(0), after.limit(0)).count() == 0


def test_rollup_has_subtotals(make_files):
    rows = rollup.severity_rollup(vulnerability_findings(make_files(("a.js", "eval(x)\neval(x)"), ("b.py", "exec(x)"), ("c.js", "eval(x)")))).collect()
    got = {(r.language, r.severity, r.level): (r.findings, r.files) for r in rows}
    assert got[None, None, 3] == (sum(n for (_, _, level), (n, _) in got.items() if level == 0), 3)
    assert got["JavaScript", None, 1] == (3, 2)


def test_times_and_pretty_json(make_files):
    import json

    scan = scan_files(make_files(("a.js", "eval(x)")))
    times = ("2024-02-28 23:59:50", "2024-02-29 00:01:00")
    lines = [r.line for r in scan.report("p", times).filter("section = 0").orderBy("sub").collect()]
    assert lines[2:6] == ["Project: p", "Started: 2024-02-28 23:59:50", "Ended: 2024-02-29 00:01:00", "Took: 70 s"]
    assert "Took" not in "".join(r.line or "" for r in scan.report("p").collect())
    plain, pretty = (scan.report_json(times, p).first().value for p in (False, True))
    assert "\n" not in plain and "\n" in pretty and json.loads(plain) == json.loads(pretty) and json.loads(plain)["summary"]["duration_s"] == 70


# --- contexts

def brute_context(code, start, end):
    import re

    lines = code.split("\n")
    declaration = re.compile(context.DECLARATION)
    begin, last = max(0, start - 1), min(len(lines) - 1, end - 1)
    first = next((i for i in range(begin, max(0, begin - 80) - 1, -1) if declaration.search(lines[i])), max(0, begin - 10))
    depth, opened, until = 0, False, min(len(lines) - 1, last + 20)
    for i in range(first, min(len(lines) - 1, last + 150) + 1):
        depth += lines[i].count("{") - lines[i].count("}")
        opened = opened or "{" in lines[i]
        if opened and depth <= 0 and i >= last:
            until = i
            break
    return first + 1, until + 1, "\n".join(lines[first:until + 1])


def test_contexts_are_cut_in_the_row_of_the_file(spark, make_files):
    rng = random.Random(2)
    words = ["function f() {", "}", "eval(x)", "  if (a) {", "  }", "var b = 1", "class C {", "", "'eval(x)'"]
    code = {f"f{n}.js": "\n".join(rng.choice(words) for _ in range(rng.choice([1, 3, 40, 400]))) for n in range(25)}
    files = make_files(*code.items(), ("null.js", None))
    held = scan_files(files, with_context=True).findings
    assert "code" not in held.columns
    rows = held.collect()
    assert len(rows) > 100 and held.count() == scan_files(files).findings.count()
    for r in rows:
        assert (r.first_line, r.last_line, r.context) == brute_context(code[r.file_path], r.start_line, r.end_line)
    chosen = scan_files(files).findings.filter("start_line % 2 = 0")
    joined = {r.finding_id: (r.first_line, r.last_line, r.context) for r in context.finding_context(chosen, files).collect()}
    assert joined == {r.finding_id: (r.first_line, r.last_line, r.context) for r in rows if r.start_line % 2 == 0}


def test_many_fixes_in_a_long_file(spark, make_files):
    n = 4000
    files = make_files(("a.js", "\n".join(f"line {i}" for i in range(n))))
    fixes = spark.createDataFrame([(f"f{i:05}", "a.js", i, i + 1, f"fixed {i}") for i in range(1, n, 2)] + [("overlap", "a.js", 2, 2, "x")],
                                  "finding_id string, file_path string, start_line int, end_line int, sanitized_code string")
    row = remedy.apply_fixes(files, fixes).first()
    assert (row.applied, row.conflicts) == (n // 2, "overlap")
    assert row.code == "\n".join(f"fixed {i}" for i in range(1, n, 2))
