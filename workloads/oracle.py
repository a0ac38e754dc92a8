"""The same results in SQL for a second engine.

The texts below follow the definitions, not the Spark plans: a match is found
by cutting the text at its matches, its line by counting the line feeds before
it, and the string test by counting quotes in the part of its line before it.
Patterns with look-around, which that engine lacks, are replaced by a plain
pattern on a text in which the exempt places were first made unrecognisable
(``before``), or by a test of what follows the match (``after``).
"""

from __future__ import annotations

from codewarden.catalog import MALICIOUS_RULES, POLICY_RULES, SHELL_RULES, VULNERABILITY_RULES, Rule
from codewarden.catalog import authorship as A
from codewarden.catalog import policy as P
from codewarden.config import MANDATORY_EXCLUDES, ScanConfig
from codewarden.functions.dialect import SPACE_CHARS, SPACE_CLASS, translate
from codewarden.functions.paths import (
    ALLOWED_HIDDEN, BASENAME_LANGUAGE, EXTENSION_LANGUAGE, SCANNABLE_BASENAMES, SCANNABLE_EXTENSIONS)
from codewarden.functions.severity import RISK_WEIGHT, SEVERITY_RANK
from codewarden.operators import context as R
from codewarden.operators import remedy as M
from codewarden.operators import replies as L
from codewarden.operators.scan import active_rules, add_rule, catalog
from codewarden.sources import files as S
from workloads.queries import CUSTOM_ACTIVE, CUSTOM_RULE, ONE_FILE, PROJECT, REGION, ROOT, SMALL_KB, TIMES
from workloads.snippets import COMMANDS, FIX_REPLIES, GUIDANCE_REPLIES, SCORE_REPLIES, SNIPPETS

MARK = "\uFDD0"


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def rx(pattern: str, flags: str = "") -> str:
    return q(translate(pattern, flags, "re2"))


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def pick(values, key: str) -> str:
    return f"([{', '.join(q(v) for v in values)}])[CAST({key} % {len(values)} AS INT) + 1]"


def case_of(key: str, table: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {q(v) if isinstance(v, str) else v}"
                              for k, v in table.items()) + f" ELSE {other} END"


WS = q(SPACE_CHARS)

FILES = f"""files AS MATERIALIZED (
  SELECT *, strlen(code) AS size_bytes,
    lower(regexp_extract(file_path, '([^/]*)$', 1)) AS base,
    lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) AS ext,
    string_split(code, chr(10)) AS lines
  FROM (
    SELECT CASE WHEN doc_id % 29 = 0 THEN 'node_modules/pkg/' WHEN doc_id % 31 = 0 THEN '.hidden/'
                WHEN doc_id % 37 = 0 THEN '.github/workflows/' ELSE 'src/' END
           || source || '/doc_' || CAST(doc_id AS VARCHAR) || {pick([s[0] for s in SNIPPETS], 'doc_id')} AS file_path,
      CASE WHEN doc_id % 2 = 0 THEN {pick([s[1] for s in SNIPPETS], 'doc_id')} || chr(10) || text
           ELSE text || chr(10) || {pick([s[1] for s in SNIPPETS], 'doc_id')} END AS code
    FROM documents
    UNION ALL
    SELECT 'web/page_' || CAST(page_id AS VARCHAR) || '.html', html FROM pages))"""

LANGUAGE = (
    "coalesce(" + case_of("regexp_extract(file_path, '([^/]*)$', 1)", BASENAME_LANGUAGE, "NULL") + ", "
    + case_of("string_split(base, '.')[-1]", EXTENSION_LANGUAGE, "upper(string_split(base, '.')[-1])") + ")")

# --- find-all ----------------------------------------------------------------------

_Q = "['\"`]"
_EXEMPT_HOST = r"(localhost|127\.0\.0\.1|0\.0\.0\.0|www\.w3\.org|schemas?\.|xml\.)"
_CLOSED = rf"\s*{_Q}[^'\"`\n]*{_Q}\s*\)"
# rule -> (pattern, replacement) on the text before the search
BEFORE = {
    "NET-001": (rf"http://{_EXEMPT_HOST}", r"hxxp://\1"),
    "no-http-external": (rf"http://{_EXEMPT_HOST}", r"hxxp://\1"),
    "XSS-001": (rf"\.innerHTML(\s*={_Q}\s*{_Q})", r".innerHTMX\1"),
    "no-innerHTML": (rf"\.innerHTML(\s*={_Q}\s*{_Q})", r".innerHTMX\1"),
    "PY-003": (rf"\bexec(\s*\({_Q}[^'\"`\n]*{_Q}\s*\))", r"exeX\1"),
    "C-004": (rf"\bsystem(\s*\({_CLOSED})", r"systeX\1"),
    "PHP-001": (rf"\beval(\s*\({_CLOSED})", r"evaX\1"),
    "RB-002": (rf"\beval(\s*\({_CLOSED})", r"evaX\1"),
    "GO-001": (rf"exec\.Command(\s*\(\s*{_Q}[^'\"`\n]*{_Q})", r"exec.CommanX\1"),
    "JAVA-005": (r"DocumentBuilderFactory\.newInstance(\s*\(\s*\)[^;]{0,300}setFeature)",
                 r"DocumentBuilderFactory.newInstancX\1"),
    "RUST-002": (rf"(?:format!|&\w+)(\s*{_Q})", r"#\1"),
    "DOCKER-003": (r"ADD(\s)http", r"AXD\1http"),
}
# rule -> pattern without look-around
PLAIN = {
    "NET-001": rf"{_Q}http://",
    "no-http-external": rf"{_Q}http://[^'\"`]+{_Q}",
    "XSS-001": r"\.innerHTML\s*=\s*",
    "no-innerHTML": r"\.innerHTML\s*=\s*",
    "PY-003": r"\bexec\s*\(\s*",
    "PY-005": r"\byaml\.load\s*\([^)]*",
    "C-004": r"\bsystem\s*\(\s*",
    "C-005": rf"\b(?:scanf|fscanf)\s*\(\s*{_Q}(?:[^'\"`\n]*[^'\"`\n0-9])?%s",
    "PHP-001": r"\beval\s*\(\s*",
    "RB-002": r"\beval\s*\(\s*",
    "GO-001": r"exec\.Command\s*\(\s*",
    "JAVA-005": r"DocumentBuilderFactory\.newInstance\s*\(\s*\)",
    "RUST-002": r"Command::new\s*\([^)]*(?:format!|&\w+\b)",
    "DOCKER-003": r"^ADD\s+",
    "CICD-001": r"""(?:password|token|secret|api_key|apikey)\s*:\s*["'][A-Za-z0-9+/=_-]{8,}["']""",
    "K8S-004": r"containers:[\s\S]{0,500}image:\s*\S+",
    "IFRAME-001": r"<iframe\b[^>]*",
}
_TAG = f"regexp_extract(rest, {rx(r'<iframe[^>]*', 'i')})"
AFTER = {
    "K8S-004": f"NOT regexp_matches(rest, {rx(r'image:[^;]{0,300}resources:')})",
    "IFRAME-001": (
        f"regexp_matches({_TAG}, " + rx(r"""\bsrc\s*=\s*['"][^'"]{1,}['"]""", "i") + ") AND "
        f"regexp_matches({_TAG}, " + rx(
            r"""(?:width|height)\s*=\s*["']?0["']?|style\s*=\s*["'][^"']*"""
            r"""(?:width\s*:\s*0|height\s*:\s*0|display\s*:\s*none)""", "i") + ")"),
}
_LICENSE = (
    "(" + " OR ".join(f"ends_with(file_path, {q(e)})" for e in P.LICENSE_EXTENSIONS) + ")"
    f" AND NOT list_has_any(string_split(file_path, '/'), [{names(P.LICENSE_SKIPPED_DIRS)}])"
    f" AND NOT regexp_matches(file_path, {rx(P.LICENSE_SKIPPED_FILES)})"
    f" AND NOT regexp_matches(code[1:{P.LICENSE_HEADER_CHARS}], {rx(P.LICENSE_WORDS, 'i')})")


def _cut(i: int, r: Rule) -> str:
    """The text cut in front of every match of a rule."""
    pattern = rx(PLAIN.get(r.rule_id, r.pattern or ""), r.flags)
    text = "code"
    if r.rule_id in BEFORE:
        find, put = BEFORE[r.rule_id]
        text = f"regexp_replace(code, {rx(find)}, {q(put)}, 'g')"
    where = f"regexp_matches({text}, {pattern})"
    if r.file_types:
        types = names(r.file_types)
        where = f"(ext IN ({types}) OR base IN ({types})) AND {where}"
    cut = f"string_split(regexp_replace({text}, {pattern}, {q(MARK + chr(92) + '0')}, 'g'), {q(MARK)})"
    return f"SELECT {i} AS rule_ord, file_path, lines, {cut} AS parts FROM files WHERE {where}"


def findings(rules) -> str:
    """CTEs up to ``rule_findings``, after ``files``."""
    rules = list(rules)
    searched = [(i, r) for i, r in enumerate(rules) if r.pattern]
    after = " ".join(f"WHEN {i} THEN {AFTER[r.rule_id]}" for i, r in searched if r.rule_id in AFTER)
    in_string = ", ".join(str(i) for i, r in searched if r.in_string) or "-1"
    table = ", ".join(
        f"({i}, {q(r.rule_id)}, {q(r.category)}, {q(r.severity)}, {SEVERITY_RANK[r.severity]}, {q(r.title)}, "
        f"{q(r.cwe)}::VARCHAR, CAST({r.confidence} AS DOUBLE), {q(r.description)}, {q(r.recommendation)}::VARCHAR)"
        for i, r in enumerate(rules))
    checks = ""
    for i, r in enumerate(rules):
        if r.rule_id == "license-compliance":
            checks += (f" UNION ALL SELECT {i}, file_path, 1, 0, lines[1] FROM files WHERE {_LICENSE}")
        if r.rule_id == "no-async-without-await":
            checks += (
                f" UNION ALL SELECT {i}, file_path, n, 0, trim(lines[n], {WS}) FROM"
                f" (SELECT file_path, lines, unnest(range(1, len(lines) + 1)) AS n FROM files"
                f"  WHERE regexp_matches(file_path, {rx(P.ASYNC_FILES)}))"
                f" WHERE regexp_matches(lines[n], {rx(P.ASYNC_LINE)})"
                f" AND NOT regexp_matches(array_to_string(lines[n:n + {P.ASYNC_FRAME_LINES - 1}], chr(10)), {rx(P.AWAIT_WORD)})")
    cuts = "\n UNION ALL ".join(_cut(i, r) for i, r in searched) or (
        "SELECT 0 AS rule_ord, file_path, lines, [''] AS parts FROM files WHERE false")
    return f"""rules(rule_ord, rule_id, category, severity, severity_rank, title, cwe, confidence, description, recommendation)
  AS (VALUES {table}),
cuts AS ({cuts}),
each_match AS (SELECT rule_ord, file_path, lines, parts, unnest(range(1, len(parts))) AS k FROM cuts),
placed AS (SELECT rule_ord, file_path, lines, k, array_to_string(parts[1:k], '') AS head, parts[k + 1] AS rest
           FROM each_match),
tailed AS (SELECT *, len(head) - len(replace(head, chr(10), '')) + 1 AS n,
             regexp_replace(string_split(head, chr(10))[-1], '(?s)\\\\.', '', 'g') AS tail FROM placed),
outside AS (SELECT rule_ord, file_path, lines, k, n FROM tailed
  WHERE (rule_ord IN ({in_string})
     OR ((len(tail) - len(replace(tail, '''', ''))) % 2 = 0 AND (len(tail) - len(replace(tail, '"', ''))) % 2 = 0
         AND (len(tail) - len(replace(tail, '`', ''))) % 2 = 0))
    AND CASE rule_ord {after or 'WHEN -1 THEN true'} ELSE true END),
hits(rule_ord, file_path, start_line, match_ord, snippet) AS (
  SELECT rule_ord, file_path, n, row_number() OVER (PARTITION BY rule_ord, file_path, n ORDER BY k) - 1,
    trim(lines[n], {WS}) FROM outside{checks}),
rule_findings AS (
  SELECT sha256(concat_ws('|', category, rule_id, file_path, CAST(start_line AS VARCHAR), CAST(match_ord AS VARCHAR)))
      AS finding_id, category, severity, severity_rank, rule_id, rule_ord, title, description, file_path,
    CAST(start_line AS INTEGER) AS start_line, CAST(start_line AS INTEGER) AS end_line,
    CAST(match_ord AS INTEGER) AS match_ord, snippet, confidence, recommendation, cwe,
    CASE WHEN category = 'policy-violation' THEN rule_id END AS policy_rule
  FROM hits JOIN rules USING (rule_ord))"""


FINDING_COLUMNS = ("finding_id, category, severity, rule_id, title, description, file_path, start_line, end_line, "
                   "match_ord, snippet, confidence, recommendation, cwe, policy_rule")

# --- authorship --------------------------------------------------------------------


def _any(patterns) -> str:
    return " + ".join(f"CAST(regexp_matches(code, {rx(p, f)}) AS INT)" for p, f in patterns)


def _all(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(code, {rx(p, f)}))" for p, f in patterns)


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


SIGNALS = f"""measured AS MATERIALIZED (
  SELECT file_path, code, lines, len(lines) AS lines_total,
    list_filter(lines, lambda l: NOT regexp_matches(l, {rx(A.COMMENT_LINE_WIDE)}) AND length(trim(l, {WS})) > 5) AS code_lines,
    len(list_filter(lines, lambda l: regexp_matches(l, {rx(A.COMMENT_LINE)}))) AS comment_lines,
    list_transform(list_filter(lines, lambda l: length(trim(l, {WS})) > 0), lambda l: length(l)::DOUBLE) AS lengths,
    list_transform(regexp_extract_all(code, {rx(A.IDENTIFIER)}), lambda w: lower(w)) AS ids,
    {_any(A.COMMENT_PATTERNS)} AS comment_hits,
    {_any(A.BOILERPLATE_PATTERNS)} AS boilerplate_hits,
    {_all(A.STRUCTURE_PATTERNS)} AS structure_hits
  FROM files),
derived AS (
  SELECT *, len(code_lines) AS n_code, len(ids) AS n_ids,
    coalesce(list_sum(list_filter(map_values(list_aggregate(list_transform(code_lines, lambda l: trim(l, {WS})),
      'histogram')), lambda c: c >= 2)), 0) AS repeated,
    list_filter(list_transform(code_lines, lambda l: list_aggregate(list_filter(
      regexp_split_to_array(l, {rx(A.TOKEN_SEPARATORS)}), lambda t: length(t) >= 2), 'entropy')),
      lambda e: e > 1e-9) AS entropies,
    len(list_filter(ids, lambda w: w IN ({names(A.GENERIC_WORDS)}))) AS n_generic
  FROM measured),
signals AS MATERIALIZED (
  SELECT file_path, lines, lines_total, n_code, n_ids, repeated, comment_hits, boilerplate_hits, structure_hits, comment_lines,
    len(lengths) AS filled_lines,
    CASE WHEN n_code < 5 THEN 0.0::DOUBLE ELSE
      0.60::DOUBLE * least(repeated::DOUBLE / n_code / 0.20::DOUBLE, 1.0::DOUBLE)
      + 0.40::DOUBLE * CASE WHEN len(entropies) >= 3 THEN
          {_clamp("(0.40::DOUBLE - list_aggregate(entropies, 'stddev_pop') / list_aggregate(entropies, 'avg')) / 0.30::DOUBLE")}
          ELSE 0.0::DOUBLE END END AS entropy_burstiness,
    least(comment_hits::DOUBLE / 2, 1.0) AS comment_patterns,
    CASE WHEN n_ids < 10 THEN 0.0::DOUBLE ELSE {_clamp("(n_generic::DOUBLE / n_ids - 0.10::DOUBLE) / 0.20::DOUBLE")} END
      AS generic_identifier_score,
    least(boilerplate_hits::DOUBLE / 2, 1.0) AS boilerplate,
    least(structure_hits::DOUBLE / 3, 1.0) AS structure_uniformity,
    least(comment_lines::DOUBLE / lines_total / 0.40::DOUBLE, 1.0::DOUBLE) AS comment_density,
    CASE WHEN len(lengths) < 10 THEN 0.0::DOUBLE ELSE
      {_clamp("(0.65::DOUBLE - list_aggregate(lengths, 'stddev_pop') / list_aggregate(lengths, 'avg')) / 0.35::DOUBLE")}
      END AS line_length_uniformity
  FROM derived)"""

_SIGNAL_COLUMNS = ("entropy_burstiness", "comment_patterns", "generic_identifier_score", "boilerplate",
                   "structure_uniformity", "comment_density", "line_length_uniformity")
_OFFSET = case_of("lower(string_split(file_path, '.')[-1])", A.LANGUAGE_OFFSETS, "0")


def scores(blended: bool = False) -> str:
    """CTEs up to ``scores``, after ``signals`` (and ``parsed`` when blended)."""
    config = ScanConfig()
    weights = [w for _, w in A.SIGNAL_WEIGHTS[:-1]]
    total = " + ".join(f"{c} * {w}::DOUBLE" for c, w in zip(_SIGNAL_COLUMNS, weights, strict=False))
    joined, ai, model, reason, raw = "weighted", "h", "'heuristic-only'", "NULL::VARCHAR", "h"
    if blended:
        joined = "weighted LEFT JOIN parsed USING (file_path)"
        ai, reason = "coalesce(reply_score, h)", "reply_reason"
        model = "CASE WHEN reply_score IS NOT NULL THEN 'provider-model' ELSE 'heuristic-only' END"
        raw = (f"(h * {config.heuristic_weight}::DOUBLE + coalesce(reply_score, h) * {config.ai_weight}::DOUBLE)"
               f" / ({config.heuristic_weight}::DOUBLE + {config.ai_weight}::DOUBLE)")
    active = ", ".join(_SIGNAL_COLUMNS[:-1])
    return f"""weighted AS (
  SELECT *, w_len, ({total} + line_length_uniformity * w_len) / ({' + '.join(f'{w}::DOUBLE' for w in weights)} + w_len) AS h
  FROM (SELECT *, CASE WHEN filled_lines < 10 THEN 0.0::DOUBLE ELSE 0.10::DOUBLE END AS w_len FROM signals)),
blended AS (
  SELECT *, {ai} AS ai_analysis_score, {model} AS analysis_model, {reason} AS ai_reason,
    {_clamp(f"{raw} + {_OFFSET}::DOUBLE")} AS ai_score FROM {joined}),
margins AS (
  SELECT *, CASE WHEN w_len > 0 THEN [{active}, line_length_uniformity] ELSE [{active}] END AS active FROM blended),
scores AS MATERIALIZED (
  SELECT file_path, lines, lines_total, ai_score, h AS heuristic_score, ai_analysis_score, analysis_model, ai_reason,
    round(greatest(0.0::DOUBLE, ai_score - m), 3) AS interval_lo, round(least(1.0::DOUBLE, ai_score + m), 3) AS interval_hi,
    CASE WHEN ai_score >= 0.72 THEN 'detected' WHEN ai_score >= 0.45 THEN 'uncertain' ELSE 'clean' END AS tier,
    CAST(floor(lines_total * ai_score + 0.5) AS INTEGER) AS lines_ai
  FROM (SELECT *, 1.28::DOUBLE * sqrt(list_sum(list_transform(active, lambda s: (s - ai_score) * (s - ai_score))) / len(active))
          / sqrt(len(active)) AS m FROM margins))"""


AI_FINDINGS = f"""ai_findings AS (
  SELECT sha256(concat_ws('|', 'ai-generated', 'ai-generated', file_path, '1', '0')) AS finding_id,
    'ai-generated' AS category,
    CASE WHEN ai_score >= 0.90 THEN 'critical' WHEN ai_score >= 0.72 THEN 'high' WHEN ai_score >= 0.55 THEN 'medium'
         ELSE 'low' END AS severity,
    CASE WHEN ai_score >= 0.90 THEN 4 WHEN ai_score >= 0.72 THEN 3 WHEN ai_score >= 0.55 THEN 2 ELSE 1 END AS severity_rank,
    'ai-generated' AS rule_id, -1 AS rule_ord,
    CASE WHEN tier = 'detected' THEN 'Written by a model, by all signs (' || CAST(floor(ai_score * 100 + 0.5) AS INT) || '% sure)'
      ELSE 'Perhaps written by a model; have someone read it (' || CAST(floor(ai_score * 100 + 0.5) AS INT) || '% of the signs)'
      END AS title,
    CASE WHEN tier = 'detected' THEN 'Several signals of machine authorship agree (7 were weighed).'
      ELSE 'Some signals of machine authorship are present, but they do not settle the question.' END AS description,
    file_path, 1 AS start_line, CAST(lines_total AS INTEGER) AS end_line, 0 AS match_ord,
    array_to_string(lines[1:10], chr(10)) AS snippet, ai_score AS confidence,
    CASE WHEN tier = 'detected' THEN 'Check correctness, edge cases and the needs of the domain.'
      ELSE 'Check that the code answers the project''s needs.' END AS recommendation,
    NULL::VARCHAR AS cwe, NULL::VARCHAR AS policy_rule
  FROM scores WHERE ai_score >= 0.45)"""

PARSED = f"""replies AS (
  SELECT file_path, provider, replace(raw, '%s', '0.' || CAST(size_bytes % 90 + 10 AS VARCHAR)) AS reply FROM (
    {" UNION ALL ".join(
        f"SELECT file_path, size_bytes, {q(p)} AS provider, {pick(SCORE_REPLIES, f'(size_bytes + {i})')} AS raw "
        f"FROM files WHERE (size_bytes + {i}) % 3 <> 0" for i, p in enumerate(('openai', 'ollama', 'anthropic')))})),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY list_position([{names(L.PROVIDER_ORDER)}], provider)) AS r
  FROM replies),
picked AS (SELECT file_path, provider, reply FROM ranked WHERE r = 1),
objects AS (
  SELECT *, nullif(regexp_extract(reply, {rx(L.FIRST_OBJECT)}), '') AS obj FROM picked),
typed AS (
  SELECT *, json_valid(obj) AS ok,
    CASE WHEN json_valid(obj) THEN json_type(obj::JSON, '$.score') END AS kind,
    CASE WHEN json_valid(obj) THEN obj::JSON ->> '$.score' END AS score_text,
    CASE WHEN json_valid(obj) AND json_type(obj::JSON, '$.reason') = 'VARCHAR' THEN obj::JSON ->> '$.reason' END AS reason
  FROM objects),
parsed AS (
  SELECT file_path, provider, reply, s AS reply_score, CASE WHEN s IS NOT NULL AND ok THEN reason END AS reply_reason FROM (
    SELECT *, CASE
      WHEN ok AND kind IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN {_clamp("TRY_CAST(score_text AS DOUBLE)")}
      WHEN ok AND kind = 'VARCHAR' THEN CASE WHEN regexp_matches(score_text, '^\\s*[+-]?[0-9.]') THEN
        {_clamp("TRY_CAST(nullif(regexp_extract(score_text, '^[ ]*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+))', 1), '') AS DOUBLE)")} END
      WHEN obj IS NOT NULL AND NOT ok THEN TRY_CAST(nullif(regexp_extract(reply, {rx(L.BARE_SCORE)}, 1), '') AS DOUBLE)
      END AS s FROM typed))"""

ALL_RULES = catalog(ScanConfig().active_policies)
SCAN = f"{FILES}, {findings(ALL_RULES)}"
FULL = f"""{SCAN}, {SIGNALS}, {scores()}, {AI_FINDINGS},
all_findings AS (SELECT * FROM ai_findings UNION ALL BY NAME SELECT * FROM rule_findings)"""

_ANALYZER = "CASE category WHEN 'ai-generated' THEN 0 WHEN 'vulnerability' THEN 1 WHEN 'malicious' THEN 2 ELSE 3 END"
ORDER = f"file_path, {_ANALYZER}, rule_ord, start_line, match_ord"
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count" for s in ("critical", "high", "medium", "low"))
_RISK = case_of("severity", RISK_WEIGHT, "0")

SUMMARY = f"""summary AS (
  SELECT * FROM (SELECT count(*) FILTER (code IS NOT NULL) AS files_scanned, count(*) FILTER (code IS NULL) AS files_skipped FROM files),
    (SELECT count(*) AS total_findings, {_COUNTS}, coalesce(bool_or(category = 'malicious'), false) AS has_malicious FROM all_findings),
    (SELECT count(*) FILTER (ai_score >= 0.65) AS ai_generated_files, avg(ai_score) AS average_ai_score FROM scores))"""
RESULTS = f"""results AS (
  SELECT f.file_path, {LANGUAGE.replace('file_path', 'f.file_path')} AS language, CAST(len(f.lines) AS INTEGER) AS lines_of_code, ai_score,
    coalesce(vulnerabilities, 0) AS vulnerabilities, coalesce(policy_violations, 0) AS policy_violations,
    coalesce(n, 0) AS findings,
    CASE worst WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity
  FROM files f JOIN scores USING (file_path) LEFT JOIN (
    SELECT file_path, count(*) FILTER (category = 'vulnerability') AS vulnerabilities,
      count(*) FILTER (category = 'policy-violation') AS policy_violations, count(*) AS n, max(severity_rank) AS worst
    FROM all_findings GROUP BY file_path) USING (file_path))"""
STATUS = f"""status AS (
  SELECT rule_ord, rule_id, title AS name, description, coalesce(n, 0) AS violations
  FROM rules LEFT JOIN (SELECT rule_id, count(*) AS n FROM rule_findings WHERE category = 'policy-violation' GROUP BY rule_id)
  USING (rule_id))"""
FALSE_POSITIVES = """false_positives AS (
  SELECT finding_id FROM all_findings
  WHERE regexp_extract(file_path, 'doc_(\\d+)', 1) IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1))"""
_HAY = ("lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(file_path, ''), "
        "coalesce(recommendation, ''), coalesce(snippet, '')))")

RECOMMENDATIONS = """recommendations AS (
  SELECT 1 AS ord, 1 AS priority, 'vulnerability' AS category,
    'Fix ' || critical_count || ' critical findings first' AS title,
    'They can be exploited as they stand; settle them before anything ships.' AS description,
    'medium' AS effort, 'high' AS impact FROM summary WHERE critical_count > 0
  UNION ALL SELECT 2, 2, 'ai-generated', 'Most files look machine-written: plan a thorough review',
    ai_generated_files || ' of ' || files_scanned || ' files look machine-written. Check correctness, edge cases and fit.',
    'high', 'high' FROM summary WHERE ai_generated_files > files_scanned * 0.5
  UNION ALL SELECT 3, 1, 'malicious', 'Malicious code patterns found: act now',
    'Some code looks as if it steals data or records keys. Remove it and investigate.', 'low', 'high'
    FROM summary WHERE has_malicious
  UNION ALL SELECT 4, 3, 'vulnerability', 'Work through ' || high_count || ' findings of high severity',
    'Plan them for the next iteration.', 'medium', 'medium' FROM summary WHERE high_count > 5)"""

# --- commands ----------------------------------------------------------------------

_SHELL_PLAIN = {5: r"""\bchmod\s+(?:-[a-zA-Z]+\s+)*(?:[0-7]?[0-7]{2}[2367]|(?:[ao]+\+[rxXst]*w[rwxXst]*|a\+rwx))(?:\s|$)"""}
_SHELL_HITS = ", ".join(
    f"CASE WHEN regexp_matches(command, {rx(_SHELL_PLAIN.get(i, r.pattern), r.flags)}) THEN {i} END"
    for i, r in enumerate(SHELL_RULES))
_SHELL_TABLE = ", ".join(
    f"({i}, {q(r.issue_type)}, {q(r.severity)}, {SEVERITY_RANK[r.severity]}, {q(r.description)}, {q(r.suggestion)})"
    for i, r in enumerate(SHELL_RULES))
SHELL = f"""shell_rules(i, type, severity, rank, description, suggestion) AS (VALUES {_SHELL_TABLE}),
commands AS (SELECT doc_id AS cmd_id, n_chars, {pick(COMMANDS, 'doc_id')} || ' # ' || text AS command FROM documents),
hit AS (SELECT cmd_id, n_chars, command, unnest([{_SHELL_HITS}]) AS i FROM commands),
analyzed AS (
  SELECT cmd_id, any_value(n_chars) AS n_chars, any_value(command) AS command,
    CASE max(rank) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS risk_level,
    coalesce(string_agg(type || ':' || severity, ';' ORDER BY i), '') AS issues, count(rank) AS n_issues,
    arg_min(suggestion, i) AS suggestion
  FROM hit LEFT JOIN shell_rules USING (i) GROUP BY cmd_id)"""

# --- fixes -------------------------------------------------------------------------

_DECL = rx(R.DECLARATION)
CONTEXT = f"""located AS (
  SELECT a.finding_id, a.start_line, a.end_line, a.title, a.category, a.severity, a.description, a.recommendation,
    a.snippet, a.file_path, f.lines, a.start_line - 1 AS s0, least(len(f.lines) - 1, a.end_line - 1) AS e0
  FROM all_findings a JOIN files f USING (file_path)),
started AS (
  SELECT *, coalesce(list_max(list_filter(range(greatest(0, s0 - 80), s0 + 1),
      lambda i: regexp_matches(lines[i + 1], {_DECL}))), greatest(0, s0 - 10)) AS m0 FROM located),
depths AS (
  SELECT *, list_transform(range(m0, least(len(lines) - 1, e0 + 150) + 1), lambda i: {{'i': i,
    'up': length(lines[i + 1]) - length(replace(lines[i + 1], '{{', '')),
    'down': length(lines[i + 1]) - length(replace(lines[i + 1], '}}', ''))}}) AS d FROM started),
spread AS (SELECT finding_id, e0, unnest(d) AS x FROM depths),
running AS (
  SELECT finding_id, e0, x.i AS i, sum(x.up - x.down) OVER w AS depth, sum(x.up) OVER w AS opened
  FROM spread WINDOW w AS (PARTITION BY finding_id ORDER BY x.i)),
closed AS (SELECT finding_id, min(i) AS stop FROM running WHERE opened > 0 AND depth <= 0 AND i >= e0 GROUP BY finding_id),
context AS (
  SELECT * EXCLUDE (context_end), m0 + 1 AS first_line, context_end + 1 AS last_line,
    array_to_string(lines[m0 + 1:context_end + 1], chr(10)) AS context
  FROM (SELECT started.*, coalesce(stop, least(len(lines) - 1, e0 + 20)) AS context_end
        FROM started LEFT JOIN closed USING (finding_id)))"""
FIXES = f"""fix_replies AS (
  SELECT finding_id, {pick(FIX_REPLIES, "(start_line + length(file_path))")} AS reply FROM all_findings),
fixes AS (
  SELECT finding_id, file_path, start_line, end_line,
    CASE WHEN reply IS NULL THEN 'call failed' WHEN NOT fenced THEN 'no code block'
      WHEN contains(low, lower(title)) OR contains(low, lower(description[1:40])) OR contains(low, 'suggested fix')
        OR contains(low, '% confidence') OR contains(low, 'policy violation') THEN 'description instead of code' END AS reject_reason,
    block FROM (
    SELECT *, regexp_matches(reply, {rx(M.FENCED_BLOCK)}) AS fenced,
      trim(regexp_extract(reply, {rx(M.FENCED_BLOCK)}, 1), {WS}) AS block,
      lower(trim(regexp_extract(reply, {rx(M.FENCED_BLOCK)}, 1), {WS})) AS low
    FROM all_findings JOIN fix_replies USING (finding_id)))"""


# --- one statement per query -------------------------------------------------------


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _excluded(patterns) -> str:
    plain = names(p for p in patterns if "*" not in p)
    globs = "".join(f" OR c GLOB {q(p)}" for p in patterns if "*" in p)
    return (f"len(list_filter(string_split(file_path, '/'), lambda c: c IN ({plain}){globs} OR (starts_with(c, '.') "
            f"AND NOT starts_with(c, '.env') AND c NOT IN ({names(ALLOWED_HIDDEN)})))) > 0")


def _collected(max_kb: int | None) -> str:
    name = "regexp_extract(file_path, '([^/]*)$', 1)"
    ext = f"lower(regexp_extract({name}, '[^.].*?(\\.[^.]*)$', 1))"
    excludes = [*MANDATORY_EXCLUDES, *ScanConfig().exclude_patterns]
    return (f"({ext} IN ({names(SCANNABLE_EXTENSIONS)}) OR ({ext} = '' AND {name} IN ({names(SCANNABLE_BASENAMES)})))"
            + ("" if max_kb is None else f" AND size_bytes <= {max_kb * 1024}") + f" AND NOT ({_excluded(excludes)})")


def _simple(source: str) -> str:
    return f"SELECT {FINDING_COLUMNS} FROM {source}"


def _region() -> str:
    start, end = REGION
    return FILES.replace("files AS MATERIALIZED", "whole AS MATERIALIZED", 1) + f""",
files AS MATERIALIZED (SELECT file_path, base, ext, array_to_string(lines[{start}:{end}], chr(10)) AS code,
  lines[{start}:{end}] AS lines FROM whole)"""


def _policy(rule_id: str) -> str:
    return _with(f"{FILES}, {findings(active_rules(POLICY_RULES, [rule_id]))}",
                 "SELECT file_path, start_line, snippet, severity, rule_id FROM rule_findings")


def _status_only(rules) -> str:
    return f"{FILES}, {findings(rules)}, {STATUS}"


_NORMAL = ("list_reduce(list_prepend('', string_split(p, '/')), lambda acc, c: CASE WHEN c = '' OR c = '.' THEN acc "
           "WHEN c = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || c END)")
_TARGETS = f"""targets AS (
  SELECT {pick(("../", "a/../../", "", "/etc/", "/workspace/project/", "./x/..//", "/workspace/project-evil/",
                "..", "b/../", "../project/"), "page_id")} || regexp_replace(url, '^https?://', '') AS target FROM pages
  UNION ALL
  SELECT {pick(("src/", "../../", "/workspace/project/../", "..hidden/", "/"), "doc_id")} || source || '/../'
    || CAST(doc_id AS VARCHAR) FROM documents),
absolute AS (
  SELECT target, {_NORMAL} AS a FROM (
    SELECT target, CASE WHEN starts_with(target, '/') THEN target ELSE '{ROOT}/' || target END AS p FROM targets))"""

_R6 = "round({0}, 6) AS {0}"


def _score_prompt() -> str:
    ext = "string_split(file_path, '.')[-1]"
    start = "substring(code, (chunk - 1) * 1800 + 1, 1800)"
    return (f"'How likely was this ' || {ext} || ' file written by a language model? Weigh depth of domain knowledge, "
            "generic wording and edge cases. Answer with JSON only: {\"score\": <0.0 to 1.0>, \"reason\": \"<one sentence>\"}' "
            f"|| chr(10) || '```' || {ext} || chr(10) || {start} || chr(10) || '```'")


_GUIDANCE = f"""replied AS (
  SELECT a.*, {pick(GUIDANCE_REPLIES, 'a.n_chars')} AS reply FROM analyzed a),
read AS (SELECT *, nullif(regexp_extract(reply, {rx(L.WIDEST_OBJECT)}), '') AS obj FROM replied)"""

# Fixes from the top of the file down; one that starts inside an earlier one stays out.
_PICK_FIX = """ordered AS (
  SELECT file_path, finding_id, block, greatest(0, start_line - 1) AS a, end_line AS e,
    row_number() OVER (PARTITION BY file_path ORDER BY greatest(0, start_line - 1), end_line, finding_id) AS r
  FROM fixes WHERE reject_reason IS NULL),
walk AS (
  SELECT o.*, true AS used, greatest(e, a) AS cursor FROM ordered o WHERE r = 1
  UNION ALL
  SELECT o.*, o.a >= w.cursor, CASE WHEN o.a >= w.cursor THEN greatest(o.e, o.a) ELSE w.cursor END
  FROM walk w JOIN ordered o ON o.file_path = w.file_path AND o.r = w.r + 1),
cut AS (
  SELECT file_path, regexp_split_to_array(code, '\\r?\\n') AS l, contains(code, chr(13) || chr(10)) AS crlf
  FROM files SEMI JOIN walk USING (file_path)),
kept_lines AS (
  SELECT file_path, n::DOUBLE AS place, l[n] AS line FROM (SELECT file_path, l, unnest(range(1, len(l) + 1)) AS n FROM cut) x
  WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.file_path = x.file_path AND w.used AND x.n > w.a AND x.n <= w.e)),
put_lines AS (
  SELECT file_path, a + 0.5 AS place, CASE WHEN length(base) > length(regexp_extract(fixed[1], """ + rx(r"^(\s*)") + """, 1))
    THEN array_to_string(list_transform(fixed, lambda x: base || ltrim(x, """ + WS + """)), chr(10)) ELSE array_to_string(fixed, chr(10)) END AS line
  FROM (SELECT w.file_path, a, regexp_split_to_array(block, '\\r?\\n') AS fixed,
          regexp_extract(coalesce(l[a + 1], ''), """ + rx(r"^(\s*)") + """, 1) AS base
        FROM walk w JOIN cut USING (file_path) WHERE used))"""

_PROMPT_FIX = (
    "'Repair this problem in a piece of source code.' || chr(10) || chr(10) || 'Problem: ' || title || chr(10) || 'Kind: ' || category"
    " || chr(10) || 'Severity: ' || severity || chr(10) || 'Details: ' || description || chr(10) || 'Advice: '"
    " || coalesce(recommendation, 'Use the safe idiom of the language') || chr(10) || chr(10) || 'Lines ' || start_line || ' to ' || end_line"
    " || ':' || chr(10) || '```' || chr(10)"
    " || snippet"
    " || chr(10) || '```' || chr(10) || chr(10) || 'Surrounding function:' || chr(10) || '```' || chr(10)"
    " || context"
    " || chr(10) || '```' || chr(10) || chr(10) || 'Answer with one fenced block that replaces the quoted lines. Keep lines that are not"
    " part of the problem, keep the indentation, and explain nothing outside the block.'")

_POLICY_SCAN = f"{FILES}, {findings(POLICY_RULES)}"
_VULN_SCAN = f"{FILES}, {findings(VULNERABILITY_RULES)}"
_AUTHOR = f"{FILES}, {SIGNALS}, {scores()}"
_CUSTOM = active_rules(add_rule(POLICY_RULES, CUSTOM_RULE), CUSTOM_ACTIVE)

_REPORT = f"""top10 AS (
  SELECT *, row_number() OVER (ORDER BY severity_rank DESC, {ORDER}) - 1 AS p FROM all_findings
  QUALIFY p < 10),
advised AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS p FROM recommendations),
blocks AS (
  SELECT 0 AS section, 0 AS ord, '' AS name, ['# Code audit', '', 'Project: {PROJECT}', 'Started: {TIMES[0]}', 'Ended: {TIMES[1]}',
    'Took: ' || date_diff('second', TIMESTAMP '{TIMES[0]}', TIMESTAMP '{TIMES[1]}') || ' s', '', '---', '', '## Overview', '',
    '| Count of | Number |', '|---|---|',
    '| Files read | ' || files_scanned || ' |', '| Files left out | ' || files_skipped || ' |',
    '| Findings | ' || total_findings || ' |', '| Critical | ' || critical_count || ' |',
    '| High | ' || high_count || ' |', '| Medium | ' || medium_count || ' |', '| Low | ' || low_count || ' |',
    '| Files of machine authorship | ' || ai_generated_files || ' (' || printf('%.1f', average_ai_score * 100) || '% mean) |',
    '', '---', '', '## What to do', ''] AS l FROM summary
  UNION ALL SELECT 1, p, '', ['### ' || (p + 1) || '. ' || title, '', description, '', '- Order: ' || priority,
    '- Work: ' || effort, '- Gain: ' || impact, ''] FROM advised
  UNION ALL SELECT 2, 0, '', ['---', '', '## Worst findings', '']
  UNION ALL SELECT 3, p, '', ['### ' || upper(severity) || ': ' || title, '- Place: ' || file_path || ':' || start_line,
    '- Kind: ' || category, '- Sureness: ' || CAST(floor(confidence * 100 + 0.5) AS INT) || '%', '', '```',
    snippet, '```', '', coalesce('> Advice: ' || recommendation, ''), ''] FROM top10
  UNION ALL SELECT 4, 0, '', ['---', '', '## Files', '', '| Path | Language | Lines | Machine | Weak points | Rules broken | Worst |',
    '|---|---|---|---|---|---|---|']
  UNION ALL SELECT 5, 0, file_path, ['| ' || concat_ws(' | ', file_path, language, CAST(lines_of_code AS VARCHAR),
    CAST(floor(ai_score * 100 + 0.5) AS INT) || '%', CAST(vulnerabilities AS VARCHAR), CAST(policy_violations AS VARCHAR), severity)
    || ' |'] FROM results
  UNION ALL SELECT 6, 0, '', ['', '---'])"""

ORACLE: dict[str, str] = {
    "flagship_severity_by_language": _with(
        f"{FILES}, {findings(catalog())}", f"SELECT {LANGUAGE} AS language, count(*) AS total_findings, {_COUNTS} FROM rule_findings JOIN "
              "(SELECT file_path, base FROM files) USING (file_path) GROUP BY 1"),
    "discover_files": _with(FILES, f"SELECT file_path, size_bytes FROM files WHERE {_collected(SMALL_KB)}"),
    "list_files_query": _with(FILES, f"""SELECT * FROM (
      SELECT file_path, regexp_extract(file_path, '([^/]*)$', 1) AS name, regexp_extract(file_path, '\\.([^./]+)$', 1) AS ext
      FROM files WHERE regexp_extract(file_path, '\\.([^./]+)$', 1) IN ({names(S.LISTED_EXTENSIONS)})
        AND NOT list_has_any(string_split(file_path, '/'), [{names(S.LISTED_EXCLUDES)}])
) WHERE contains(lower(file_path), 'src1')"""),
    "list_tree": _with(FILES, f"""SELECT file_path FROM (SELECT file_path, string_split(file_path, '/')[2:] AS p FROM files
      WHERE starts_with(file_path, 'src/')) WHERE len(p) <= 2
      AND len(list_filter(p, lambda c: c IN ({names(S.TREE_SKIPPED)}) OR starts_with(c, '.'))) = 0"""),
    "file_exists": _with(FILES, """SELECT w AS file_path, w IN (SELECT file_path FROM files) AS "exists" FROM (
      SELECT 'src/src' || (doc_id % 20) || '/doc_' || doc_id || '.ts' AS w FROM labels)"""),
    "path_confinement": _with(_TARGETS, f"""SELECT target, CASE WHEN a = '' THEN '/' ELSE a END AS resolved,
      a = '{ROOT}' OR (starts_with(a, '{ROOT}/') AND NOT starts_with(a, '{ROOT}/..')) AS inside FROM absolute"""),
    "file_preview": _with(FILES, f"""SELECT file_path, CAST(n AS INTEGER) AS n, lines[n] AS text, CAST(len(lines) AS INTEGER) AS total
      FROM (SELECT file_path, lines, unnest(range(1, len(lines) + 1)) AS n FROM files)"""),
    "region_slice": _with(_region(), "SELECT file_path, code FROM files"),
    "region_findings": _with(f"{_region()}, {findings(VULNERABILITY_RULES)}", _simple("rule_findings")),
    "language_loc": _with(FILES, f"""SELECT {LANGUAGE} AS language, count(*) AS files,
      CAST(sum(len(lines)) AS BIGINT) AS lines_of_code FROM files GROUP BY 1"""),
    "vuln_findings": _with(_VULN_SCAN, _simple("rule_findings")),
    "malicious_findings": _with(f"{FILES}, {findings(MALICIOUS_RULES)}", _simple("rule_findings")),
    "policy_findings": _with(_POLICY_SCAN, _simple("rule_findings")),
    "license_check": _policy("license-compliance"),
    "async_without_await": _policy("no-async-without-await"),
    "all_findings": _with(FULL, _simple("all_findings").replace("confidence", _R6.format("confidence"))),
    **{f"signal_{name}": _with(f"{FILES}, {SIGNALS}", f"SELECT file_path, {_R6.format(column)} FROM signals")
       for name, column in (("entropy", "entropy_burstiness"), ("comment_patterns", "comment_patterns"),
                            ("generic_identifiers", "generic_identifier_score"), ("boilerplate", "boilerplate"),
                            ("structure", "structure_uniformity"), ("comment_density", "comment_density"),
                            ("line_length", "line_length_uniformity"))},
    "authorship_score": _with(_AUTHOR, f"""SELECT file_path, {_R6.format('ai_score')}, {_R6.format('heuristic_score')}, tier,
      CAST(lines_total AS INTEGER) AS lines_total, lines_ai FROM scores"""),
    "authorship_interval": _with(_AUTHOR, "SELECT file_path, interval_lo, interval_hi FROM scores"),
    "authorship_tiers": _with(_AUTHOR, """SELECT tier, CASE WHEN ai_score > 0.8 THEN 'critical' WHEN ai_score > 0.65 THEN 'high'
        WHEN ai_score > 0.4 THEN 'medium' ELSE 'low' END AS band,
      CASE WHEN ai_score > 0.8 THEN 'almost surely a model' WHEN ai_score > 0.65 THEN 'probably a model'
        WHEN ai_score > 0.4 THEN 'perhaps a model''s help' ELSE 'probably a person' END AS label,
      count(*) AS files, round(avg(ai_score), 6) AS mean_score FROM scores GROUP BY 1, 2, 3"""),
    "ai_findings": _with(f"{_AUTHOR}, {AI_FINDINGS}",
                         _simple("ai_findings").replace("confidence", _R6.format("confidence"))),
    "score_requests": _with(FILES, f"""SELECT file_path, CAST(chunk AS INTEGER) AS chunk,
      CAST(length(substring(code, (chunk - 1) * 1800 + 1, 1800)) AS INTEGER) AS chars, {_score_prompt()} AS prompt,
      80 AS max_tokens, 0.1::DOUBLE AS temperature
      FROM (SELECT *, unnest(range(1, greatest(CAST(ceil(length(code) / 1800.0) AS BIGINT), 1) + 1)) AS chunk FROM files)"""),
    "provider_pick": _with(f"{FILES}, {PARSED}", "SELECT file_path, provider, reply FROM picked"),
    "reply_parse": _with(f"{FILES}, {PARSED}", f"SELECT file_path, {_R6.format('reply_score')}, reply_reason FROM parsed"),
    "blended_score": _with(f"{FILES}, {PARSED}, {SIGNALS}, {scores(True)}", f"""SELECT file_path, {_R6.format('ai_score')},
      {_R6.format('heuristic_score')}, {_R6.format('ai_analysis_score')}, analysis_model, ai_reason, tier FROM scores"""),
    "risk_score": _with(_VULN_SCAN, f"""SELECT file_path, count(*) AS vulnerabilities, count(*) FILTER (severity = 'critical') AS criticals,
      round(least(10.0::DOUBLE, sum({_RISK})::DOUBLE / (count(*) * 10) * 10 + count(*) FILTER (severity = 'critical') * 2), 6) AS risk_score
      FROM rule_findings GROUP BY file_path"""),
    "file_results": _with(f"{FULL}, {RESULTS}", f"""SELECT file_path, language, lines_of_code, {_R6.format('ai_score')}, vulnerabilities,
      policy_violations, findings, severity FROM results"""),
    "scan_summary": _with(f"{FULL}, {SUMMARY}", f"SELECT * REPLACE (round(average_ai_score, 6) AS average_ai_score) FROM summary"),
    "project_summary": _with(
        f"{FULL}, {SUMMARY}".replace("files AS MATERIALIZED", "every AS MATERIALIZED", 1).replace(
            ", rules(rule_ord", f", files AS MATERIALIZED (SELECT * FROM every WHERE {_collected(None)}), rules(rule_ord", 1),
        "SELECT * REPLACE (round(average_ai_score, 6) AS average_ai_score) FROM summary"),
    "scan_history": _with(FILES, f"""SELECT 'a-second' AS scan_id, file_path, {LANGUAGE} AS language,
      CAST(len(lines) AS INTEGER) AS lines_of_code FROM files WHERE {_collected(None)}"""),
    "policy_status": _with(_status_only(POLICY_RULES), "SELECT * FROM status"),
    "policy_scores": _with(_POLICY_SCAN, f"""SELECT file_path, coalesce(n, 0) AS violations,
      array_to_string(list_filter([{names(r.rule_id for r in POLICY_RULES)}], lambda x: NOT list_contains(coalesce(broken, []::VARCHAR[]), x)), ',') AS passed,
      CAST(floor(({len(POLICY_RULES)} - len(coalesce(broken, []::VARCHAR[])))::DOUBLE / {len(POLICY_RULES)} * 100 + 0.5) AS INTEGER) AS score
      FROM files LEFT JOIN (SELECT file_path, count(*) AS n, list(DISTINCT rule_id) AS broken FROM rule_findings GROUP BY file_path)
      USING (file_path)"""),
    "compliance": _with(_status_only(POLICY_RULES), """SELECT *, CASE WHEN percent >= 80 THEN 'low' WHEN percent >= 50 THEN 'medium'
      ELSE 'critical' END AS band FROM (SELECT count(*) AS policies, count(*) FILTER (violations = 0) AS passing,
      CAST(sum(violations) AS BIGINT) AS total_violations,
      CAST(floor(count(*) FILTER (violations = 0)::DOUBLE / count(*) * 100 + 0.5) AS INTEGER) AS percent FROM status)"""),
    "custom_rules": _with(_status_only(_CUSTOM), "SELECT * FROM status"),
    "category_shares": _with(FULL, """SELECT category, n AS findings, round(n::DOUBLE / max(n) OVER (), 6) AS share
      FROM (SELECT category, count(*) AS n FROM all_findings GROUP BY category)"""),
    "severity_shares": _with(FULL, """SELECT ord, s AS severity, n AS findings, round(n::DOUBLE / greatest(max(n) OVER (), 1), 6) AS share
      FROM (SELECT ord, s, count(severity) AS n FROM (VALUES (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low')) v(ord, s)
        LEFT JOIN all_findings ON severity = s GROUP BY ord, s)"""),
    "top_findings": _with(FULL, _simple(f"all_findings ORDER BY severity_rank DESC, {ORDER} LIMIT 10").replace(
        "confidence", _R6.format("confidence"), 1)),
    "top_findings_per_file": _with(FULL, f"""SELECT file_path, CAST(p AS INTEGER) AS position, rule_id, start_line, match_ord FROM (
      SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {ORDER}) AS p FROM all_findings) WHERE p <= 5"""),
    "top_ai_files": _with(_AUTHOR, f"""SELECT file_path, {_R6.format('ai_score')}, CASE WHEN ai_score > 0.8 THEN 'critical'
      WHEN ai_score > 0.65 THEN 'high' WHEN ai_score > 0.4 THEN 'medium' ELSE 'low' END AS band
      FROM (SELECT * FROM scores ORDER BY round(ai_score, 12) DESC, file_path LIMIT 20)"""),
    "search_findings": _with(FULL, f"""SELECT finding_id, file_path, rule_id, start_line FROM all_findings
      WHERE category = 'vulnerability' AND severity = 'critical' AND contains({_HAY}, 'token')"""),
    "hide_false_positives": _with(f"{FULL}, {FALSE_POSITIVES}", """SELECT finding_id, file_path, rule_id FROM all_findings
      WHERE finding_id NOT IN (SELECT finding_id FROM false_positives)"""),
    "visible_counts": _with(f"{FULL}, {FALSE_POSITIVES}", """SELECT
      (SELECT count(*) FROM all_findings WHERE severity = 'high' AND finding_id NOT IN (SELECT finding_id FROM false_positives)) AS filtered,
      (SELECT count(*) FROM all_findings) - (SELECT count(DISTINCT finding_id) FROM false_positives) AS visible_total,
      (SELECT count(DISTINCT finding_id) FROM false_positives) AS hidden"""),
    "shell_risk": _with(SHELL, "SELECT cmd_id, risk_level, issues, suggestion FROM analyzed"),
    "shell_guidance": _with(f"{SHELL}, {_GUIDANCE}", """SELECT cmd_id, risk_level,
      CASE WHEN n_issues > 0 AND reply IS NOT NULL THEN CASE WHEN json_valid(obj) THEN obj::JSON ->> '$.suggestion' END
        ELSE suggestion END AS suggestion,
      CASE WHEN n_issues > 0 AND json_valid(obj) THEN obj::JSON ->> '$.saferAlternative' END AS safer_alternative FROM read"""),
    "guidance_requests": _with(SHELL, """SELECT cmd_id, 'Say how this shell command can be made safer.' || chr(10) || chr(10)
      || 'Command: ' || any_value(command) || chr(10) || 'Issues found: ' || string_agg(description, '; ' ORDER BY i) || chr(10) || chr(10)
      || 'Answer with JSON only: {"suggestion": "<short tip>", "saferAlternative": "<command or null>"}' AS prompt,
      200 AS max_tokens, 0.1::DOUBLE AS temperature FROM hit JOIN shell_rules USING (i) GROUP BY cmd_id"""),
    "finding_context": _with(f"{FULL}, {CONTEXT}", """SELECT finding_id, file_path, start_line, CAST(first_line AS INTEGER) AS first_line,
      CAST(last_line AS INTEGER) AS last_line, context FROM context"""),
    "fix_requests": _with(f"{FULL}, {CONTEXT}", f"""SELECT finding_id, {_PROMPT_FIX} AS prompt, 1024 AS max_tokens,
      0.1::DOUBLE AS temperature FROM context"""),
    "fix_validation": _with(f"{FULL}, {FIXES}", """SELECT finding_id, file_path, start_line, end_line, reject_reason,
      CASE WHEN reject_reason IS NULL THEN block END AS sanitized_code FROM fixes"""),
    "attach_fixes": _with(f"{FULL}, {FIXES}", """SELECT finding_id, file_path, CASE WHEN reject_reason IS NULL THEN block END
      AS sanitized_code FROM fixes"""),
    "apply_fix": _with(f"{FULL}, {FIXES}, {_PICK_FIX}", """SELECT cut.file_path, CAST(f.n AS INTEGER) AS applied, f.conflicts,
        CASE WHEN crlf THEN replace(t.body, chr(10), chr(13) || chr(10)) ELSE t.body END AS code
      FROM cut JOIN (SELECT file_path, string_agg(line, chr(10) ORDER BY place) AS body
          FROM (FROM kept_lines UNION ALL FROM put_lines) GROUP BY file_path) t USING (file_path)
        JOIN (SELECT file_path, count(*) FILTER (used) AS n,
          coalesce(string_agg(finding_id, ',' ORDER BY r) FILTER (NOT used), '') AS conflicts FROM walk GROUP BY file_path) f
        USING (file_path)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "recommendations": _with(f"{FULL}, {SUMMARY}, {RECOMMENDATIONS}", "SELECT * FROM recommendations"),
    "report_json": _with(f"{FULL}, {SUMMARY}, {RECOMMENDATIONS}", """SELECT CAST(to_json({
        'summary': {'files_scanned': files_scanned, 'files_skipped': files_skipped, 'total_findings': total_findings,
          'critical_count': critical_count, 'high_count': high_count, 'medium_count': medium_count, 'low_count': low_count,
          'has_malicious': has_malicious, 'ai_generated_files': ai_generated_files,
          'average_ai_score': round(average_ai_score, 6)},
        'recommendations': (SELECT coalesce(list({'ord': ord, 'priority': priority, 'category': category, 'title': title,
          'description': description, 'effort': effort, 'impact': impact} ORDER BY ord), []) FROM recommendations)}) AS VARCHAR) AS value
      FROM summary"""),
    "report_lines": _with(f"{FULL}, {SUMMARY}, {RESULTS}, {RECOMMENDATIONS}, {_REPORT}", """SELECT section, CAST(ord AS INTEGER) AS ord, name,
      CAST(sub - 1 AS INTEGER) AS sub, l[sub] AS line FROM (SELECT section, ord, name, l, unnest(range(1, len(l) + 1)) AS sub FROM blocks)"""),
}

SAVES = f"""files AS MATERIALIZED (
  SELECT *, strlen(code) AS size_bytes,
    lower(regexp_extract(file_path, '([^/]*)$', 1)) AS base,
    lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) AS ext,
    string_split(code, chr(10)) AS lines
  FROM (SELECT 'u' || CAST(user_id AS VARCHAR) AS folder, strftime(ts, '%Y-%m-%d') AS day,
      'u' || CAST(user_id AS VARCHAR) || '/e' || CAST(event_id AS VARCHAR) || {pick([s[0] for s in SNIPPETS], 'event_id')} AS file_path,
      {pick([s[1] for s in SNIPPETS], 'event_id')} || chr(10) || '// ' || event_type AS code FROM events))"""
DAYS = """days AS (SELECT day, severity, count(*) AS findings FROM rule_findings JOIN (SELECT file_path, day FROM files) USING (file_path)
  GROUP BY day, severity)"""

ORACLE |= {
    "indexed_rules": _with(f"{FILES}, {findings(active_rules(add_rule(POLICY_RULES, CUSTOM_RULE), CUSTOM_ACTIVE))}",
                           "SELECT finding_id, file_path, rule_id, start_line FROM rule_findings"),
    "distinct_saves": _with(SAVES, "SELECT DISTINCT folder, sha256(code) AS digest FROM files"),
    "daily_findings": _with(f"{SAVES}, {findings(VULNERABILITY_RULES)}, {DAYS}", "SELECT day, severity, findings FROM days"),
    "gated_days": _with(f"{SAVES}, {findings(VULNERABILITY_RULES)}, {DAYS}", """SELECT day, severity, findings,
        round(coalesce(e, 0), 6) AS expected, round(findings / e, 6) AS deviation, findings <= coalesce(e, 0) * 1.1::DOUBLE + 1 AS passed
      FROM days LEFT JOIN (SELECT severity, sum(findings) / 10::DOUBLE AS e FROM days WHERE day <= '2024-01-10' GROUP BY severity) USING (severity)"""),
    "tree_files": _with(FILES, f"""SELECT file_path, size_bytes, md5(code) AS digest FROM files
      WHERE {_collected(SMALL_KB)} AND starts_with(file_path, 'src/')"""),
    "written_fixes": f"SELECT file_path, strlen(code) AS size_bytes, md5(code) AS digest FROM ({ORACLE['apply_fix']})",
    "single_file": _with(f"{FILES}, {findings(VULNERABILITY_RULES)}", f"{_simple('rule_findings')} WHERE file_path = {q(ONE_FILE)}"),
    "skipped_files": _with(FILES, f"""SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM files
      WHERE {_collected(None)} AND size_bytes > {SMALL_KB * 1024}"""),
    "severity_rollup": _with(f"{FILES}, {findings(catalog())}", f"""SELECT language, severity,
        CAST(GROUPING_ID(language, severity) AS INTEGER) AS level, count(*) AS findings, count(DISTINCT file_path) AS files
      FROM (SELECT {LANGUAGE} AS language, severity, file_path FROM rule_findings JOIN (SELECT file_path, base FROM files) USING (file_path))
      GROUP BY ROLLUP (language, severity)"""),
    "scan_difference": _with(f"{FILES}, {findings(VULNERABILITY_RULES)}", f"""SELECT
        CASE WHEN size_bytes % 11 = 0 THEN 'new' WHEN size_bytes % 7 = 0 THEN 'gone' ELSE 'kept' END AS status, file_path, rule_id,
        CAST(row_number() OVER (PARTITION BY file_path, rule_id, regexp_replace(snippet, {q('[' + SPACE_CLASS + ']+')}, ' ', 'g')
          ORDER BY start_line, match_ord) AS INTEGER) AS ordinal,
        CASE WHEN size_bytes % 11 <> 0 THEN start_line END AS old_line,
        CASE WHEN size_bytes % 7 <> 0 THEN CAST(start_line + CASE WHEN size_bytes % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) END AS new_line
      FROM rule_findings JOIN (SELECT file_path, size_bytes FROM files) USING (file_path) WHERE size_bytes % 11 <> 0 OR size_bytes % 7 <> 0"""),
}
