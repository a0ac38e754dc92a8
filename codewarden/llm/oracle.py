"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from codewarden.llm.licences import KNOWN

# Own constants, so that the SQL does not follow a mistake of the operator.
_QUALITY = """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i:i + 4] AS win FROM w, unnest(range(1, len(ws) - 3)) t(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(5)) t(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_marks,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
        least(10 * word_chars // greatest(n_words, 1), 1000) AS word_length,
        1000 * n_marks // greatest(word_chars, 1) AS marks FROM m),
v AS (SELECT lang, source, 'g' AS kind, unnest(['symbols', 'dup_lines', 'repeats', 'word_length', 'marks']) AS metric,
        unnest([symbols, dup_lines, repeats, word_length, marks]) AS value FROM f WHERE NOT base_failed),
q AS (SELECT lang, source, metric, count(*) AS n, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3
      FROM v GROUP BY GROUPING SETS ((lang, source, metric), (metric))),
own AS (SELECT * FROM q WHERE lang IS NOT NULL AND n >= 30),
merged AS (SELECT * FROM q WHERE lang IS NULL),
lim AS (SELECT coalesce(o.metric, a.metric) AS metric, k.lang, k.source, coalesce(o.q1, a.q1) AS q1, coalesce(o.q3, a.q3) AS q3
        FROM (SELECT DISTINCT lang, source FROM d) k CROSS JOIN merged a
        LEFT JOIN own o ON o.lang = k.lang AND o.source = k.source AND o.metric = a.metric),
wide AS (SELECT lang, source, {limits} FROM lim GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND symbols <= symbols_high AND dup_lines <= dup_lines_high AND repeats <= repeats_high
       AND word_length <= word_length_high AND word_length >= word_length_low AND marks <= marks_high AS kept
FROM f JOIN wide USING (lang, source)
""".replace("{limits}", ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN {side} END) AS {m}_{name}"
    for m, slack in (("symbols", 20), ("dup_lines", 400), ("repeats", 300), ("word_length", 15), ("marks", 60))
    for name, side in (("high", f"q3 + 3 * (q3 - q1) + {slack}"), ("low", f"q1 - 3 * (q3 - q1) - {slack}"))))

_SPELLED = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
            ("non commercial", "noncommercial"), ("organisation", "organization"), ("whilst", "while"),
            ("merchantibility", "merchantability"), ("favour", "favor"), ("per cent", "percent"),
            ("copyright owner", "copyright holder"))


def _canonical(text: str) -> str:
    """SQL for the canonical lines of a text."""
    t = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^[ \t]*(copyright[ \t]+(\(c\)|©|[0-9])|©|\(c\))[^\n]*', '', 'g')"
    t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for form, term in _SPELLED:
        t = rf"regexp_replace({t}, '\b{form}\b', '{term}', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_LICENCES = f"""
WITH known AS (SELECT min(license_id) AS license_id, sha256(array_to_string(c, ' ')) AS digest
  FROM (SELECT license_id, {_canonical('body')} AS c FROM (VALUES {{known}}) k(license_id, body))
  WHERE len(c) > 0 GROUP BY digest),
d AS (SELECT doc_id, {_canonical('text')} AS c FROM documents),
n AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS names
  FROM (SELECT doc_id, unnest(c) AS line FROM d) JOIN known ON sha256(line) = digest GROUP BY doc_id)
SELECT d.doc_id, sha256(array_to_string(c, ' ')) AS text_digest, k.license_id,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, coalesce(n.names, '') AS notices
FROM d LEFT JOIN known k ON k.digest = sha256(array_to_string(c, ' ')) LEFT JOIN n USING (doc_id)
""".replace("{known}", ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN))

_AUDIT = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g
           LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source GROUP BY g.lang, g.source),
shares AS (SELECT g.lang, g.source, k.term, o.n IS NOT NULL AS there,
             1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (g.n + l.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS q
           FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
           LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE there AND p > q),
ranked AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_COLLOCATIONS = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d)),
x AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS words, w AS phrase FROM x UNION ALL SELECT lang, 2, w || ' ' || w2 FROM x WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL
      UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL),
f AS (SELECT lang, words, phrase, lang || chr(10) || phrase AS key, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
c AS (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND a >= 30),
cut AS (SELECT lang, phrase, words, a, k, lang || chr(10) || array_to_string(ws[1:k], ' ') AS x,
          lang || chr(10) || array_to_string(ws[k + 1:], ' ') AS y
        FROM c, unnest(range(1, words)) t(k)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, 2000000 * cut.a // (l.a + r.a) AS score
           FROM cut JOIN f l ON l.key = cut.x JOIN f r ON r.key = cut.y
           QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS most
         FROM c, unnest([2, 3]) s(k), unnest(range(1, words - k + 2)) t(i) WHERE k < words GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase,
       s.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored s JOIN n ON n.lang = s.lang LEFT JOIN held ON held.lang = s.lang AND held.phrase = s.phrase
WHERE most IS NULL OR 100 * most < 80 * s.a QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op2_quality_rules": _QUALITY,
    "op10_license_scan": _LICENCES,
    "op12_source_audit": _AUDIT,
    "op13_collocations": _COLLOCATIONS,
}
