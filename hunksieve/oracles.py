"""SQL for DuckDB that gives the rows of `queries`."""

from __future__ import annotations

from .operators.rules import Rule
from .queries import GLOB_RULES
from .tables import RULES, WORD_RULE

L1 = """l1 AS (
  SELECT source AS diff_id, doc_id * 1048576 + line AS idx,
    source || '/' || lang || '/doc_' || doc_id || '.' || (['rs', 'py', 'js', 'sql', 'go', 'sh', 'html', 'txt'])[doc_id % 8 + 1] AS path,
    line, content, doc_id
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents)
)"""

PLAIN_TEXT = """translate(content, '"''`/*#\\-<$', '          ')"""
#: doc_lines as code, with masks of comments and of strings by the line's number.
L2 = rf"""{L1}, l2 AS (
  SELECT *, CASE n WHEN 1 THEN mark || text || ending WHEN 2 THEN 'x = ' || quote || text || quote || ';'
    WHEN 3 THEN text || ' ' || mark || 'HUNKSIEVE: ignore word.the, other' || ending WHEN 4 THEN text || ' ' || mark || 'hunksieve: ignore-next-line' || ending ELSE text END AS content
  FROM (
    SELECT diff_id, idx, path, line, line % 5 AS n, {PLAIN_TEXT} AS text,
      CASE WHEN regexp_matches(path, '\.(py|sh)$') THEN '# ' WHEN path LIKE '%.sql' THEN '-- ' WHEN path LIKE '%.html' THEN '<!-- ' ELSE '// ' END AS mark,
      CASE WHEN path LIKE '%.html' THEN ' -->' ELSE '' END AS ending, CASE WHEN path LIKE '%.sql' THEN '''' ELSE '"' END AS quote
    FROM l1
  )
), code AS (
  SELECT *, CASE n WHEN 1 THEN repeat(' ', length(content)::INT) WHEN 3 THEN text || repeat(' ', (length(content) - length(text))::INT)
      WHEN 4 THEN text || repeat(' ', (length(content) - length(text))::INT) ELSE content END AS no_comments,
    CASE n WHEN 2 THEN 'x = ' || repeat(' ', (length(text) + 2)::INT) || ';' ELSE content END AS no_strings
  FROM l2
), masks AS (
  SELECT *, CASE n WHEN 2 THEN no_strings ELSE no_comments END AS no_both FROM code
)"""

UNICODE_TRIM = r"'[\s\p{Z}]+$'"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def events(pack: list[Rule], rows: str = "l1", text: str = "content", where: dict[str, str] | None = None, severity: dict[str, str] | None = None) -> str:
    """Matches of the rules, each by its first pattern that matches."""
    parts = []
    for i, r in enumerate(pack):
        pattern = "CASE " + " ".join(f"WHEN regexp_matches({text}, {literal(p)}) THEN " + "{" + str(k) + "}" for k, p in enumerate(r.patterns)) + " END"
        got = pattern
        before = pattern
        for k, p in enumerate(r.patterns):
            got = got.replace("{" + str(k) + "}", f"regexp_extract({text}, {literal(p)}, 0)")
            before = before.replace("{" + str(k) + "}", f"length(regexp_extract({text}, {literal('(?s)^(.*?)(?:' + p + ')')}, 1))")
        hit = " OR ".join(f"regexp_matches({text}, {literal(p)})" for p in r.patterns)
        also = f" AND ({where[r.id]})" if where and r.id in where else ""
        parts.append(
            f"SELECT diff_id, idx, path, line, content, {i} AS rule_idx, {literal(r.id)} AS rule_id, {(severity or {}).get(r.id, literal(r.severity))} AS severity, {literal(r.message)} AS message, "
            f"{before} + 1 AS col, {got} AS match_text FROM {rows} WHERE ({hit}){also}"
        )
    return "events AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


EVENTS = f"WITH {L1}, {events(RULES)}"
RANKED = f"""{EVENTS}, found AS (
  SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY idx, rule_idx, col) AS n,
    CASE WHEN length(t) > 240 THEN left(t, 240) || '…' ELSE t END AS snippet
  FROM (SELECT *, regexp_replace(content, {UNICODE_TRIM}, '') AS t FROM events)
), findings AS (SELECT * FROM found WHERE n <= 200)"""

MARK = "sha256(rule_id || ':' || path || ':' || line || ':' || match_text)"


def xml(c: str) -> str:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = f"replace({out}, {literal(a)}, {literal(b)})"
    return out


def markdown(c: str) -> str:
    return f"replace(replace(regexp_replace({c}, '[|`#*_\\[\\]>]', '\\\\\\0', 'g'), chr(13), '\\r'), chr(10), '\\n')"


def level(kind: str) -> str:
    from .functions.text import VOCABULARY

    return "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VOCABULARY[kind].items()) + " END"


def csv(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[,"\\n\\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


def tsv(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"


def counts(live: str = "TRUE") -> str:
    return ", ".join(f"count(*) FILTER (severity = '{s}' AND {live}) AS {s}" for s in ("info", "warn", "error"))


FLAT = "diff_id, rule_id, path, line, severity, col, match_text, false AS suppressed"

ORACLES = {
    "findings_basic": f"{EVENTS} SELECT {FLAT}, {MARK} AS fingerprint FROM events",
    "scoped_lines": f"WITH {L1} SELECT diff_id, idx, path, line, content FROM l1",
    "files_lines_scanned": f"WITH {L1} SELECT diff_id, count(DISTINCT path) AS files_scanned, count(*) AS lines_scanned FROM l1 GROUP BY diff_id",
    "multibase_union_dedupe": f"""WITH {L1}, both_ AS (SELECT idx, path, line, content FROM l1 UNION ALL SELECT idx + 281474976710656, path, line - line % 2, content FROM l1)
SELECT 'bases' AS diff_id, idx, path, line, content FROM (SELECT *, row_number() OVER (PARTITION BY path, line, content ORDER BY idx) AS k FROM both_) WHERE k = 1""",
    "diff_special_headers": f"""WITH {L1} SELECT diff_id, CASE doc_id % 7 WHEN 0 THEN 'named_' || doc_id || '.txt' WHEN 3 THEN 'mode_' || doc_id WHEN 4 THEN 'café_' || doc_id || '.rs' ELSE 'm_' || doc_id END AS path,
  line + CASE doc_id % 7 WHEN 0 THEN 0 WHEN 3 THEN 4 WHEN 4 THEN 0 ELSE 10 END AS line, 'x' || content AS content, 'added' AS kind FROM l1 WHERE doc_id % 7 NOT IN (1, 2, 6)""",
    "language_detect": f"""WITH {L1} SELECT DISTINCT path, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript'
  WHEN 'sql' THEN 'sql' WHEN 'go' THEN 'go' WHEN 'sh' THEN 'shell' WHEN 'html' THEN 'xml' END AS language FROM l1""",
    "glob_applicability": f"""WITH {L1}, p AS (SELECT DISTINCT path FROM l1)
SELECT path, '{GLOB_RULES[0].id}' AS rule_id, 'info' AS severity FROM p WHERE path LIKE '%.rs' AND path NOT LIKE '%/fr/%'
UNION ALL SELECT path, '{GLOB_RULES[1].id}', 'warn' FROM p WHERE (regexp_matches(path, '^src1.*/') OR regexp_matches(path, '^src2/(en|de)/doc_.\\.')) AND regexp_matches(path, '\\.(py|go|rs|js)$')
UNION ALL SELECT path, '{GLOB_RULES[2].id}', 'error' FROM p WHERE regexp_matches(path, '^src[1-3]/.')""",
    "path_filter": f"WITH {L1} SELECT path, line FROM l1 WHERE path LIKE '%.py' OR path LIKE 'src1/%'",
    "allowed_lines_semi": f"WITH {L1} SELECT path, line, content FROM l1 WHERE line IN (1, 3) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "tag_filter": """SELECT 'b.' || item_id AS rule_id, (['info', 'warn', 'error'])[item_id % 3 + 1] AS severity FROM benchmark WHERE (length(text) % 5 IN (1, 2) OR item_id % 2 = 1) AND length(text) % 5 <> 3""",
    "pattern_classes": f"""WITH {L1} SELECT path, line, 'c.minus' AS rule_id FROM l1 WHERE regexp_matches(content, '[b-df-hj-np-tv-z]{{4}}')
UNION ALL SELECT path, line, 'c.either' FROM l1 WHERE regexp_matches(content, '[0-4a-z]{{3}}')
UNION ALL SELECT path, line, 'c.edge' FROM l1 WHERE regexp_matches(content, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])the($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') OR contains(content, 'zzzz')""",
    "first_pattern_wins": f"WITH {L1}, {events([Rule('first', 'info', '', patterns=('zzzz', 'of [a-z]+', 'the [a-z]+'))])} SELECT path, line, col, match_text FROM events",
    "snippet_240": f"WITH {L1} SELECT path, line, CASE WHEN length(t) > 240 THEN left(t, 240) || '…' ELSE t END AS snippet FROM (SELECT *, regexp_replace(content, {UNICODE_TRIM}, '') AS t FROM l1)",
    "gitlab_fingerprint": f"{RANKED} SELECT diff_id, n, sha256(rule_id || path || line || col || match_text) AS fingerprint FROM found",
    "mask_line_comments": f"WITH {L2} SELECT path, line, no_comments AS masked FROM masks",
    "mask_strings": f"WITH {L2} SELECT path, line, no_strings AS masked FROM masks",
    "mask_both": f"WITH {L2} SELECT path, line, no_both AS masked FROM masks",
    "mask_multiline_block": rf"""WITH {L1}, b AS (
  SELECT path, line, line % 4 AS n, {PLAIN_TEXT} AS t, CASE WHEN path LIKE '%.html' THEN 4 WHEN regexp_matches(path, '\.(py|sh)$') THEN 0 ELSE 2 END AS k, CASE WHEN path LIKE '%.html' THEN 3 ELSE 2 END AS e FROM l1
) SELECT path, line, CASE WHEN n = 1 THEN t || ' ' || CASE k WHEN 0 THEN t ELSE repeat(' ', (length(t) + k)::INT) END
  WHEN k = 0 THEN CASE n WHEN 3 THEN t || ' ' || t ELSE t END WHEN n = 2 THEN repeat(' ', length(t)::INT) WHEN n = 3 AND line > 1 THEN repeat(' ', (length(t) + e + 1)::INT) || t ELSE t END AS masked FROM b""",
    "forced_language": f"""WITH {L1}, plain AS (SELECT * REPLACE (translate(content, '"''`/*', '     ') AS content) FROM l1),
{events([Rule('go.only', 'warn', '', patterns=('the',))], 'plain', where={'go.only': 'line % 2 = 1'})} SELECT path, line, col FROM events""",
    "multiline_match": f"""WITH {L1}, w AS (
  SELECT *, content || coalesce(chr(10) || lead(content) OVER f, '') || coalesce(chr(10) || lead(content, 2) OVER f, '') AS t, lead(line) OVER f AS l2, lead(content) OVER f AS c2, lead(line, 2) OVER f AS l3
  FROM l1 WINDOW f AS (PARTITION BY diff_id, path ORDER BY idx)
), m AS (SELECT *, regexp_extract(t, '(?s)^(.*?)(?:\\.\\n[A-Z])', 1) AS before, regexp_extract(t, '\\.\\n[A-Z]', 0) AS match_text FROM w WHERE l2 IS NOT NULL AND regexp_matches(t, '\\.\\n[A-Z]')),
a AS (SELECT *, length(before) - length(replace(before, chr(10), '')) AS n FROM m)
SELECT DISTINCT path, CASE n WHEN 0 THEN line ELSE l2 END AS line, length(list_extract(string_split(before, chr(10)), -1)) + 1 AS col, match_text FROM a""",
    "absent_mode": f"""WITH {L1} SELECT path, min(line) AS line, NULL::BIGINT AS col, '<absent>' AS match_text FROM l1
WHERE path LIKE '%.py' OR path LIKE '%.rs' GROUP BY path HAVING NOT bool_or(content LIKE '%the%')""",
    "context_required": f"""WITH {L1}, c AS (SELECT *, bool_or(content LIKE '%of the%') OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l1)
SELECT path, line, instr(content, 'with the') AS col FROM c WHERE content LIKE '%with the%' AND near""",
    "escalate_severity": f"""WITH {L1}, c AS (SELECT *, bool_or(content LIKE '%of the%') OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l1)
SELECT path, line, CASE WHEN near THEN 'warn' ELSE 'info' END AS severity FROM c WHERE content LIKE '%with the%'""",
    "override_table": f"""WITH {L1}, p AS (SELECT DISTINCT path FROM l1)
SELECT path, 'o.of' AS rule_id, path NOT LIKE 'src1/en/%' AS enabled, CASE WHEN path LIKE 'src1/%' THEN 'error' ELSE 'info' END AS severity FROM p
UNION ALL SELECT path, 'o.to', true, NULL FROM p WHERE path LIKE 'src2/%'""",
    "glob_table": f"""WITH {L1}, p AS (SELECT DISTINCT path, diff_id, doc_id FROM l1 WHERE path IS NOT NULL)
SELECT path, diff_id || '/**/doc_' || doc_id || '.*' AS glob FROM p
UNION ALL SELECT path, '**/en/doc_' || doc_id || '.{{py,rs}}' FROM p WHERE doc_id IN (SELECT doc_id FROM labels) AND path LIKE '%/en/%' AND doc_id % 8 < 2
UNION ALL SELECT path, '**/doc_' || item_id || '?.*' FROM p JOIN (SELECT DISTINCT item_id FROM benchmark) ON item_id = doc_id // 10 WHERE doc_id >= 10
UNION ALL SELECT path, '{{src1,src2}}/[a-e]?/*.?s' FROM p WHERE regexp_matches(path, '^src[12]/[a-e]./') AND doc_id % 8 IN (0, 2)""",
    "override_excludes": f"""WITH {L1}, p AS (SELECT DISTINCT path, split_part(path, '/doc_', 1) AS folder, doc_id FROM l1 WHERE path IS NOT NULL),
t AS (SELECT source || '/' || lang AS folder, doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)
SELECT path, 'q.0' AS rule_id, path LIKE '%/en/%' AND doc_id NOT IN (SELECT doc_id FROM t WHERE quality = 0) AS enabled, 'error' AS severity FROM p
UNION ALL SELECT path, 'q.1', doc_id NOT IN (SELECT doc_id FROM t WHERE quality = 1), NULL FROM p WHERE folder IN (SELECT folder FROM t WHERE quality = 1)""",
    "pack_in_scope": f"""WITH {L1}, r AS (SELECT item_id AS i, regexp_extract(text, '[a-z]{{4,}}') AS w FROM benchmark)
SELECT path, line, 'b.' || i AS rule_id FROM l1, r WHERE contains(content, w) AND regexp_matches(content, w || '[a-z]+ [^a-z]') AND path NOT LIKE '%/fr/%'
  AND (starts_with(path, 'src' || (i % 4 + 1) || '/') OR path LIKE '%.sql') AND (i % 2 = 0 OR path LIKE '%.py' OR path LIKE '%.sql')""",
    "suppressions": f"""WITH {L2}, s AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY diff_id, path ORDER BY idx) = 4, false) AS next_ FROM masks),
{events([WORD_RULE, Rule('word.of', 'warn', '', patterns=('of',))], 's', 'no_both')}
SELECT e.path, e.line, rule_id, (next_ AND e.path NOT LIKE '%.html') OR (n = 3 AND rule_id = 'word.the') AS suppressed FROM events e JOIN s USING (diff_id, idx)""",
    "event_order_cap": f'{RANKED} SELECT diff_id, n, rule_id, path, line, col AS "column", match_text, snippet FROM found WHERE n <= 7',
    "verdict_counts": f"""{EVENTS} SELECT *, CASE WHEN error > 0 THEN 'fail' WHEN warn > 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN truncated > 0 THEN 'truncated' ELSE '' END AS reason
FROM (SELECT diff_id, {counts()}, 0 AS suppressed, greatest(count(*) - 7, 0) AS truncated FROM events GROUP BY diff_id)""",
    "exit_code_matrix": f"""{EVENTS} SELECT diff_id, fail_on, CASE WHEN fail_on = 'never' THEN 0 WHEN error > 0 THEN 2 WHEN warn > 0 AND fail_on = 'warn' THEN 3 ELSE 0 END AS code,
  CASE WHEN error > 0 THEN 2 WHEN warn > 0 AND fail_on = 'warn' THEN 3 ELSE 0 END AS baseline_code
FROM (SELECT diff_id, {counts()} FROM events GROUP BY diff_id), (VALUES ('error'), ('warn'), ('never')) AS v(fail_on)""",
    "check_summary": f"""{EVENTS}, k AS (SELECT diff_id, {counts()}, greatest(count(*) - 5, 0) AS truncated FROM events WHERE path LIKE '%/en/%' AND rule_id <> 'secret.token' GROUP BY diff_id),
z AS (SELECT diff_id, count(DISTINCT path) AS files_scanned, count(*) AS lines_scanned FROM l1 WHERE path LIKE '%/en/%' GROUP BY diff_id),
j AS (SELECT diff_id, files_scanned, lines_scanned, coalesce(info, 0) AS info, coalesce(warn, 0) AS warn, coalesce(error, 0) AS error, 0 AS suppressed, coalesce(truncated, 0) AS truncated FROM z LEFT JOIN k USING (diff_id))
SELECT *, CASE WHEN error > 0 THEN 'fail' WHEN warn > 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN error > 0 THEN 2 WHEN warn > 0 THEN 3 ELSE 0 END AS exit_code FROM j""",
    "rule_hits": f"{EVENTS} SELECT diff_id, rule_id, count(*) AS total, count(*) AS emitted, 0 AS suppressed, {counts()} FROM events GROUP BY ALL",
    "rule_hits_with_fp": f"""{EVENTS}, fp AS (SELECT DISTINCT {MARK} AS f FROM events WHERE line % 2 = 0), m AS (SELECT *, {MARK} IN (SELECT f FROM fp) AS off FROM events)
SELECT diff_id, rule_id, count(*) AS total, count(*) FILTER (NOT off) AS emitted, 0 AS suppressed, {counts('NOT off')}, count(*) FILTER (off) AS false_positive FROM m GROUP BY diff_id, rule_id""",
    "fp_anti_join": f"{EVENTS} SELECT diff_id, rule_id, path, line, match_text FROM events WHERE {MARK} NOT IN (SELECT {MARK} FROM events WHERE line % 2 = 0)",
    "fp_baseline_merge": f"""{EVENTS}, e AS (SELECT DISTINCT {MARK} AS fingerprint, rule_id, path, line FROM events)
SELECT fingerprint, CASE WHEN line % 2 = 0 AND line % 4 = 0 AND line % 3 = 0 THEN '' ELSE rule_id END AS rule_id, path, CASE WHEN line % 4 = 0 AND line % 3 = 0 THEN 0 ELSE line END AS line,
  CASE WHEN line % 2 = 0 AND line % 5 = 0 THEN 'new' WHEN line % 3 <> 0 THEN 'old ' || line END AS note
FROM e WHERE line % 3 <> 0 OR line % 2 = 0""",
    "fp_normalise": f"""{EVENTS}, e AS (SELECT DISTINCT {MARK} AS fingerprint, rule_id, path, line FROM events), u AS (
  SELECT *, 'old ' || line AS note FROM e WHERE line % 3 <> 0
  UNION ALL SELECT fingerprint, CASE WHEN line % 4 = 0 THEN '' ELSE rule_id END, path, CASE WHEN line % 4 = 0 THEN 0 ELSE line END, CASE WHEN line % 5 = 0 THEN 'new' END FROM e WHERE line % 2 = 0)
SELECT fingerprint, rule_id, path, line, note FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY rule_id, path, line, note NULLS LAST) AS k FROM u) WHERE k = 1""",
    "baseline_classes": f"""{EVENTS} SELECT diff_id, rule_id, path, line, match_text, CASE WHEN line % 2 = 0 THEN 'baseline' ELSE 'new' END AS class FROM events""",
    "baseline_exit": f"{EVENTS}, c AS (SELECT {counts('line % 2 = 1')} FROM events) SELECT *, CASE WHEN error > 0 THEN 2 ELSE 0 END AS code FROM c",
    "blame_author_age": """WITH b AS (SELECT 'f' || user_id AS path, event_id AS line, lower('User ' || user_id || ' <U' || user_id || '@x.org>') AS who, epoch(ts)::BIGINT AS t FROM events)
SELECT DISTINCT path, line FROM b WHERE (contains(who, 'user 1') OR contains(who, 'u7@')) AND t > 0 AND ((SELECT max(t) FROM b) - t) // 86400 <= 20""",
    "lines_of_blame": f"""WITH {L1}, b AS (SELECT *, lower(split_part(path, '/', 2) || ' <' || diff_id || '@x.org>') AS who FROM l1) SELECT path, line, content FROM b WHERE (contains(who, 'en') OR contains(who, 'src2@')) AND 30 - line <= 20""",
    "blame_porcelain": """WITH o AS (SELECT l_orderkey AS k, count(*) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
SELECT 'p' || (k % 97) AS path, k * 10 + i AS line, 'S' || s AS author, '<' || s || '>' AS author_mail, s * 1000 AS author_time FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM o)""",
    "trend_totals": """SELECT count(*) AS run_count, sum(v)::BIGINT AS info, sum(c)::BIGINT AS warn, sum(e)::BIGINT AS error, sum(p)::BIGINT AS suppressed, sum(n)::BIGINT AS findings FROM (
  SELECT ts::DATE AS d, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p, count(*) AS n FROM events GROUP BY 1)""",
    "trend_delta": """WITH r AS (SELECT datediff('day', DATE '1970-01-01', ts::DATE) AS seq, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p, count(*) AS n FROM events GROUP BY 1),
d AS (SELECT seq, v - lag(v) OVER w AS info, c - lag(c) OVER w AS warn, e - lag(e) OVER w AS error, p - lag(p) OVER w AS suppressed, n - lag(n) OVER w AS findings FROM r WINDOW w AS (ORDER BY seq))
SELECT * FROM d WHERE findings IS NOT NULL ORDER BY seq DESC LIMIT 1""",
    "trend_retention": "SELECT datediff('day', DATE '1970-01-01', ts::DATE) AS seq, count(*) AS findings FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 3",
    "run_histories": """SELECT user_id::VARCHAR AS history, seq, event_id, (event_type = 'view')::BIGINT AS info, (event_type = 'click')::BIGINT AS warn, (event_type = 'error')::BIGINT AS error, (event_type = 'purchase')::BIGINT AS suppressed
FROM (SELECT *, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE seq >= n - 5""",
    "record_errors": """WITH e AS (SELECT *, '$.runs[' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) || ']' AS r FROM events)
SELECT user_id, r || '.status' AS at, 'is none of pass, warn, fail, skip' AS error FROM e WHERE event_type = 'purchase' UNION ALL SELECT user_id, r || '.ended_at', 'is missing' FROM e WHERE event_type = 'click'
UNION ALL SELECT user_id, r || '.counts.info', 'is no integer' FROM e WHERE event_type = 'error' UNION ALL SELECT user_id, r || '.duration_ms', 'is less than 0' FROM e WHERE event_id < 50""",
    "sensor_findings": f"""{RANKED} SELECT diff_id, n, rule_id AS code, severity, message, path, line, col AS "column", {MARK} AS fingerprint,
  CASE rule_id WHEN 'pii.email' THEN 'remove it' END AS help, CASE rule_id WHEN 'pii.ipv4' THEN 'https://example.org/ip' END AS url FROM found""",
    "code_actions": f"""{EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY diff_id, path ORDER BY line, col, message, rule_id) AS k FROM events),
first AS (SELECT diff_id, path, rule_id, min(k) AS k, CASE WHEN starts_with(rule_id, 'pii.') THEN 'https://example.org/pii' WHEN rule_id = 'secret.token' THEN 'https://example.org/secret' END AS page FROM k GROUP BY ALL),
acts AS (SELECT diff_id, path, k, 0 AS kind, 'hunksieve: Explain ' || rule_id AS title, 'hunksieve.explainRule' AS command, rule_id AS arguments, rule_id, NULL AS url FROM first
  UNION ALL SELECT diff_id, path, min(k), 1, 'hunksieve: Open docs for ' || arg_min(rule_id, k), 'hunksieve.showRuleUrl', page || ' ' || arg_min(rule_id, k), arg_min(rule_id, k), page FROM first WHERE page IS NOT NULL GROUP BY diff_id, path, page)
SELECT diff_id, path, row_number() OVER (PARTITION BY diff_id, path ORDER BY k, kind) - 1 AS at, title, command, arguments, rule_id, url FROM acts""",
    "rules_matched": f"{RANKED} SELECT diff_id, count(DISTINCT rule_id) AS rules_matched FROM found GROUP BY diff_id",
    "tags_matched": f"""{RANKED} SELECT diff_id, tag, count(*) AS findings FROM found JOIN (VALUES ('pii.email', 'pii'), ('pii.email', 'Mail'), ('pii.ipv4', 'pii'), ('secret.token', 'secret')) AS t(rule_id, tag) USING (rule_id) GROUP BY ALL""",
    "sarif_rules": f"{RANKED} SELECT diff_id, rule_id, {xml('arg_min(message, n)')} AS text, arg_min({level('sarif')}, n) AS level FROM found GROUP BY diff_id, rule_id",
    "sarif_results": f"""{RANKED} SELECT diff_id, n, rule_id AS "ruleId", {level('sarif')} AS level, {xml('message')} AS text, {xml('path')} AS uri, line AS "startLine", col AS "startColumn", {xml('snippet')} AS snippet, rule_id || ':' || path || ':' || line AS fingerprint FROM found""",
    "junit_suites": f"{RANKED} SELECT diff_id, rule_id, count(*) AS tests, count(*) FILTER (severity <> 'info') AS failures FROM found GROUP BY diff_id, rule_id",
    "checkstyle_files": f"""{RANKED} SELECT diff_id, path, count(*) AS errors, string_agg('    <error line="' || line || '" column="' || col || '" severity="' || {level('checkstyle')} || '" message="' || {xml('message')} || '" source="' || {xml('rule_id')} || '"/>' || chr(10), '' ORDER BY n) AS elements
FROM found GROUP BY diff_id, path""",
    "csv_rows": f"{RANKED} SELECT diff_id, n, {csv('path')} || ',' || line || ',' || rule_id || ',' || severity || ',' || {csv('message')} || ',' || {csv('snippet')} || chr(10) AS row FROM found",
    "tsv_rows": f"{RANKED} SELECT diff_id, n, {tsv('path')} || chr(9) || line || chr(9) || rule_id || chr(9) || severity || chr(9) || {tsv('message')} || chr(9) || {tsv('snippet')} || chr(10) AS row FROM found",
    "annotations": f"{RANKED} SELECT diff_id, n, '::' || {level('annotation')} || ' file=' || path || ',line=' || line || '::' || rule_id || ' ' || message AS row FROM found",
    "markdown_rows": f"{RANKED} SELECT diff_id, n, '| ' || severity || ' | `' || {markdown('rule_id')} || '` | `' || {markdown('path')} || ':' || line || '` | ' || {markdown('message')} || ' | `' || {markdown('snippet')} || '` |' || chr(10) AS row FROM found",
    "junit_cases": f"""{RANKED} SELECT diff_id, rule_id, string_agg('    <testcase classname="' || {xml('path')} || '" name="' || {xml("(path || ':' || line)")} || '">' || chr(10)
  || CASE WHEN severity = 'info' THEN '' ELSE '      <failure type="' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || '" message="' || {xml('message')} || '">' || chr(10)
    || 'Rule: ' || rule_id || chr(10) || 'File: ' || path || chr(10) || 'Line: ' || line || chr(10) || 'Snippet: ' || snippet || chr(10) || '      </failure>' || chr(10) END
  || '    </testcase>' || chr(10), '' ORDER BY n) AS cases FROM findings GROUP BY diff_id, rule_id""",
    "gitlab_issues": f"""{RANKED} SELECT diff_id, n, CASE snippet WHEN '' THEN json_merge_patch(issue, '{{"content": null}}') ELSE issue END::VARCHAR AS issue FROM (SELECT *, json_object('description', message, 'check_name', rule_id, 'fingerprint', sha256(rule_id || path || line || col || match_text),
  'severity', {level('gitlab')}, 'location', json_object('path', path, 'lines', json_object('begin', line)), 'content', json_object('body', snippet)) AS issue FROM found)""",
    "xml_escape": f"SELECT page_id, {xml('html')} AS escaped FROM pages",
    "rule_suggest": """SELECT id, s::BIGINT AS score FROM (SELECT item_id, id, CASE WHEN starts_with(id, 'b.1o') OR starts_with('b.1o', id) THEN 0 WHEN contains(id, 'b.1o') OR contains('b.1o', id) THEN 1
  WHEN levenshtein(id, 'b.1o') <= 3 THEN levenshtein(id, 'b.1o') + 2 END AS s FROM (SELECT item_id, 'b.' || item_id AS id FROM benchmark)) WHERE s IS NOT NULL ORDER BY s, item_id LIMIT 5""",
    "rule_self_test": """WITH r AS (SELECT 'b.' || item_id AS rule_id, text, regexp_extract(text, '[a-z]{4,}') || '[a-z]+ [^a-z]' AS p FROM benchmark),
c AS (SELECT rule_id, 0::BIGINT AS n, true AS should_match, regexp_matches(text, p) AS matched FROM r UNION ALL SELECT rule_id, 1, false, regexp_matches(upper(text), p) FROM r)
SELECT *, should_match = matched AS passed FROM c""",
    "config_merge": """SELECT 'b.' || item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'error' ELSE (['info', 'warn', 'error'])[item_id % 3 + 1] END AS severity, item_id AS rule_idx FROM benchmark WHERE item_id % 3 <> 0 OR item_id % 2 = 0""",
    "changed_lines_positional": """WITH new_ AS (SELECT conv_id::VARCHAR AS uri, string_agg(text, chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY 1),
old_ AS (SELECT conv_id::VARCHAR AS uri, string_agg(text, chr(10) ORDER BY turn, text) AS t FROM conversations WHERE turn % 3 <> 1 GROUP BY 1),
n AS (SELECT uri, unnest(string_split(t, chr(10))) AS content, unnest(generate_series(1, len(string_split(t, chr(10))))) AS line FROM new_),
o AS (SELECT uri, unnest(string_split(t, chr(10))) AS content, unnest(generate_series(1, len(string_split(t, chr(10))))) AS line FROM old_)
SELECT n.uri, n.line, n.content FROM n LEFT JOIN o USING (uri, line) WHERE n.content IS DISTINCT FROM o.content""",
    "benchmark_fanout_rules": f"""WITH {L1}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{4,}}')) AS w FROM benchmark)
SELECT 'w.' || w AS rule_id, count(*) AS total FROM w, l1 WHERE contains(content, w) AND regexp_matches(content, w || '[a-z]{{2}}') GROUP BY w""",
    "dependency_table": f"""WITH RECURSIVE {L1}, d AS (SELECT item_id AS a, item_id - 1 AS b FROM benchmark WHERE item_id % 4 <> 0 UNION ALL SELECT item_id, item_id + 1 FROM benchmark WHERE item_id % 8 = 4),
c AS (SELECT a, b FROM d UNION SELECT c.a, d.b FROM c JOIN d ON c.b = d.a), e AS (SELECT item_id, path, line FROM l1, (SELECT item_id, regexp_extract(text, '[a-z]{{3}}') AS w FROM benchmark) WHERE contains(content, w)),
f AS (SELECT DISTINCT item_id, path FROM e), g AS (SELECT f.item_id, f.path FROM f JOIN c ON c.a = f.item_id AND c.a <> c.b ANTI JOIN f AS h ON h.item_id = c.b AND h.path = f.path)
SELECT path, line, 'b.' || item_id AS rule_id FROM e ANTI JOIN g USING (item_id, path)""",
    "runs_of_files": f"""WITH {L1}, p AS (SELECT diff_id, path IS DISTINCT FROM lag(path) OVER (PARTITION BY diff_id ORDER BY line % 2 = 0, idx) AS new_ FROM l1) SELECT diff_id, count(*) FILTER (new_) AS runs FROM p GROUP BY diff_id""",
}

MARKED = f"""WITH {L1}, m AS (
  SELECT path, line, 'x' || content AS content, line % 4 AS k, (line - 1) // 10 AS h FROM l1
), c AS (
  SELECT *, h * 10 + 1 + count(*) FILTER (k <> 1) OVER w AS new_line, h * 10 + 1 + count(*) FILTER (k < 2) OVER w AS old_line,
    coalesce(last_value(CASE WHEN k < 2 THEN k END IGNORE NULLS) OVER w = 1, false) AS changed
  FROM m WINDOW w AS (PARTITION BY path, h ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
ORACLES |= {
    "diff_added": f"{MARKED} SELECT path, new_line AS line, content, CASE WHEN changed THEN 'changed' ELSE 'added' END AS kind FROM c WHERE k > 1",
    "diff_changed": f"{MARKED} SELECT path, new_line AS line, content, 'changed' AS kind FROM c WHERE k > 1 AND changed",
    "diff_modified": f"{MARKED} SELECT path, new_line AS line, content, 'changed' AS kind FROM c WHERE k > 1 AND changed",
    "diff_deleted": f"{MARKED} SELECT path, old_line AS line, content, 'deleted' AS kind FROM c WHERE k = 1",
}

ORACLES["diff_in_sql"] = ORACLES["diff_added"]

DEPENDENT = f"WITH {L1}, {events([Rule(i, 'info', '', patterns=(p,)) for i, p in (('d.a', 'with the'), ('d.b', 'of the'), ('d.c', 'to the'))])}, has AS (SELECT path, list(DISTINCT rule_id) AS ids FROM events GROUP BY path)"
for name, needs in {"gate": "rule_id <> 'd.b' OR list_contains(ids, 'd.a')", "chain": "rule_id = 'd.a' OR (list_contains(ids, 'd.a') AND (rule_id = 'd.b' OR list_contains(ids, 'd.b')))", "cycle": "len(ids) = 3"}.items():
    ORACLES[f"dependency_{name}"] = f"{DEPENDENT} SELECT path, line, rule_id FROM events JOIN has USING (path) WHERE {needs}"

OVERRIDDEN = [Rule("o.of", "warn", "", patterns=("of the",)), Rule("o.to", "info", "", patterns=("to the",))]
SEVERITY = {"o.of": "CASE WHEN path LIKE 'src1/%' THEN 'error' ELSE 'info' END"}
for name, where, severity in (("severity", {}, SEVERITY), ("disable", {"o.of": "path NOT LIKE 'src1/en/%'"}, SEVERITY), ("exclude", {"o.to": "NOT (path LIKE 'src2/en/%' OR (path LIKE 'src2/%' AND path LIKE '%.py'))"}, {})):
    ORACLES[f"dir_override_{name}"] = f"WITH {L1}, {events(OVERRIDDEN, where=where, severity=severity)} SELECT path, line, rule_id, severity FROM events"

#: Integers are BIGINT on both sides.
NARROW = {
    "verdict_counts": ["suppressed"],
    "exit_code_matrix": ["code", "baseline_code"],
    "check_summary": ["suppressed", "exit_code"],
    "rule_hits": ["suppressed"],
    "rule_hits_with_fp": ["suppressed"],
    "baseline_exit": ["code"],
    "rule_self_test": ["n"],
}
for name, columns in NARROW.items():
    ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in columns)}) FROM ({ORACLES[name]})"
