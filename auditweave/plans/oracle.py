"""DuckDB equivalents of the registered queries."""

from auditweave.operators import compliance as C
from auditweave.plans.corpus import TEXT_RULES


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rule(i: int) -> str:
    r = TEXT_RULES[i]
    p, q = quoted(r.pattern), quoted
    where = f"regexp_matches(text, {p}) AND ext IN ({', '.join(map(q, r.exts))})"
    if r.suppress_if:
        where += f" AND NOT regexp_matches(text, {q(r.suppress_if)})"
    if r.requires_in_file:
        where += f" AND regexp_matches(text, {q(r.requires_in_file)})"
    body = f"""SELECT *, {i} AS rule_ord, pos + sum(length(h)) OVER w - length(h) AS start, 1 + nl + sum(length(h) - length(replace(h, chr(10), ''))) OVER w - (length(h) - length(replace(h, chr(10), ''))) AS line
      FROM (SELECT *, sum(length(piece)) OVER w AS pos, sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w AS nl FROM (
        SELECT file, doc_id, origin, text, unnest(regexp_extract_all(text, {p})) AS h, unnest(string_split_regex(text, {p})[:len(regexp_extract_all(text, {p}))]) AS piece, unnest(range(len(regexp_extract_all(text, {p})))) AS k FROM f WHERE {where})
        WINDOW w AS (PARTITION BY file ORDER BY k)) WINDOW w AS (PARTITION BY file ORDER BY k)"""
    if r.suppress_line_if:
        body = f"SELECT * FROM ({body}) WHERE NOT regexp_matches(string_split(text, chr(10))[line::INT], {q(r.suppress_line_if)})"
    if r.once_per_file:
        body = f"SELECT * FROM ({body}) QUALIFY row_number() OVER (PARTITION BY file ORDER BY start) = 1"
    shown = "'[redacted]'" if r.mask else "left(trim(string_split(text, chr(10))[line::INT], ' ' || chr(9) || chr(13)), 200)"
    return f"SELECT {q(r.id)} AS detector_id, {q(r.title)} AS title, {q(r.severity)} AS severity, {q(r.confidence)} AS confidence, {q(r.cwe)} AS cwe, file, line::BIGINT AS line, {shown} AS evidence, 'builtin' AS source, rule_ord, start, doc_id, origin FROM ({body})"


SCAN = "f AS MATERIALIZED (SELECT concat(source, '/', doc_id, '.', lang) AS file, lang AS ext, coalesce(text, '') AS text, doc_id, source AS origin FROM documents), scan AS MATERIALIZED (" + " UNION ALL ".join(_rule(i) for i in range(len(TEXT_RULES))) + ")"
TIERS = SCAN + """, tiers AS MATERIALIZED (SELECT *, 0 AS tier FROM scan UNION ALL SELECT * REPLACE ('gitleaks' AS source, 'tool' AS evidence), 1 FROM scan WHERE doc_id % 2 = 0
  UNION ALL SELECT * REPLACE ('taint' AS source, 'T-' || detector_id AS detector_id), 2 FROM scan WHERE doc_id % 3 = 0)"""
SHOWN = "detector_id, severity, cwe, file, line, evidence, source"
RANK = "CASE severity WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Informational' THEN 1 ELSE 0 END"
SRANK = "CASE source WHEN 'gitleaks' THEN 4 WHEN 'taint' THEN 3 WHEN 'builtin' THEN 1 ELSE 0 END"
FIRST = "first_ AS MATERIALIZED (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY detector_id, file, line ORDER BY tier, rule_ord, start) = 1)"
DEDUPED = TIERS + ", " + FIRST + f""", top_ AS MATERIALIZED (SELECT * FROM first_ QUALIFY {SRANK} = max({SRANK}) OVER (PARTITION BY file, line, cwe)),
  deduped AS MATERIALIZED (SELECT a.* FROM top_ a LEFT JOIN (SELECT DISTINCT file AS bf, line AS bl FROM top_ WHERE detector_id = 'TXT-SECRET-TOKEN') b ON a.file = bf AND a.line = bl WHERE NOT (detector_id = 'TXT-SECRET-HEX' AND bf IS NOT NULL))"""
LADDER = "['Critical', 'High', 'Medium', 'Low', 'Informational']"
VEX = f"""u AS (SELECT l_partkey AS k, count(*) FILTER (o_orderstatus = 'F') AS run, count(*) FILTER (o_orderstatus <> 'F') AS dev FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 47 GROUP BY 1),
 v AS (SELECT p_partkey::VARCHAR AS package, p_partkey % 11 <> 0 AS indexable, p_size % 5 + 1 AS sev, coalesce(run, 0) AS run, coalesce(dev, 0) AS dev, p_size % 3 = 0 AS in_dev, p_size % 3 = 1 AS in_run FROM part LEFT JOIN u ON p_partkey = k),
 x AS (SELECT *, CASE WHEN NOT indexable THEN 1 WHEN run > 0 THEN 2 WHEN dev > 0 AND in_dev THEN 3 WHEN dev > 0 THEN 1 WHEN in_dev THEN 3 WHEN in_run THEN 4 ELSE 1 END AS c FROM v),
 y AS (SELECT *, CASE c WHEN 1 THEN 'under_investigation' WHEN 2 THEN 'affected' ELSE 'not_affected' END AS vex_status, CASE c WHEN 3 THEN 'component_not_present' WHEN 4 THEN 'vulnerable_code_not_present' ELSE '' END AS vex_justification,
   {LADDER}[least(5, sev + CASE WHEN c >= 3 THEN 2 ELSE 0 END)] AS severity_after, least(5, sev + CASE WHEN c >= 3 THEN 2 ELSE 0 END) AS rung FROM x)"""
STATUS = "CASE event_type WHEN 'purchase' THEN 'exploited' WHEN 'signup' THEN 'elevated' WHEN 'click' THEN 'listed' ELSE 'unknown' END"
ERANK = "CASE {0} WHEN 'exploited' THEN 3 WHEN 'elevated' THEN 2 WHEN 'listed' THEN 1 ELSE 0 END"
STATE = f"""e AS (SELECT user_id::VARCHAR AS cve, event_type AS package, {STATUS} AS exploitation, event_id FROM events),
 state AS (SELECT cve, package, '' AS vex_status, 'High' AS severity, exploitation, '2024-01-01' AS first_seen, CASE WHEN exploitation = 'exploited' THEN '2024-01-01' ELSE '' END AS exploited_since FROM e WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY cve ORDER BY event_id) = 1)"""
COMPARE = STATE + f""", now_ AS (SELECT cve, max({ERANK.format('exploitation')}) AS r FROM e WHERE event_id % 2 = 1 GROUP BY cve),
 cmp AS (SELECT s.cve, s.exploitation AS previous, ['unknown', 'listed', 'elevated', 'exploited'][coalesce(r, 0) + 1] AS current, coalesce(r, 0) > {ERANK.format('s.exploitation')} AS risen FROM state s LEFT JOIN now_ n ON n.cve = s.cve),
 compared AS (SELECT cve, previous, current, CASE WHEN NOT risen THEN CASE WHEN previous = 'exploited' THEN 'still_exploited' ELSE 'unchanged' END WHEN current = 'exploited' THEN 'triggered' ELSE 'escalated' END AS outcome FROM cmp)"""
DIFF = SCAN + """, r AS (SELECT *, trim(regexp_replace(evidence, '\\s+', ' ', 'g')) AS ne, CASE WHEN doc_id % 13 = 0 THEN 'dep' ELSE '' END AS package FROM scan),
 old AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY detector_id, file, ne ORDER BY line, rule_ord, start) AS o FROM r WHERE doc_id % 5 <> 0 AND package = ''),
 moved AS (SELECT * REPLACE (line + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS line) FROM r WHERE doc_id % 7 <> 0),
 new AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY detector_id, file, ne ORDER BY line, rule_ord, start) AS o FROM moved WHERE package = ''),
 d AS MATERIALIZED (SELECT CASE WHEN old.file IS NULL THEN 'introduced' ELSE 'unchanged' END AS change, new.detector_id, new.file, new.line, new.severity, new.evidence, old.line AS baseline_line FROM new LEFT JOIN old USING (detector_id, file, ne, o)
  UNION ALL SELECT 'moved', new.detector_id, new.file, new.line, new.severity, new.evidence, old.line FROM new JOIN old USING (detector_id, file, ne, o) WHERE new.line <> old.line
  UNION ALL SELECT 'resolved', old.detector_id, old.file, old.line, old.severity, old.evidence, old.line FROM old ANTI JOIN new USING (detector_id, file, ne, o)
  UNION ALL SELECT 'not_compared', detector_id, file, line, severity, evidence, NULL FROM moved WHERE package <> '')"""
LABELLED = SCAN + """, l AS (SELECT doc_id::VARCHAR AS id, file, ext AS language, origin AS class, quality = 0 AS is_vulnerable FROM labels JOIN f USING (doc_id)),
 labelled AS MATERIALIZED (SELECT l.*, count(s.line) > 0 AS loose, count(s.line) FILTER (s.cwe IN ('CWE-1078', 'CWE-798')) > 0 AS strict FROM l LEFT JOIN scan s ON s.file = l.file AND s.line BETWEEN 1 AND 3 GROUP BY ALL)"""
HUNKS = """h0 AS (SELECT DISTINCT l_orderkey % 997 AS file, l_partkey % 400 AS line FROM lineitem), h1 AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY file ORDER BY line) > 3 THEN 1 ELSE 0 END AS n FROM h0),
 h2 AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY line) AS i FROM h1), hunks AS MATERIALIZED (SELECT file, min(line)::BIGINT AS start_line, max(line)::BIGINT AS end_line, count(*) AS n FROM h2 GROUP BY file, i)"""
ASVS = "(VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in C.asvs_rows()) + ") AS a(cwe, asvs, asvs_title)"
PCI = "(VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in C.pci_rows()) + ") AS p(cwe, pci)"
SEALED = "('0x' || sha256({0})[1:8])::BIGINT < 858993459"
RATIO = "CASE WHEN {1} = 0 THEN 0.0 ELSE {0}::DOUBLE / {1} END"
_FB = lambda b: f"CASE WHEN {b * b} * precision + recall = 0 THEN 0.0 ELSE {1 + b * b} * precision * recall / ({b * b} * precision + recall) END AS f{b}"

ORACLE_SQL = {
    "q01_scan_findings": f"WITH {SCAN} SELECT {SHOWN}, confidence FROM scan",
    "q02_severity_counts_zero_filled": f"WITH {SCAN}, d AS (SELECT * FROM scan QUALIFY row_number() OVER (PARTITION BY detector_id, file, line ORDER BY rule_ord, start) = 1) SELECT s.severity, count(d.file) AS n FROM (SELECT unnest({LADDER}) AS severity) s LEFT JOIN d USING (severity) GROUP BY 1",
    "q03_once_per_file": f"WITH {SCAN} SELECT {SHOWN} FROM scan QUALIFY row_number() OVER (PARTITION BY file, detector_id ORDER BY start) = 1",
    "q04_first_wins_dedupe": f"WITH {TIERS}, {FIRST} SELECT {SHOWN} FROM first_",
    "q05_top_source_filter": f"WITH {TIERS} SELECT {SHOWN} FROM tiers QUALIFY {SRANK} = max({SRANK}) OVER (PARTITION BY file, line, cwe)",
    "q06_superseded_anti_join": f"WITH {SCAN} SELECT {SHOWN} FROM scan a LEFT JOIN (SELECT DISTINCT file AS bf, line AS bl FROM scan WHERE detector_id = 'TXT-SECRET-TOKEN') b ON a.file = bf AND a.line = bl WHERE NOT (detector_id = 'TXT-SECRET-HEX' AND bf IS NOT NULL)",
    "q07_dedupe_pipeline": f"WITH {DEDUPED} SELECT {SHOWN} FROM deduped",
    "q09_ranked_top_k": f"WITH {DEDUPED} SELECT {SHOWN} FROM deduped ORDER BY {RANK} DESC, file, line, detector_id, source LIMIT 10",
    "q10_vex_classify": f"WITH {VEX} SELECT vex_status, vex_justification, indexable, count(*) AS n FROM y GROUP BY ALL",
    "q11_vex_severity_ladder": f"WITH {VEX} SELECT package, vex_status, severity_after, {LADDER}[least(5, rung + CASE WHEN indexable THEN 0 ELSE 1 END)] AS severity_shown FROM y",
    "q12_exploitation_join": f"""WITH p AS (SELECT 'CVE-2024-' || lpad(p_partkey::VARCHAR, 7, '0') AS cve, p_brand AS package, {LADDER}[p_size % 5 + 1] AS severity, p_partkey % 17 = 0 AS kev, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice % 100 / 400 END AS score FROM part)
 SELECT cve, package, CASE WHEN kev THEN 'Critical' ELSE severity END AS severity, CASE WHEN kev THEN 'exploited' WHEN score >= 0.1 THEN 'elevated' ELSE 'listed' END AS exploitation FROM p""",
    "q13_watchlist_init": f"WITH {STATE} SELECT * FROM state",
    "q14_watch_compare": f"WITH {COMPARE} SELECT *, outcome = 'triggered' AS is_trigger FROM compared",
    "q15_watch_advance": f"WITH {COMPARE} SELECT s.cve, s.package, s.vex_status, s.severity, CASE WHEN outcome IN ('triggered', 'escalated') THEN current ELSE s.exploitation END AS exploitation, s.first_seen, CASE WHEN outcome = 'triggered' THEN '2024-02-02' ELSE s.exploited_since END AS exploited_since FROM state s JOIN compared USING (cve)",
    "q16_diff_introduced": f"WITH {DIFF} SELECT * FROM d WHERE change = 'introduced'",
    "q17_diff_resolved": f"WITH {DIFF} SELECT * FROM d WHERE change = 'resolved'",
    "q18_diff_moved": f"WITH {DIFF} SELECT change, detector_id, count(*) AS n, sum(line)::BIGINT AS lines, sum(baseline_line)::BIGINT AS baseline_lines FROM d WHERE change IN ('moved', 'unchanged', 'not_compared') GROUP BY ALL",
    "q19_gate": f"WITH {DIFF} SELECT coalesce(max({RANK}), 0)::BIGINT AS worst_rank, coalesce(max({RANK}), 0) >= 4 AS gate FROM d WHERE change = 'introduced'",
    "q20_sarif_fingerprint": f"WITH {SCAN}, r AS (SELECT *, trim(regexp_replace(evidence, '\\s+', ' ', 'g')) AS ne FROM scan) SELECT file, detector_id, line, sha256(concat_ws(chr(10), detector_id, file, cwe, ne, '#' || (row_number() OVER (PARTITION BY detector_id, file, cwe, ne ORDER BY line, rule_ord, start) - 1)))[1:32] AS fingerprint FROM r",
    "q21_label_match": f"WITH {LABELLED} SELECT id, file, is_vulnerable, loose, strict FROM labelled",
    "q22_confusion_by_class": f"""WITH {LABELLED}, g AS (SELECT CASE WHEN grouping(class) = 0 THEN 'class' WHEN grouping(language) = 0 THEN 'language' ELSE 'all' END AS dimension, coalesce(class, language, '') AS value, count(*) FILTER (is_vulnerable AND strict) AS tp, count(*) FILTER (NOT is_vulnerable AND strict) AS fp,
 count(*) FILTER (is_vulnerable AND NOT strict) AS fn FROM labelled GROUP BY GROUPING SETS ((), (class), (language))), m AS (SELECT *, {RATIO.format('tp', '(tp + fp)')} AS precision, {RATIO.format('tp', '(tp + fn)')} AS recall FROM g) SELECT *, {_FB(1)}, {_FB(2)}, {_FB(3)} FROM m""",
    "q23_range_join_recall": f"""WITH {HUNKS}, r AS (SELECT l_orderkey % 997 AS file, l_suppkey % 400 AS line, 'CWE-' || l_returnflag AS cwe FROM lineitem WHERE l_quantity > 49),
 b AS (SELECT h.file, h.start_line, count(r.line) > 0 AS loose, count(r.line) FILTER (r.cwe IN ('CWE-R', 'CWE-N')) > 0 AS strict FROM hunks h LEFT JOIN r ON r.file = h.file AND r.line BETWEEN h.start_line - 10 AND h.end_line + 10 GROUP BY ALL),
 c AS (SELECT file, bool_or(loose) AS loose, bool_or(strict) AS strict, count(*) AS n FROM b GROUP BY file),
 t AS (SELECT count(*) AS n_files, sum(n)::BIGINT AS n_hunks, count(*) FILTER (loose) AS loose_files, count(*) FILTER (strict) AS strict_files FROM c) SELECT *, {RATIO.format('loose_files', 'n_files')} AS recall, {RATIO.format('strict_files', 'n_files')} AS strict_recall FROM t""",
    "q24_hunks": f"WITH {HUNKS} SELECT * FROM hunks",
    "q25_excerpt_merge": """WITH s AS (SELECT user_id, greatest(event_id % 5000 + 1 - 14, 1) AS s, event_id % 5000 + 1 + 14 AS e FROM events), b AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
 i AS (SELECT *, sum(CASE WHEN s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT user_id, min(s)::BIGINT AS start_line, max(e)::BIGINT AS end_line FROM i GROUP BY user_id, g""",
    "q26_concentration": """WITH n AS (SELECT p_brand, p_type, l_suppkey % 4 AS s, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), t AS (SELECT p_brand, p_type, sum(n)::BIGINT AS total, max(n) AS m, min(s) FILTER (n = mx) AS top FROM (SELECT *, max(n) OVER (PARTITION BY p_brand, p_type) AS mx FROM n) GROUP BY ALL)
 SELECT p_brand, p_type, total, top, m::DOUBLE / total AS top_share FROM t WHERE total >= 40 AND m >= 0.3 * total""",
    "q27_sealed_split": f"SELECT c_custkey, {SEALED.format('c_name')} AS sealed FROM customer",
    "q28_noise_per_kloc": f"WITH {SCAN}, l AS (SELECT origin, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM f GROUP BY 1), n AS (SELECT origin, count(*) AS n FROM scan GROUP BY 1), t AS (SELECT l.origin AS source, lines, coalesce(n, 0) AS n FROM l LEFT JOIN n ON n.origin IS NOT DISTINCT FROM l.origin), r AS (SELECT source, sum(n)::BIGINT AS findings, sum(lines)::BIGINT AS lines FROM t GROUP BY ROLLUP (source)) SELECT *, {RATIO.format('(1000.0 * findings)', 'lines')} AS per_kloc FROM r",
    "q29_loudest_top10": f"WITH {SCAN} SELECT detector_id, count(*) AS n FROM scan GROUP BY 1 ORDER BY n DESC, detector_id LIMIT 10",
    "q30_stream_high_water": f"SELECT user_id::VARCHAR AS cve, max({ERANK.format(STATUS)})::BIGINT AS rank, count(*) AS n FROM events GROUP BY 1",
    "q31_session_hunks": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM g)
 SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n FROM i GROUP BY user_id, g""",
    "q32_compliance_register": f"WITH {DEDUPED} SELECT {SHOWN}, asvs, asvs_title, pci, cwe IN ({', '.join(map(quoted, C.PCI_REFUSED))}) AS pci_refused, {quoted('; '.join(C.CRA_ALWAYS))} || CASE WHEN cwe IN ({', '.join(map(quoted, C.CRA_DEFAULTS_CWES))}) THEN {quoted('; ' + C.CRA_DEFAULTS)} ELSE '' END AS cra FROM deduped LEFT JOIN {ASVS} USING (cwe) LEFT JOIN {PCI} USING (cwe)",
    "q33_budgeted_prefix": "WITH t AS (SELECT source, doc_id, length(text) AS n, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) SELECT * FROM t WHERE used <= 60000",
    "q34_sbom_components": """WITH r AS (SELECT l_partkey, max(l_linenumber) AS a, max(l_suppkey) AS b FROM lineitem WHERE l_quantity > 45 GROUP BY 1), t AS (SELECT '@' || lower(replace(p_brand, '#', '')) || '/part-' || p_partkey AS name, CASE WHEN a IS NULL THEN '' ELSE a || '.' || b END AS version FROM part LEFT JOIN r ON p_partkey = l_partkey)
 SELECT name, version, 'pkg:npm/' || replace(name, '@', '%40') || CASE WHEN version <> '' THEN '@' || version ELSE '' END AS purl, regexp_replace('Package-' || name, '[^A-Za-z0-9.-]', '-', 'g') AS spdx_id, version = '' AS unresolved FROM t""",
    "q35_comment_views": "SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?-->'))::BIGINT AS n_comments, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?-->'), lambda x: length(x))), 0)::BIGINT AS comment_chars, length(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'))::BIGINT AS left_chars FROM pages",
    "q37_php_paths": """WITH n AS (SELECT 'src/n' || n_nationkey || '.php' AS file, n_regionkey % 5 + 1 AS k FROM nation)
 SELECT ['TAINT-PHP-SQLI', 'TAINT-PHP-LFI', 'TAINT-PHP-CMDI', 'TAINT-PHP-PATH', 'TAINT-PHP-XSS'][k] AS sink_id, ['CWE-89', 'CWE-98', 'CWE-78', 'CWE-22', 'CWE-79'][k] AS cwe, ['Critical', 'Critical', 'Critical', 'High', 'High'][k] AS severity, 'medium' AS confidence, file, 5::BIGINT AS line,
 '$x (from a superglobal)' AS source, 2::BIGINT AS source_line, ['$db->q("SELECT a FROM b WHERE c=$x");', 'include $x;', 'system($x);', 'unlink($x);', 'echo $x;'][k] AS evidence, '$id = $_GET["id"];' AS source_evidence FROM n""",
    "q38_module_fixpoint": """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + n_regionkey) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation WHERE n_regionkey = 1),
 t AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation UNION SELECT start, dst FROM t JOIN e ON src = node) SELECT start, node FROM t""",
    "q39_import_resolution": r"""WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), b AS (SELECT *, regexp_replace(host, '^(?:www|m)[.]', '') AS bare FROM p),
 c AS (SELECT page_id AS importer, unnest([host || path, bare || path, 'www.' || bare || path, 'm.' || bare || path]) AS file, unnest([0, 1, 2, 3]) AS o FROM b) SELECT importer, arg_min(file, o) AS resolved FROM c WHERE file IN (SELECT host || path FROM p WHERE page_id % 3 <> 0) GROUP BY 1""",
    "q40_miss_causes": f"WITH {LABELLED} SELECT CASE WHEN loose THEN 'other weakness' WHEN language <> 'en' THEN 'language' WHEN {SEALED.format('id')} THEN 'sealed' ELSE 'silent' END AS cause, count(*) AS n FROM labelled WHERE is_vulnerable AND NOT strict GROUP BY 1",
}

#: The nearest pair that is left, again and again: a fold over a group's pairs in their order.
ORACLE_SQL["q08_corroborate_nearest"] = """
WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, l_returnflag AS cwe, CAST(l_linenumber AS BIGINT) AS line, l_partkey % 2 = 0 AS t, CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END AS taint_path, l_partkey AS seq,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS k FROM lineitem),
e AS (SELECT p.file, p.cwe, list([{'i': p.k, 'j': q.k}] ORDER BY abs(p.line - q.line), p.k, q.k) AS pairs FROM r p JOIN r q ON p.file = q.file AND p.cwe = q.cwe AND NOT p.t AND q.t AND abs(p.line - q.line) <= 3 GROUP BY ALL),
m AS (SELECT file, cwe, unnest(list_reduce(pairs, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.i = x[1].i OR y.j = x[1].j)) > 0 THEN a ELSE list_concat(a, x) END)) AS p FROM e)
SELECT r.file, r.cwe, r.line, CASE WHEN r.t THEN 'taint' ELSE 'builtin' END AS source, CASE WHEN q.confidence = 'high' THEN 'high' ELSE r.confidence END AS confidence, coalesce(q.taint_path, r.taint_path) AS taint_path, r.seq
FROM r LEFT JOIN m ON r.file = m.file AND r.cwe = m.cwe AND NOT r.t AND r.k = m.p.i LEFT JOIN r q ON q.file = m.file AND q.cwe = m.cwe AND q.k = m.p.j
WHERE NOT (r.t AND EXISTS (SELECT 1 FROM m x WHERE x.file = r.file AND x.cwe = r.cwe AND x.p.j = r.k))
"""

ORACLE_SQL["q59_watch_alerts"] = f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS cve, {ERANK.format(STATUS)} AS rank, ts FROM events), m AS (SELECT *, max(rank) OVER (PARTITION BY cve) AS top FROM e)
SELECT cve, 0::BIGINT AS was, max(top)::BIGINT AS now, strftime(min(ts) FILTER (WHERE rank = top), '%Y-%m-%d %H:%M:%S.%f') AS since, count(*) AS n FROM m GROUP BY cve HAVING max(top) > 0
"""
