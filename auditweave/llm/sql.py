"""DuckDB equivalents of the queries that SQL can express."""

from auditweave.llm import secrets as S

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
w AS (SELECT rid, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
s AS (SELECT rid, doc_id, pos, word, string_agg(word, ' ') OVER nxt AS key, count(*) OVER nxt AS n
      FROM w WINDOW nxt AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
least AS (SELECT key, min(doc_id) AS first_id FROM s WHERE n = 13 GROUP BY key),
f AS (SELECT s.*, coalesce(s.n = 13 AND least.first_id < s.doc_id, false) AS hit FROM s LEFT JOIN least ON s.n = 13 AND s.key = least.key),
g AS (SELECT rid, pos, word, bool_or(hit) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT rid, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY rid)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""



def _either_case(pattern: str) -> str:
    """Case-insensitive groups spelled out: RE2 would also fold letters beyond ASCII."""
    out, at = "", 0
    while (i := pattern.find("(?i:", at)) >= 0:
        depth, j = 1, i + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(pattern[j], 0)
            j += 1
        body, inside, k = pattern[i + 4 : j - 1], "", 0
        while k < len(body):
            if body[k] == "[":
                e = body.index("]", k) + 1
                inside += body[k:e].replace("a-z", "a-zA-Z")
                k = e
            else:
                inside += f"[{body[k].lower()}{body[k].upper()}]" if body[k].isalpha() else body[k]
                k += 1
        out += pattern[at:i] + "(" + inside + ")"
        at = j
    return (out + pattern[at:]).replace("(?:", "(")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(kind: str) -> str:
    p = _quoted(_either_case(S.PATTERNS[kind]))
    tail = f"regexp_extract_all(text, {p}, 2)" if kind == "assign" else f"regexp_extract_all(text, {p})"
    return (
        f"SELECT rid, {S.KINDS.index(kind)} AS ord, p + sum(length(h)) OVER (PARTITION BY rid ORDER BY k) - length(h) AS s, length(h) AS n, length(t) AS tail FROM ("
        f"SELECT rid, k, h, t, sum(length(piece)) OVER (PARTITION BY rid ORDER BY k) AS p FROM (SELECT rid, unnest(regexp_extract_all(text, {p})) AS h, unnest({tail}) AS t, "
        f"unnest(string_split_regex(text, {p})[:len(regexp_extract_all(text, {p}))]) AS piece, unnest(range(len(regexp_extract_all(text, {p})))) AS k FROM d WHERE regexp_matches(text, {p})))"
    )


_NAME = "CASE ord " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(S.KINDS)) + " END"
_WEAK = {k: S.KINDS.index(k) for k in S.WEAK}
OP2 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS MATERIALIZED (SELECT rid, ord::BIGINT AS ord, s::BIGINT AS a, (s + n)::BIGINT AS b, tail FROM ({' UNION ALL '.join(_hits(k) for k in S.PATTERNS)})),
c AS MATERIALIZED (SELECT rid, CASE WHEN ord = 0 AND tail < {S.LEAST_ASSIGN} THEN {_WEAK['weak_secret']} ELSE ord END AS ord, a, b FROM m WHERE ord <> 0 OR tail >= {S.WEAK_ASSIGN}),
r AS (SELECT *, CASE WHEN ord IN (1, {_WEAK['weak_id']}) THEN 'id' WHEN ord IN (0, {_WEAK['weak_secret']}) OR (ord = 2 AND b - a >= {S.SECRET_HEX}) THEN 'secret' WHEN ord = {_WEAK['endpoint']} THEN 'endpoint' END AS role FROM c),
l AS (SELECT DISTINCT x.rid, x.ord, x.a, x.b FROM r x JOIN r y ON x.rid = y.rid AND x.ord >= 3
      AND (CASE WHEN x.role = 'secret' THEN y.role IN ('id', 'endpoint') ELSE y.role = 'secret' END)
      AND (((y.a, y.ord) < (x.a, x.ord) AND x.a - y.b <= {S.SCOPE}) OR ((y.a, y.ord) > (x.a, x.ord) AND y.a - x.b <= {S.SCOPE}))),
b AS (SELECT rid, ord, a, b FROM c WHERE ord < 3),
g AS (SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
             string_agg({_NAME} || ':' || a || ':' || b, ',' ORDER BY a, ord) AS base FROM b GROUP BY rid),
e AS (SELECT rid, string_agg({_NAME} || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans, count(*) FILTER (ord >= 3) AS n_linked FROM (SELECT * FROM b UNION ALL SELECT * FROM l) GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0)::BIGINT AS n_linked
FROM d LEFT JOIN g USING (rid) LEFT JOIN e USING (rid)
"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS total FROM d),
x AS (SELECT rid, total, string_agg(word, ' ') OVER nxt AS key, count(*) OVER nxt AS n, pos FROM w WINDOW nxt AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS MATERIALIZED (SELECT DISTINCT rid, key FROM x WHERE n = 5 OR (total < 5 AND pos = 0)),
z AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM s a JOIN s b ON a.key = b.key AND a.rid <> b.rid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN z p ON p.rid = x JOIN z q ON q.rid = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach AS (WITH RECURSIVE t(x, y) AS (SELECT x, y FROM l UNION SELECT t.x, l.y FROM t JOIN l ON l.x = t.y) SELECT x, min(doc_id) AS low FROM t JOIN d ON d.rid = t.y GROUP BY x)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(reach.low, d.doc_id)) AS component_id
FROM d LEFT JOIN z USING (rid) LEFT JOIN reach ON reach.x = d.rid
"""


def _resolved(x: str, attribute: bool = False) -> str:
    """One pass over the pieces between references; table ``n`` holds one map from names to letters."""
    from auditweave.llm import warc as W

    digits = "('0' || regexp_extract(e, '^&#[xX]?0*([0-9a-fA-F]*)', 1))"
    plain = f"CASE WHEN len({digits}) > 9 THEN 0 WHEN lower(e)[3] = 'x' THEN try_cast('0x' || {digits} AS BIGINT) ELSE try_cast({digits} AS BIGINT) END"
    code = f"coalesce((MAP {{{', '.join(f'{k}: {v}' for k, v in W.NUMBERS.items())}}})[{plain}], {plain})"
    number = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}::INT) ELSE chr(65533) END"
    begun = "NULL" if attribute else f"(m[regexp_extract(e, {_quoted(W.OPEN_NAME)}, 0)] || e[len(regexp_extract(e, {_quoted(W.OPEN_NAME)}, 0)) + 1:])"
    one = f"CASE WHEN e[2] = '#' THEN {number} ELSE coalesce(m[e], {begun}, e) END"
    found, pieces = f"regexp_extract_all({x}, {_quoted(W.REFERENCE)})", f"string_split_regex({x}, {_quoted(W.REFERENCE)})"
    return f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(list_zip({pieces}, list_transform({found}, lambda e: {one})), lambda p: coalesce(p[1], '') || coalesce(p[2], '')), '') ELSE {x} END"


def _op7() -> str:
    from auditweave.llm import warc as W

    q = _quoted
    uuid = lambda *parts: (h := "sha256(concat_ws(chr(10), " + ", ".join(parts) + "))") and "'<urn:uuid:' || concat_ws('-', " + ", ".join(f"{h}[{a}:{a + n - 1}]" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ") || '>'"
    bare = f"regexp_replace(regexp_replace(html, {q(W.COMMENT)}, ' ', 'g'), {q(W.UNSEEN)}, ' ', 'g')"
    one_line = lambda x: f"trim(regexp_replace({x}, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'), ' ')"
    crlf = "chr(13) || chr(10)"
    names, letters = (", ".join(q(x) for x in xs) for xs in zip(*((f"&{n}", " " if c == chr(0xA0) else c) for n, c in W.html5.items()), strict=True))
    heads = {
        "WARC-Type": "type", "WARC-Record-ID": "record_id", "WARC-Date": q(W.NO_DATE), "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to", "WARC-Refers-To-Target-URI": "target_uri", "WARC-Refers-To-Date": q(W.NO_DATE),
        "WARC-Concurrent-To": "other", "X-Source-Payload-Digest": "source_digest", "WARC-Block-Digest": "'sha256:' || sha256(block)", "Content-Type": "content_type", "Content-Length": "strlen(block)",
        "X-Source-Content-Type": "'text/html; charset=UTF-8'", "X-Source-Content-Length": "page_length",
    }
    return f"""
WITH n AS MATERIALIZED (SELECT map([{names}], [{letters}]) AS m), p AS (SELECT page_id AS source_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
s AS MATERIALIZED (SELECT source_id, target_uri, 'sha256:' || sha256(html) AS source_digest, {uuid("'response'", "coalesce(source_id::VARCHAR, '')", "target_uri", "sha256(html)")} AS refers_to,
  strlen(html) AS page_length, list_transform(regexp_extract_all({bare}, {q(W.HREF)}, 1), lambda x: CASE WHEN x[1] IN (chr(34), chr(39)) THEN x[2:len(x) - 1] ELSE x END) AS raw_links, regexp_extract(html, {q(W.TITLE)}, 1) AS raw_title, regexp_extract(html, {q(W.LANGUAGE)}, 1) AS language,
  regexp_replace(regexp_replace({bare}, {q(W.LINES)}, chr(10), 'g'), {q(W.MARKUP)}, '', 'g') AS raw_text FROM p),
t AS MATERIALIZED (SELECT *, list_transform(raw_links, lambda x: {one_line(_resolved('x', True))}) AS links, {one_line(_resolved('raw_title'))} AS title,
  trim(regexp_replace(regexp_replace({_resolved('raw_text')}, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS text,
  {uuid("'metadata'", "refers_to", "source_digest")} AS mid, {uuid("'conversion'", "refers_to", "source_digest")} AS cid FROM s, n),
r AS (SELECT source_id, target_uri, source_digest, page_length::VARCHAR AS page_length, refers_to, len(links)::BIGINT AS n_links, 'metadata' AS type, mid AS record_id, cid AS other, 'application/warc-fields' AS content_type,
  CASE WHEN title <> '' THEN 'title: ' || title || {crlf} ELSE '' END || CASE WHEN language <> '' THEN 'language: ' || language || {crlf} ELSE '' END || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {crlf}), ''), '') AS block FROM t
  UNION ALL SELECT source_id, target_uri, source_digest, page_length::VARCHAR, refers_to, len(links)::BIGINT, 'conversion', cid, mid, 'text/plain; charset=UTF-8', text FROM t)
SELECT source_id, record_id, type, refers_to, target_uri, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, n_links,
  'WARC/1.1' || {crlf} || {" || ".join(f"'{k}: ' || {v} || {crlf}" for k, v in heads.items())} || {crlf} || block || {crlf} || {crlf} AS record FROM r
"""


OP7 = _op7()

#: Components are whole numbers below 2^31 here, so products of doubles are exact sums of whole numbers below 2^53.
OP11 = """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, r.id, r.label, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.id % 50 = 0 AND r.id <> a.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.anchor_label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
