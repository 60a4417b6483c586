"""SQL for DuckDB that gives the rows of the queries which SQL can express."""

from __future__ import annotations

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_HEX = "chr(coalesce(try_cast('0x' || left(p, 2) AS INT), 0))"
_ONE = f"CASE WHEN NOT regexp_matches(p, '^[0-9A-Fa-f][0-9A-Fa-f]') THEN '%' || p WHEN regexp_matches({_HEX}, '[A-Za-z0-9._~-]') THEN {_HEX} || p[3:] ELSE '%' || upper(left(p, 2)) || p[3:] END"
_PERCENT = f"string_split({{0}}, '%')[1] || array_to_string(list_transform(string_split({{0}}, '%')[2:], lambda p: {_ONE}), '')"
_STEPS = "list_reduce(list_transform(string_split({0}, '/')[2:], lambda s: [s]), lambda a, s: CASE s[1] WHEN '.' THEN a WHEN '..' THEN a[1:len(a) - 1] ELSE a || s END, CAST([] AS VARCHAR[]))"

# Host, path and canonical form of each page; the list is of those whose digest begins with 0.
OP1 = rf"""
WITH p0 AS (
  SELECT page_id, url,
    coalesce({_LOW.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    {_LOW.format("regexp_extract(url, '(?s)^(.*?)://', 1)")} AS scheme,
    regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]+)', 1) AS query
  FROM pages),
p1 AS (
  SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':$', '') AS h, {_PERCENT.format("path")} AS steps, {_PERCENT.format("query")} AS asked FROM p0),
p2 AS (
  SELECT *, regexp_replace(CASE scheme WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END, '\.(:\d+)?$', '\1') AS name,
    CASE WHEN regexp_matches(steps, '/\.\.?(/|$)') THEN '/' || array_to_string({_STEPS.format("steps")}, '/') || CASE WHEN regexp_matches(steps, '/\.\.?$') AND len({_STEPS.format("steps")}) > 0 THEN '/' ELSE '' END
      WHEN steps = '' THEN '/' ELSE steps END AS way
  FROM p1),
p AS (SELECT page_id, url, host, path, CASE WHEN contains(url, '://') THEN scheme || '://' || name || way || asked END AS canonical FROM p2),
listed AS (SELECT DISTINCT canonical AS listed FROM p WHERE starts_with(sha256(url), '0') AND canonical IS NOT NULL),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM p) d JOIN r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p)
  GROUP BY 1, 2)
SELECT page_id, p.host, p.path, rule, coalesce(v, CASE WHEN listed IS NOT NULL THEN 'block' END, 'allow') AS verdict, listed
FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path LEFT JOIN listed ON canonical = listed
"""


def _urn(text: str) -> str:
    return f"'urn:uuid:' || regexp_replace(left(sha256({text}), 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5')"


def _text(x: str) -> str:
    for pattern, by, flags in (
        ("(?s)<!--.*?-->", "' '", "g"),
        ("(?is)<script\\b[^>]*>.*?</script\\s*>", "' '", "g"),
        ("(?is)<style\\b[^>]*>.*?</style\\s*>", "' '", "g"),
        ("(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|table|article|section|header|footer|nav|title|head|blockquote|pre)\\b[^>]*>", "chr(10)", "g"),
        ("<[^>]*>", "''", "g"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {by}, '{flags}')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace({x}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({x}, ' ?\\n[\\n ]*', chr(10), 'g'), '^[\\n ]+|[\\n ]+$', '', 'g')"


_HEAD = "'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8'"
_FIELDS = " || chr(13) || chr(10) || ".join(
    (
        "'source-content-length: ' || octet_length(encode(payload))",
        "'source-payload-digest: ' || source_digest",
        "'text-length: ' || length(txt)",
        "'links: ' || len(regexp_extract_all(payload, '(?i)<a\\b[^>]*\\bhref\\s*='))",
        "'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)</title', 1), '\\s+', ' ', 'g')) || chr(13) || chr(10)",
    )
)
OP2 = f"""
WITH r AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
    {_urn("'response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '') || chr(10) || coalesce(html, '')")} AS refers_to,
    'sha256:' || sha256(coalesce(html, '')) AS source_digest, {_text("coalesce(html, '')")} AS txt
  FROM pages),
b AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {_FIELDS} AS block FROM r
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', txt FROM r)
SELECT page_id, record_type, {_urn("record_type || chr(10) || refers_to || chr(10) || source_digest")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS date,
  {_HEAD} AS source_headers, source_digest, content_type, block, 'sha256:' || sha256(block) AS block_digest, CAST(octet_length(encode(block)) AS BIGINT) AS content_length
FROM b
"""

OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(d, r) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.d WHERE c.r < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.r, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT d, min(r) AS r FROM c GROUP BY 1) m ON m.d = w.doc_id
"""

_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOW.format("coalesce(text, '')"))
OP10 = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT doc_id, v.n, k, item_id FROM v JOIN b ON v.n = b.n AND v.g = b.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_RATES = [32] * 8 + [128] * 24 + [512] * 40 + [2048] * 24
_TERMS = "list_distinct(list_filter(string_split_regex(lower({0}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> ''))"


def _likeness(a: str, b: str) -> str:
    x, y = (f"regexp_extract_all({c}, '.{{6}}')" for c in (a, b))
    return f"""CASE WHEN {a} = {b} THEN 1.0 WHEN starts_with({a}, 'ff') OR starts_with({b}, 'ff') THEN 0.0 ELSE
      len(list_intersect({x}, {y})) / len(list_distinct(list_transform({x} || {y}, lambda t: left(t, 2)))) END"""


OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next FROM d),
b AS (SELECT doc_id, next, n, text, left(text, n - n // 2) || left(following, n // 2) AS edited FROM o),
w AS (SELECT doc_id, FALSE AS e, {_TERMS.format("text")} AS terms FROM b UNION ALL SELECT doc_id, TRUE, {_TERMS.format("edited")} FROM b),
l AS (
  SELECT term, list_filter(range({len(_RATES)}), lambda j: substring(md5(term || ':' || (j // 8)), j % 8 * 4 + 1, 4) < {[f"{65536 // r:04x}" for r in _RATES]}[j + 1]) AS subsets
  FROM (SELECT unnest(terms) AS term, count(*) AS df FROM w WHERE NOT e GROUP BY 1) t
  WHERE df * 4 <= (SELECT count(*) FROM d) AND df * 2048 >= (SELECT count(*) FROM d)),
h AS (
  SELECT doc_id, e, s, left(md5(string_agg(term, ' ' ORDER BY term)), 4) AS hash
  FROM (SELECT doc_id, e, term, unnest(subsets) AS s FROM (SELECT doc_id, e, unnest(terms) AS term FROM w) u JOIN l USING (term)) x GROUP BY ALL),
m AS (SELECT doc_id, e, string_agg(printf('%02x', s) || hash, '' ORDER BY s) AS f FROM h GROUP BY ALL),
f AS (SELECT w.doc_id, w.e, coalesce(m.f, 'ff' || md5(array_to_string(list_sort(terms), ' '))) AS f FROM w LEFT JOIN m USING (doc_id, e)),
g AS (SELECT doc_id, next, n, sha256(edited) AS edited_sha256, x.f AS a, y.f AS b, z.f AS c
  FROM b JOIN f x USING (doc_id) JOIN f y USING (doc_id) JOIN f z ON z.doc_id = b.next WHERE NOT x.e AND y.e AND NOT z.e)
SELECT doc_id, n AS n_chars, edited_sha256, a AS fingerprint, b AS edited_fingerprint, CAST({_likeness("a", "b")} AS DOUBLE) AS near_edited, CAST({_likeness("a", "c")} AS DOUBLE) AS near_next FROM g
"""


def _lloyd(rounds: int = 10) -> str:
    out = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 8) s)",
    ]
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, x, min({{'d': CAST(list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c}}) AS best FROM v, c{k} GROUP BY vec_id, x)")
        if k == rounds:
            break
        out.append(f"s{k} AS (SELECT best.c AS c, j, sum(x[j]) AS s, count(*) AS n FROM a{k}, range(1, 65) r(j) GROUP BY ALL)")
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, c{k}.m) AS m FROM c{k} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{k} GROUP BY c) n USING (c))")
    return f"""WITH {", ".join(out)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best.c"""


OP12 = _lloyd()
