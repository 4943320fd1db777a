"""SQL (DuckDB) for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32() -> str:
    quads = []
    for i in range(8):
        v = f"CAST('0x' || substr(x, {5 * i + 1}, 5) AS INTEGER)"
        quads += [f"substr('{_ALPHABET}', (({v} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(quads)


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_base32()} AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM d"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n"""

PASSAGES = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS owner FROM v GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i FROM v JOIN f USING (h) WHERE doc_id > owner), range(50) r(k)),
x AS (SELECT doc_id, w[pos] AS word, pos FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS pos FROM w)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


#: The kinds of parts: rank, kind, expression, class, whether it stands alone. Written out here, so that a slip in the
#: operator's own expressions shows.
_VALUE = "[A-Za-z0-9+/_.=-]+"
_PARTS = [
    (0, "assign", r"((?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?(" + _VALUE + ")", "secret", True),
    (1, "access", "AKIA[A-Z0-9]{12,}", "identifier", True),
    (2, "hex", "[0-9a-f]{32,}", "secret", True),
    (3, "weak_login", r"(?i:user(?:name)?|login|client_?id|access_?key(?:_?id)?)[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9@._-]{3,}", "identifier", False),
    (4, "weak_secret", "[A-Za-z0-9]+[+/=][A-Za-z0-9+/=]{23,}", "secret", False),
    (6, "weak_endpoint", "(?:https?|jdbc:[a-z]+|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:@/-]+", "endpoint", False),
]
#: An assignment of 4 to 7 characters is a weak part, of rank 5; parts belong together within 200 code points.
_FULL, _WEAK, _WEAK_RANK, _SCOPE = 8, 4, 5, 200


def _secrets() -> str:
    parts = []
    for rank, kind, own, class_, alone in _PARTS:
        value = f"list_transform(regexp_extract_all(t, '{own}', 2), lambda m: length(m))" if kind == "assign" else "NULL"
        parts.append(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, '{class_}' AS class, {alone} AS alone, regexp_extract_all(t, '{own}') AS m, regexp_split_to_array(t, '{own}') AS g, {value} AS v FROM d WHERE regexp_matches(t, '{own}')")
    near = []
    for c in ("identifier", "secret"):
        before = f"max(CASE WHEN class = '{c}' THEN e END) OVER (PARTITION BY doc_id ORDER BY s, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        after = f"min(CASE WHEN class = '{c}' THEN s END) OVER (PARTITION BY doc_id ORDER BY s, rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        near.append(f"coalesce(s - {before} <= {_SCOPE}, false) OR coalesce({after} - e <= {_SCOPE}, false) AS near_{c}")
    span = "kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS ({" UNION ALL ".join(parts)}),
i AS (SELECT doc_id, rank, kind, class, alone, m, g, v, unnest(generate_series(1, len(m))) AS k FROM p),
a AS (SELECT doc_id, rank, kind, class, alone, length(m[k]) AS size, v[k] AS value, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s FROM i),
b AS (SELECT doc_id, s, s + size AS e, class, CASE WHEN rank = 0 AND value < {_FULL} THEN {_WEAK_RANK} ELSE rank END AS rank, CASE WHEN rank = 0 AND value < {_FULL} THEN 'weak_assign' ELSE kind END AS kind, alone AND NOT (rank = 0 AND value < {_FULL}) AS alone
 FROM a WHERE rank <> 0 OR value >= {_WEAK}),
l AS (SELECT *, {", ".join(near)} FROM b),
r AS (SELECT * FROM l WHERE alone OR CASE class WHEN 'identifier' THEN near_secret WHEN 'secret' THEN near_identifier ELSE near_secret AND near_identifier END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
sha256(coalesce(string_agg({span}, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


SECRETS = _secrets()

#: The pages of the tables have one article element each, of headings, paragraphs, bold text and line breaks.
MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(h, '\s+|<br>', ' ', 'g'), '</?(p|h1)>', chr(10), 'g'), '<[^>]*(>|$)', '', 'g') AS h FROM a),
c AS (SELECT page_id, url, replace(replace(replace(regexp_replace(replace(h, '&quot;', '"'), '&amp;?', '&', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' ') AS h FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d"""

COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
one AS (SELECT lang, unnest(w) AS g FROM w),
two AS (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
three AS (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2),
f AS (SELECT lang, g, CAST(count(*) AS BIGINT) AS f FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM one GROUP BY lang),
c AS (SELECT lang, g AS phrase, string_split(g, ' ') AS w, f AS a FROM f WHERE g LIKE '% %'),
parts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, (VALUES (1), (2)) x(k) WHERE k < len(w)),
cuts AS (SELECT p.lang, phrase, a, k, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.g = lp JOIN f r ON r.lang = p.lang AND r.g = rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, h AS phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS h FROM c WHERE len(w) = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000"""
