"""DuckDB SQL for the queries that SQL can state, over whole tables."""

from __future__ import annotations

from spanwright.llm.licenses import TEMPLATES

_TEMPLATE_ROWS = ", ".join("('{}', '{}', '{}')".format(t.license_id, t.name, t.text.replace("'", "''")) for t in TEMPLATES)

OP2 = rf"""
WITH t AS (
  SELECT license_id, template, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM (SELECT license_id, template, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(license_id, template, body))
), lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS unit FROM documents
), units AS (
  SELECT doc_id, unit, body FROM lines UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, unit, body FROM (
    SELECT doc_id, unnest(string_split_regex(text, '\n([^\p{{L}}\p{{N}}\n]*\n)+')) AS body, -unnest(range(1, len(string_split_regex(text, '\n([^\p{{L}}\p{{N}}\n]*\n)+')) + 1)) AS unit
    FROM documents WHERE regexp_matches(text, '\n([^\p{{L}}\p{{N}}\n]*\n)+')
  ) WHERE contains(body, chr(10))
), u AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM (SELECT doc_id, unit, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM units)
), scored AS (
  SELECT doc_id, unit, license_id, template, len(t.grams) AS n, 2.0::DOUBLE * len(list_intersect(u.grams, t.grams)) / (len(u.grams) + len(t.grams)) AS dice
  FROM u JOIN t ON len(u.grams) BETWEEN len(t.grams) * 0.6 AND len(t.grams) * 1.7 AND len(u.grams) > 0
)
SELECT doc_id, unit, license_id, template, dice
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, n DESC, license_id, template) AS nth FROM scored WHERE dice >= 0.8)
WHERE nth = 1
"""

OP3 = r"""
WITH bytes AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), first AS (
  SELECT hex, min(page_id) AS first_id FROM bytes GROUP BY hex
), bits AS (
  -- base32: five bytes at a time are eight letters of five bits
  SELECT hex, string_agg(letters, '' ORDER BY i) AS digest
  FROM (
    SELECT hex, i, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> (35 - 5 * j)) & 31 AS INTEGER), 1), '' ORDER BY j) AS letters
    FROM (SELECT hex, i, CAST('0x' || substr(hex, 1 + 10 * i, 10) AS BIGINT) AS v FROM first, range(4) AS a(i)), range(8) AS b(j)
    GROUP BY hex, i
  )
  GROUP BY hex
)
SELECT b.page_id, octet_length(b.payload) AS payload_bytes, bits.digest AS payload_digest,
       CASE WHEN b.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM bytes b JOIN first f USING (hex) JOIN bits USING (hex)
"""

OP6 = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END AS raw_host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT p.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY p.page_id
), f(name, verdict, n, pattern) AS (
  VALUES ('||m.*.html|', 'block', 8, '^[^:/?#]+://([^/?#]*\.)?m\..*\.html$'),
         ('||ads.', 'block', 4, '^[^:/?#]+://([^/?#]*\.)?ads\.'), ('||adserver.', 'block', 9, '^[^:/?#]+://([^/?#]*\.)?adserver\.'),
         ('||banner.', 'block', 7, '^[^:/?#]+://([^/?#]*\.)?banner\.'), ('||tracker.', 'block', 8, '^[^:/?#]+://([^/?#]*\.)?tracker\.'),
         ('||pixel.', 'block', 6, '^[^:/?#]+://([^/?#]*\.)?pixel\.'), ('||casino.', 'block', 7, '^[^:/?#]+://([^/?#]*\.)?casino\.'),
         ('/pixel.gif^', 'block', 11, '/pixel\.gif([^a-z0-9_.%-]|$)'), ('/ads/', 'block', 5, '/ads/'), ('/banner/', 'block', 8, '/banner/'),
         ('/casino/', 'block', 8, '/casino/'), ('@@/ads/txt/', 'allow', 9, '/ads/txt/')
), pat AS (
  SELECT page_id, arg_max(verdict, (n, name)) AS verdict FROM pages JOIN f ON regexp_matches(url, '(?is)' || pattern) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.verdict, pat.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN pat USING (page_id)
"""

OP9 = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), bad AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad ON k.key = bad.key
GROUP BY k.doc_id
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), total AS (
  SELECT lang, count(*) AS n FROM starts GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS a
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 5) AS t(k) WHERE i + k - 1 <= len(w))
  GROUP BY lang, k, phrase HAVING count(*) >= 30
), long AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM long) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS over
  FROM long, range(2, 4) AS t(s), range(1, 4) AS u(i) WHERE s < k AND i + s - 1 <= k GROUP BY ALL
), left_over AS (
  SELECT s.* FROM scored AS s LEFT JOIN inner_phrases AS p USING (lang, phrase)
  WHERE p.over IS NULL OR 100::HUGEINT * p.over < 80::HUGEINT * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
