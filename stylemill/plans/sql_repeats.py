"""DuckDB SQL of the query on repeated blocks: one round of the recursion for each block of the longest text."""

from __future__ import annotations

from .sql import sentences, words

#: ratio, lookback, share and least words of the query.
RULE = {"ratio": 0.9, "lookback": 3, "share": 0.2, "least": 4}
_KEY = lambda t: f"lower(trim(regexp_replace(regexp_replace({t}, '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"
_FLAT = "list_transform(s, lambda x: regexp_replace(x, '\\s+', ' ', 'g'))"
#: Sentences as paragraphs; the first of every three comes again after the third, with a word more, and every fifth at once, with a mark more.
_SAID = """flatten(list_transform(s, lambda x, i: CASE WHEN i % 3 = 0 THEN [x, s[i - 2] || ' so.'] WHEN i % 5 = 0 THEN [x, x || ' !'] ELSE [x] END))"""
_ALLOWED = f"floor(((length(r) + length(b.k)) * {1.0 - RULE['ratio']!r} + abs(length(r) - length(b.k))) / 2.0 + 1e-9)"
REPEATS = {
    "prose_repeats": f"""WITH RECURSIVE p AS (SELECT doc_id, {_SAID} AS x FROM (SELECT doc_id, {_FLAT} AS s FROM (SELECT doc_id, {sentences('text')} AS s FROM documents))),
b AS (SELECT doc_id, i, n, t, k, len({words('t')}) >= {RULE['least']} AND regexp_matches(t, '[.!?]') AND k <> '' AS prose FROM (SELECT *, {_KEY('t')} AS k FROM
  (SELECT doc_id, unnest(range(len(x))) AS i, len(x) AS n, unnest(x) AS t FROM p))),
r AS (SELECT doc_id, -1::BIGINT AS i, []::VARCHAR[] AS recent, 0 AS gone, false AS drops FROM p WHERE len(x) > 0 UNION ALL
  SELECT doc_id, i, CASE WHEN hit OR k = '' THEN recent ELSE list_append(recent, k)[-{RULE['lookback']}:] END, gone + hit::INT, hit FROM
  (SELECT r.doc_id, b.i, b.k, recent, gone, b.prose AND gone < greatest(1, floor(b.n * {RULE['share']} + 1e-9)) AND
    len(list_filter(recent, lambda r: r = b.k OR abs(length(r) - length(b.k)) <= {_ALLOWED} AND levenshtein(r, b.k) <= {_ALLOWED})) > 0 AS hit
   FROM r JOIN b ON b.doc_id = r.doc_id AND b.i = r.i + 1))
SELECT b.doc_id, md5(string_agg(trim(b.t), chr(10) || chr(10) ORDER BY b.i) FILTER (WHERE NOT r.drops)) AS text_md5, sum(r.drops::INT)::INT AS dropped FROM b JOIN r ON r.doc_id = b.doc_id AND r.i = b.i GROUP BY b.doc_id
UNION ALL SELECT doc_id, md5(''), 0 FROM p WHERE len(x) = 0"""
}
