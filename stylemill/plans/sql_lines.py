"""DuckDB SQL of the queries on lines of Markdown, over documents that are dressed as Markdown, and over pages."""

from __future__ import annotations

from ..functions import lexicons as L
from .sql import listed, sentences

FENCE = "(?m)^[ \\t]*```[^\\n]*\\n(?s:.*?)^[ \\t]*```[^\\n]*(?:\\n|\\z)|^[ \\t]*~~~[^\\n]*\\n(?s:.*?)^[ \\t]*~~~[^\\n]*(?:\\n|\\z)|^[ \\t]*(?:```|~~~)(?s:.*)\\z"
ATX, NOTE, ITEM = r"^\s*(#{1,8})\s+(.*?)\s*#*\s*$", r"^\s*\[\^[^\]]+\]:", r"^\s*(?:[-*+]|\d+[.)])\s+"
_LINES = [
    "repeat('#', 1 + ((i - 1) // 12 % 3)::INT) || ' ' || x", "x", "'```' || chr(10) || x || chr(10) || '```'", "'> ' || x", "'- ' || x", "'- ' || x", "chr(10) || x",
    "'[^' || i || ']: ' || x || chr(10) || '    ' || x", "'## References' || chr(10) || x", "x || chr(10) || chr(10) || '~~~' || chr(10) || '```' || chr(10) || x || chr(10) || '~~~'", "x || chr(10) || '---'", "'  - ' || x",
]
#: Each sentence of a document as one of twelve kinds of lines, in turn.
MD = f"md AS (SELECT doc_id, array_to_string(list_transform(s, lambda x, i: CASE (i - 1) % 12 {' '.join(f'WHEN {k} THEN {e}' for k, e in enumerate(_LINES))} END), chr(10)) AS text FROM (SELECT doc_id, {sentences('text')} AS s FROM documents))"
_KEY = lambda t: f"trim(regexp_replace(regexp_replace(lower(regexp_replace({t}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_TRIM = lambda t: f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
_UNFENCED = f"regexp_replace(regexp_replace(text, '{FENCE}', '', 'g'), '\\n$', '')"


def apparatus(source: str, key: str) -> str:
    """CTEs: ap(key, text), the text column of `source` without block quotes, footnotes and references."""
    under = "trim(lead(line) OVER w)"
    return f"""l AS (SELECT {key}, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT {key}, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM
  (SELECT {key}, regexp_replace(text, '(?is)<blockquote[^>]*>.*?</blockquote>', chr(10), 'g') AS text FROM {source}))),
h AS (SELECT *, CASE WHEN regexp_matches(line, '{ATX}') THEN length(regexp_extract(line, '{ATX}', 1)) WHEN trim(line) <> '' AND regexp_full_match({under}, '=+') THEN 1 WHEN trim(line) <> '' AND regexp_full_match({under}, '-+') THEN 2 END AS level,
  CASE WHEN regexp_matches(line, '{ATX}') THEN trim(regexp_extract(line, '{ATX}', 2)) ELSE trim(line) END AS title,
  regexp_matches(line, '{NOTE}') AS note, line[1:4] = '    ' OR line[1:1] = chr(9) AS indented FROM l WINDOW w AS (PARTITION BY {key} ORDER BY n)),
r AS (SELECT {key}, n AS lo, coalesce((SELECT min(n) FROM h b WHERE b.{key} = a.{key} AND b.n > a.n AND b.level <= a.level), 1000000000) AS hi FROM h a WHERE level IS NOT NULL AND {_KEY('title')} IN ({listed(sorted(L.REFERENCE_HEADINGS))})),
k AS (SELECT *, EXISTS (SELECT 1 FROM r WHERE r.{key} = h.{key} AND r.lo <= h.n AND h.n < r.hi) AS skip,
  note OR indented AND coalesce(last_value(CASE WHEN note OR NOT indented THEN note END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY n), false) AS noted FROM h),
ap AS (SELECT {key}, {_TRIM("regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT skip AND NOT noted AND NOT regexp_matches(line, '^" + chr(92) + "s*>')), ''), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS text FROM k GROUP BY {key})"""


#: Parts of a text in order: prose and fences by turns. A part's lines are those before its last line feed.
PARTS = f"""pt AS (SELECT doc_id, unnest(range(len(p))) AS part, unnest(p) AS prose, unnest(list_concat(c, [''])) AS code FROM
  (SELECT doc_id, string_split(regexp_replace(text, '{FENCE}', chr(1), 'g'), chr(1)) AS p, regexp_extract_all(text, '{FENCE}') AS c FROM md)),
pc AS (SELECT doc_id, part, 0 AS kind, prose AS t FROM pt WHERE prose <> '' UNION ALL SELECT doc_id, part, 1, code FROM pt WHERE code <> '')"""
BLOCKS = """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, kind, j) - 1)::INT AS block_no, kind = 1 AS code, t FROM
  (SELECT doc_id, part, kind, unnest(range(len(x))) AS j, unnest(x) AS t FROM (SELECT *, CASE WHEN kind = 1 THEN [regexp_replace(t, '\\n$', '')]
  ELSE list_filter(list_transform(regexp_split_to_array(t, '\\n(?:[ \\t]*\\n)+'), lambda y: regexp_replace(y, '^\\n+|\\n+$', '', 'g')), lambda y: trim(y) <> '') END AS x FROM pc))"""
_NUMBERED = "ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, kind, j) - 1 AS n FROM (SELECT doc_id, part, kind, unnest(range(len(x))) AS j, unnest(x) AS line FROM (SELECT *, string_split(regexp_replace(t, '\\n$', ''), chr(10)) AS x FROM pc)))"

_MONTHS = "'january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'"
_YEAR = "(?:19|20)\\d{2}[a-z]?\\b"
_CITED = (
    f"regexp_matches(x, '\\b{_YEAR}') AND (regexp_matches(x, '(?i)\\bet\\s+al\\b|\\b(?:cf\\.|see\\b)') OR regexp_matches(x, '[,;]')"
    + f" OR len(list_filter(regexp_extract_all(x, '\\b([A-Z][A-Za-z''’.-]+)\\s+{_YEAR}', 1), lambda m: lower(m) NOT IN ({_MONTHS}))) > 0)"
)
_TWO = lambda q: f"[^A-Za-z0-9{q}]*[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?[^A-Za-z0-9{q}]+[A-Za-z0-9][^{q}]*"


def chained(text: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return text


_ROW = chained(
    "text", ('"' + _TWO('"') + '"|“' + _TWO("”") + "”", "''"), ("``[^`\\n]+``|`[^`\\n]+`", "''"), (r"(?s)\\\[.*?\\\]", "chr(10)"), (r"(?s)\\\(.*?\\\)", "''"), (r"(?s)\$\$.*?\$\$", "chr(10)"), (r"\$[^$]*\$", "''"), (r"\\[A-Za-z]+(?:\{[^}]*\})?", "''"),
    ("(?is)<[A-Za-z][^>]*>.*?</[A-Za-z][^>]*>", "chr(10)"), ("(?is)<!--.*?-->", "''"), ("<[A-Za-z/][^>]*>", "''"), ("&[A-Za-z0-9#]+;", "''"), (r"\[\[BASE64_IMAGE(?:_\d+)?\]\]", "''"), (r"\[\^[^\]]+\]", "''"), (r"\[(?:\d+|[IVX]+)(?:\s*[-–,;]\s*(?:\d+|[IVX]+))*\]", "''"),
)
_VOICE = f"""vt AS (SELECT page_id, {_ROW} AS text FROM ap),
vc AS (SELECT page_id, list_reduce(list_prepend(text, list_filter(regexp_extract_all(text, '\\([^()]{{1,80}}\\)'), lambda x: {_CITED})), lambda a, x: replace(a, x, '')) AS text FROM vt),
v AS (SELECT page_id, trim({chained(_TRIM(chained("text", ("[ " + chr(92) + "t]{2,}", "' '"), (" *" + chr(92) + "n *", "chr(10)"))), (chr(92) + "n{3,}", "chr(10) || chr(10)"))}) AS text FROM vc)"""

LINES: dict[str, str] = {
    "markdown_unfenced": f"WITH {MD} SELECT doc_id, md5({_UNFENCED}) AS text_md5, CAST(length({_UNFENCED}) AS BIGINT) AS chars FROM md",
    "markdown_apparatus": f"WITH {MD}, u AS (SELECT doc_id, {_UNFENCED} AS text FROM md),\n{apparatus('u', 'doc_id')}\nSELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS chars FROM ap",
    "markdown_blocks": f"WITH {MD},\n{PARTS},\nb AS ({BLOCKS})\nSELECT doc_id, block_no, code, md5(t) AS text_md5 FROM b",
    "markdown_sections": f"""WITH {MD},\n{PARTS},\n{_NUMBERED},
hd AS (SELECT *, lead(n) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM ln WHERE kind = 0 AND regexp_matches(line, '{ATX}'))
SELECT hd.doc_id, hd.n::INT AS start_line, trim(regexp_extract(any_value(hd.line), '{ATX}', 2)) AS title, {_KEY("trim(regexp_extract(any_value(hd.line), '" + ATX + "', 2))")} AS title_key, length(regexp_extract(any_value(hd.line), '{ATX}', 1))::INT AS level,
  (max(ln.n) + 1)::INT AS end_line, md5(string_agg(ln.line, chr(10) ORDER BY ln.n)) AS block_md5 FROM hd JOIN ln ON ln.doc_id = hd.doc_id AND ln.n >= hd.n AND ln.n < coalesce(stop, 1000000000) GROUP BY hd.doc_id, hd.n""",
    "markdown_lists": f"""WITH {MD}, l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM md)),
i AS (SELECT *, length(regexp_extract(line, '^(\\s*)', 1)) AS indent, n - row_number() OVER (PARTITION BY doc_id, length(regexp_extract(line, '^(\\s*)', 1)) ORDER BY n) AS run FROM l WHERE regexp_matches(line, '{ITEM}')),
c AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY doc_id, indent, run) AS items FROM i WINDOW w AS (PARTITION BY doc_id, indent, run ORDER BY n)),
g AS (SELECT doc_id, min(n) AS n, arg_min(rtrim(line), n) AS head, string_agg(CASE WHEN place % 2 = 0 THEN regexp_replace(line, '[ .;]+$', '') ELSE regexp_replace(regexp_replace(line, '[ .;]+$', ''), '{ITEM}', '') END, '; ' ORDER BY n) AS line, count(*) - 1 AS saved FROM c WHERE items >= 2 GROUP BY doc_id, indent, run, place // 2),
o AS (SELECT doc_id, n, line, 0 AS saved FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND c.n = l.n AND items >= 2) UNION ALL SELECT doc_id, n, line || CASE WHEN ends_with(head, '.') THEN '.' ELSE '' END, saved FROM g)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n)) AS text_md5, sum(saved)::BIGINT AS merged FROM o GROUP BY doc_id""",
    "voice_filtered_pages": f"WITH u AS (SELECT page_id, {_UNFENCED.replace('text', 'html')} AS text FROM pages),\n{apparatus('u', 'page_id')},\n{_VOICE}\nSELECT page_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM v",
}
