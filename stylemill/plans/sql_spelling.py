"""DuckDB SQL of the spelling query: documents with English phrases between their sentences, and a small table of rules."""

from __future__ import annotations

from ..operators import spelling as S
from .sql import listed, sentences

_ALL = lambda us, other: {"us": us, "british": other, "australian": other}
#: Our own small table; a user brings another.
RULES = [
    {"kind": "context", "variants": _ALL("tire", "tyre") | {"canadian": "tire"}, "apply_any": ["wheel", "axle", "car"], "avoid_any": ["easily", "soon"]},
    {"kind": "context", "variants": _ALL("meter", "metre") | {"canadian": "metre"}, "block_any": ["parking", "gas"], "near": 3},
    {"kind": "context", "variants": _ALL("meter", "metre"), "apply_any": ["long"], "near": 2},
    {"kind": "direct", "variants": _ALL("gray", "grey") | {"canadian": "grey"}}, {"kind": "direct", "variants": _ALL("catalog", "catalogue")}, {"kind": "direct", "variants": _ALL("tire", "tyre")},
    {"kind": "suffix", "variants": _ALL("color", "colour") | {"canadian": "colour"}, "suffixes": ["", "s", "ed", "ing"]}, {"kind": "suffix", "variants": _ALL("organize", "organise"), "suffixes": ["", "s", "d", "er", "ing", "ation"]},
    {"kind": "double", "variants": {"us": "travel"}, "suffixes": ["ed", "ing"]}, {"kind": "double", "variants": {"us": "label"}, "suffixes": ["ed", "ing"]},
]
PHRASES = [
    "The tire near the wheel is gray.", "A tire of it, a long way from any car!", "Colors were COLORED in src/color.py and in the catalog.", "We organize; they practise to license the meter's axle.", "Parking meter, gas meter.",
    "See http://gray.example or me@gray.org, gray_x and GRAYish.", "Travelled and traveled, labeling it.", "It will tire easily, it will tire soon.", "The organization of the practise, a licence for Gray.", "meters long: a meter long", "the color's gray, the colors' tires.", "Catalog.",
]
LOCALE = "british"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"


def _rows() -> str:
    out = []
    for i, r in enumerate(RULES):
        v = r["variants"]
        out += [f"({i}, '{r['kind']}', '{x}', {repr(v[LOCALE]) if LOCALE in v else 'NULL'}, {_list(r.get('suffixes', []))}, {_list(r.get('apply_any', []))}, {_list(r.get('avoid_any', []))}, {_list(r.get('block_any', []))}, {r.get('near', S.NEAR)})" for x in dict.fromkeys(v.values())]
    return ", ".join(out)


_TEXT = f"en AS (SELECT doc_id, array_to_string(list_transform(s, lambda x, i: x || ' ' || list_extract({_list(PHRASES)}, ((i - 1) % {len(PHRASES)} + 1)::INT)), ' ') AS text FROM (SELECT doc_id, {sentences('text')} AS s FROM documents))"
_W = S.WORD.replace("'", "''")
_CASED = lambda a, b: f"CASE WHEN {a} = upper({a}) THEN upper({b}) WHEN {a} = upper({a}[1:1]) || lower({a}[2:]) THEN upper({b}[1:1]) || lower({b}[2:]) ELSE lower({b}) END"
_NEAR = lambda xs, n: f"list_has_any(list_filter(around, lambda y: y.p BETWEEN pos - {n} AND pos + {n}).list_transform(lambda y: y.w), {xs})"
_VERB, _NOUN = f"(prev IN ({listed(S.BEFORE_VERB)}) OR nxt IN ({listed(S.AFTER_VERB)}))", f"(prev IN ({listed(S.BEFORE_NOUN)}) OR ends_with(prev, '''s') OR nxt IN ({listed(S.AFTER_NOUN)}))"
_PAIR = lambda words, verb, noun: f"WHEN low IN ({listed(words)}) THEN nullif(CASE WHEN {_VERB} THEN '{verb}' WHEN {_NOUN} THEN '{noun}' END, low)"

SPELLING = f"""WITH {_TEXT},
r(rank, kind, variant, target, suffixes, apply_any, avoid_any, block_any, near) AS (VALUES {_rows()}),
sx AS (SELECT rank, variant, target, unnest(suffixes) AS s FROM r WHERE kind = 'suffix' AND target IS NOT NULL),
pl AS (
  SELECT variant AS form, target, 1 AS o, rank FROM r WHERE kind = 'direct' AND target IS NOT NULL
  UNION ALL SELECT variant || s, target || s, 2, rank FROM sx
  UNION ALL SELECT variant[:-2] || s, CASE WHEN ends_with(target, 'e') THEN target[:-2] ELSE target END || s, 2, rank FROM sx WHERE ends_with(variant, 'e') AND regexp_matches(s, '^[aeiouy]')
  UNION ALL SELECT variant || s, variant[:-2] || 'll' || s, 3, rank FROM (SELECT rank, variant, unnest(suffixes) AS s FROM r WHERE kind = 'double')
),
plain AS (SELECT form, arg_min(target, o * 1000 - rank) AS plain FROM pl GROUP BY form),
pc AS (SELECT doc_id, unnest(range(len(g))) AS pos, unnest(g) AS gap, unnest(list_concat(w, [NULL])) AS word FROM (SELECT doc_id, regexp_split_to_array(text, '{_W}') AS g, regexp_extract_all(text, '{_W}') AS w FROM en)),
nb AS (SELECT *, lower(word) AS low, list(struct_pack(p := pos, w := lower(word))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {S.NEAR} PRECEDING AND {S.NEAR} FOLLOWING) AS around,
  array_to_string(list(gap || coalesce(word, '')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS b0, array_to_string(list(gap || coalesce(word, '')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS a0,
  lower(coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), '')) AS prev, lower(coalesce(lead(word) OVER (PARTITION BY doc_id ORDER BY pos), '')) AS nxt FROM pc),
t AS (SELECT *, coalesce(b0, '') || gap AS b, coalesce(a0, '')[1:6] AS a, CASE WHEN regexp_matches(word, '(?i)''s$') OR (regexp_matches(word, '(?i)s''$') AND length(word) > 2) THEN word[-2:] ELSE '' END AS tail FROM nb),
k AS (SELECT t.*, left(word, length(word) - length(tail)) AS base, plain FROM t LEFT JOIN plain ON form = left(low, length(low) - length(tail))),
cx AS (SELECT k.doc_id, k.pos, r.rank, r.target, {_NEAR('block_any', 'near')} AS forbids, len(apply_any) = 0 OR {_NEAR('apply_any', 'near')} AS asked, {_NEAR('avoid_any', 'near')} AS avoids FROM k JOIN r ON r.kind = 'context' AND r.target IS NOT NULL AND r.variant = lower(k.base)),
cd AS (SELECT doc_id, pos, coalesce(arg_min(CASE WHEN forbids OR avoids THEN '' ELSE target END, rank) FILTER (WHERE forbids OR asked), '') AS decided, count(*) AS rules FROM cx GROUP BY doc_id, pos),
n AS (SELECT k.*, rules, CASE WHEN tail = '' AND (CASE {_PAIR(['practice', 'practise'], 'practise', 'practice')} {_PAIR(['license', 'licence'], 'license', 'licence')} END) IS NOT NULL
    THEN (CASE {_PAIR(['practice', 'practise'], 'practise', 'practice')} {_PAIR(['license', 'licence'], 'license', 'licence')} END) ELSE coalesce(decided, plain) END AS target,
  (upper(word) = word AND length(word) > 2) OR regexp_matches(right(b, 6) || word || a, '[/\\\\]') OR regexp_matches(b, '[A-Za-z]:$') OR (ends_with(rtrim(b), '.') AND regexp_matches(right(b, 16), '[/\\\\]'))
  OR regexp_matches(right(b, 3) || word || a[1:3], '__|@') OR contains(lower(right(b, 8)), 'http') OR (word <> lower(word) AND word <> upper(word) AND NOT regexp_full_match(word, '[A-Z][a-z'']*'))
  OR (regexp_matches(word, '^[A-Z]') AND NOT regexp_matches(b, '^\\s*$|[.!?]\\s*$') AND NOT ((plain IS NOT NULL OR rules IS NOT NULL) AND tail = '')) OR regexp_matches(b, '[\\p{{L}}\\p{{N}}_]$') OR regexp_matches(a, '^[\\p{{L}}\\p{{N}}_]') AS keeps
  FROM k LEFT JOIN cd ON cd.doc_id = k.doc_id AND cd.pos = k.pos),
z AS (SELECT doc_id, pos, gap, word, CASE WHEN NOT keeps AND coalesce(target, '') <> '' THEN ({_CASED('base', 'target')}) || tail END AS new FROM n)
SELECT doc_id, md5(string_agg(gap || coalesce(new, word, ''), '' ORDER BY pos)) AS text_md5, count(*) FILTER (WHERE new <> word) AS replaced FROM z GROUP BY doc_id"""
