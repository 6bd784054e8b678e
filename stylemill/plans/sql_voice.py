"""DuckDB SQL of the queries on pronouns: words as rows, judged by the rows before and after them."""

from __future__ import annotations

from ..operators import voice as V
from .sql import listed, sentences

#: Said after the sentences of a turn, for the tables' invented prose has few pronouns.
PHRASES = [
    "You can see the river.", "I think that they walked.", "He saw us, and we went.", "You should note: them and me.", "We can see it; you need to rest.",
    "It's his (you walked).", "That is ours.", "I argue that you have to go, but I'm here.", "Him or her was there.", "you may ask her; your turn.",
]
_ROOT = lambda w: f"CASE WHEN string_split(lower({w}), '''')[1] IN ({listed(V.SUBJECTS)}) THEN string_split(lower({w}), '''')[1] ELSE lower({w}) END"
_PERSON = "CASE " + " ".join(f"WHEN {{0}} IN ({listed(ws)}) THEN '{p}'" for p, ws in V.PERSONS.items()) + " END"
_VERB = f"(next IN ({listed(V.VERBS)}) OR next NOT IN ({listed(V.NO_VERBS)}) AND ({_PERSON.format('next')}) IS NULL AND (regexp_matches(next, '(ed|ing|en)$') OR next LIKE '%s' AND length(next) > 3))"
_SUBJECT = f"(norm IN ({listed(V.SUBJECTS)}) AND (opens OR {_VERB}) OR norm IN ({listed(V.OBJECTS)}) AND opens AND ({_VERB} OR next IN ('and', 'or')))"


def judged(name: str, source: str, key: str, marks: bool) -> str:
    """CTEs: `name`(key, person, subject), a row for each pronoun of the texts of `source` (key, text)."""
    parts = "regexp_split_to_array(text, '[.!?;:]')" if marks else "[text]"
    word = f"({V.WORD})".replace("'", "''").replace("(?:", "(")
    pattern = f"{word}|{V.OPENERS}" if marks else word
    return f"""{name}_p AS (SELECT {key}, unnest(range(len(x))) AS part, unnest(x) AS t FROM (SELECT {key}, {parts} AS x FROM {source})),
{name}_t AS (SELECT {key}, part, unnest(range(len(x))) AS i, unnest(x) AS w FROM (SELECT {key}, part, regexp_extract_all(t, '{pattern}') AS x FROM {name}_p)),
{name}_o AS (SELECT *, coalesce(NOT regexp_matches(lag(w) OVER (PARTITION BY {key}, part ORDER BY i), '^[A-Za-z]'), true) AS opened FROM {name}_t),
{name}_w AS (SELECT {key}, {_ROOT('w')} AS norm, opened OR coalesce(lag(lower(w)) OVER q, '') IN ({listed(V.OPENING_WORDS)}) AS opens, coalesce(lead({_ROOT('w')}) OVER q, '') AS next FROM {name}_o WHERE regexp_matches(w, '^[A-Za-z]') WINDOW q AS (PARTITION BY {key}, part ORDER BY i)),
{name} AS (SELECT {key}, {_PERSON.format('norm')} AS person, {_SUBJECT} AS subject FROM {name}_w WHERE ({_PERSON.format('norm')}) IS NOT NULL)"""


SPOKEN = f"""said AS (SELECT conv_id, turn, list_transform(s, lambda x, i: x || ' ' || [{listed(PHRASES)}][(i - 1) % {len(PHRASES)} + 1]) AS s FROM (SELECT conv_id, turn, {sentences('text')} AS s FROM conversations)),
sp AS (SELECT conv_id, turn, array_to_string(s, ' ') AS text FROM said)"""
_COUNTS = "count(person) FILTER (WHERE person = 'third')::INT AS allowed, count(person) FILTER (WHERE person <> 'third' AND subject)::INT AS violations, count(person) FILTER (WHERE person <> 'third' AND NOT subject)::INT AS other"


def _first(i: int, old: str, new: str) -> str:
    """One phrase put into the third person where it stands first, with its capital."""
    at = rf"(?i)\b{old}\b"
    cased = f"CASE WHEN regexp_matches(regexp_extract(t, '{at}'), '^[A-Z]') THEN '{new[0].upper() + new[1:]}' ELSE '{new}' END"
    return f"r{i + 1} AS (SELECT conv_id, turn, no, old, CASE WHEN regexp_matches(t, '{at}') THEN regexp_replace(t, '{at}', {cased}) ELSE t END AS t FROM r{i})"


_STEPS = ",\n".join(_first(i, *pair) for i, pair in enumerate(V.REPHRASED["third"]))
VOICE = {
    "turn_voices": f"WITH {SPOKEN},\n{judged('u', 'sp', 'conv_id, turn', False)},\n{judged('m', 'sp', 'conv_id, turn', True)}\n"
    + " UNION ALL ".join(f"SELECT sp.conv_id, sp.turn, {marks} AS marks, {_COUNTS} FROM sp LEFT JOIN {n} ON {n}.conv_id = sp.conv_id AND {n}.turn = sp.turn GROUP BY sp.conv_id, sp.turn" for n, marks in (("u", "false"), ("m", "true"))),
    # the sentences of a text follow each other with one space between, so a text is mended by mending them
    "voice_repairs": f"""WITH {SPOKEN},
r0 AS (SELECT conv_id, turn, unnest(range(len(x))) AS no, unnest(x) AS old, unnest(x) AS t FROM (SELECT conv_id, turn, {sentences('text')} AS x FROM sp)),
{_STEPS},
a AS (SELECT conv_id, turn, no, old AS text FROM r0), b AS (SELECT conv_id, turn, no, t AS text FROM r{len(V.REPHRASED['third'])}),
{judged('ja', 'a', 'conv_id, turn, no', False)},
{judged('jb', 'b', 'conv_id, turn, no', False)},
{", ".join(f"{n}c AS (SELECT conv_id, turn, no, count(*) FILTER (WHERE person <> 'third' AND subject) AS bad, count(*) FILTER (WHERE person = 'third') AS good FROM {n} GROUP BY ALL)" for n in ("ja", "jb"))},
z AS (SELECT a.conv_id, a.turn, a.no, a.text AS old, b.text AS new, a.text <> b.text AND coalesce(x.bad, 0) > 0 AND (coalesce(y.bad, 0) < x.bad OR coalesce(y.bad, 0) = x.bad AND coalesce(y.good, 0) > x.good) AS mended
  FROM a JOIN b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.no = a.no LEFT JOIN jac x ON x.conv_id = a.conv_id AND x.turn = a.turn AND x.no = a.no LEFT JOIN jbc y ON y.conv_id = a.conv_id AND y.turn = a.turn AND y.no = a.no)
SELECT conv_id, turn, md5(string_agg(CASE WHEN mended THEN new ELSE old END, ' ' ORDER BY no)) AS text_md5, count(*) FILTER (WHERE mended)::INT AS repairs FROM z GROUP BY conv_id, turn""",
}
