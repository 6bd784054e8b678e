"""DuckDB SQL of feedback on documents, of their rating by the shorter lists, and of profiles that lack sections."""

from __future__ import annotations

from ..functions import lexicons as L
from ..operators import profile as P
from . import sql
from .sql import D, listed

_RATED_AT = [i for i, m in enumerate(L.PUNCTUATION, 1) if m not in L.UNRATED["punctuation"]]
_OWN = sql._vectors("o", "doc_id")
_BOTH = "FROM o_v o JOIN d ON d.doc_id = o.k JOIN t_v t ON t.k = d.profile"

_value = lambda s, i: f"o.{s}[{i}], t.{s}[{i}]"
_apart = lambda s, i: f"abs(o.{s}[{i}] - t.{s}[{i}]) / greatest(abs(t.{s}[{i}]), 1.0)"
#: metric, its path, the section's advice, how far it is off, the limit, actual and target, in the order of the deltas.
_ROWS = [
    ("sentence_length_histogram", "", sql._half("sentence"), 0.15, _value("sentence", 1)), ("paragraph_length_histogram", "", sql._half("paragraph"), 0.15, _value("paragraph", 1)),
    ("one_sentence_paragraph_rate", "", sql._ONE, 0.1, _value("one_sentence", 1)),
    *[(s, m, _apart(s, i), sql._LIMIT.get(s, 0.6), _value(s, i)) for s in (*sql._RATES, "orthography") for i, m in enumerate(P.METRICS[s], 1)],
]
_LONG = " UNION ALL ".join(
    f"SELECT o.k AS doc_id, t.k AS profile, {place} AS place, '{s}{'.' if m else ''}{m}' AS metric, '{P.PATHS[s]}{'.' if m else ''}{m}' AS path, '{P.ADVICE[s]}' AS advice, {'true' if s.endswith('histogram') else 'false'} AS bins, {diff} AS diff, {limit} AS most, {value.split(', ')[0]} AS actual, {value.split(', ')[1]} AS target {_BOTH}"
    for place, (s, m, diff, limit, value) in enumerate(_ROWS)
)
#: Sections that sources lack whose number is a multiple.
LACKING = {"stance": 2, "syntax_texture": 3, "function_words": 5, "repetition": 7}
_COMPONENT = {"stance": "stance_signals", "syntax_texture": "syntax_texture", "function_words": "function_words_distribution", "repetition": "repetition"}
_there = {_COMPONENT[s]: f"(substr(a, 4)::INT % {n} <> 0 AND substr(b, 4)::INT % {n} <> 0)" for s, n in LACKING.items()}
_SEEN = {k: f"CASE WHEN {_there[k]} THEN {k} END" if k in _there else k for k in L.SIMILARITY_WEIGHTS}
_USED = " + ".join(f"CASE WHEN {k} IS NULL THEN 0.0 ELSE {w} END" for k, w in L.SIMILARITY_WEIGHTS.items())
_MEAN = " + ".join(f"CASE WHEN {k} IS NULL THEN 0.0 ELSE least(1.0, {k}) * {w} END" for k, w in L.SIMILARITY_WEIGHTS.items())
_ALL = sum(L.SIMILARITY_WEIGHTS.values())
PROFILES = {
    "compliance_rated": sql._SCORED.replace(_OWN, _OWN.replace(listed(L.STOP_WORDS), listed(L.RATED_STOP_WORDS)), 1).replace("range(1, len(o.punctuation) + 1)", str(_RATED_AT))
    + "SELECT doc_id, profile, round(score, 6) AS score, CAST(deltas AS INT) AS deltas FROM z",
    "compliance_feedback": f"WITH {D},\n{_OWN},\n{sql._vectors('t', 'profile')},\nl AS ({_LONG})\nSELECT doc_id, profile, (rank - 1)::INT AS rank, metric, path, round(diff, 6) AS diff, round(actual, 6) AS actual, round(target, 6) AS target, "
    "CASE WHEN bins THEN NULL WHEN actual > target THEN 'less' ELSE 'more' END AS change, advice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY diff DESC, place) AS rank FROM l WHERE diff > most) WHERE rank <= 5",
    "partial_similarity": sql._PAIRS
    + f", g AS (SELECT a, b, least_words, {', '.join(f'{e} AS {k}' for k, e in _SEEN.items())} FROM s), h AS (SELECT *, {_USED} AS used, {_MEAN} AS total FROM g)\n"
    + f"SELECT a, b, {', '.join(f'round({k}, 6) AS {k}' for k in _SEEN)}, round(total / used, 6) AS similarity, round(least(1.0, 0.6 * used / {_ALL!r} + 0.4 * (1.0 - exp(-least_words / 20000.0))), 6) AS confidence, round(used / {_ALL!r}, 6) AS coverage FROM h",
}
