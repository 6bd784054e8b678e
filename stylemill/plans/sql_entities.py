"""DuckDB SQL of the queries on phrases that hold listed names."""

from __future__ import annotations

from ..operators import entities as E
from .sql import MEASURES, listed

_TOKENS = lambda t: f"regexp_extract_all(lower({t}), '[a-z0-9]+')"
_CLAUSES = lambda t: f"unnest(regexp_split_to_array({t}, '[.,;:!?\\n]+'))"
_NAMES = f"""pt AS ({MEASURES["page_titles"]}),
nm AS (SELECT DISTINCT array_to_string({_TOKENS("strip_accents(trim(c))")}, ' ') AS name FROM (SELECT {_CLAUSES("title")} AS c FROM pt)),
names AS (SELECT name FROM nm WHERE length(name) >= 3 OR contains(name, ' ')),
cl AS (SELECT profile, lower(trim(c)) AS phrase FROM (SELECT source AS profile, {_CLAUSES("text")} AS c FROM documents) WHERE trim(c) <> ''),
tk AS (SELECT phrase, {_TOKENS("phrase")} AS w FROM (SELECT DISTINCT phrase FROM cl)),
runs AS (SELECT phrase, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT phrase, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM tk JOIN (SELECT DISTINCT len(string_split(name, ' ')) AS k FROM names) ON k <= len(w))),
hold AS (SELECT DISTINCT phrase FROM runs WHERE run IN (SELECT name FROM names))"""
_MONTH = f"len(list_intersect({_TOKENS('phrase')}, [{listed(E.MONTHS)}])) > 0"
_DATED = f"({_MONTH} AND (len(list_filter({_TOKENS('phrase')}, lambda x: regexp_full_match(x, '[0-9]+'))) > 0 OR regexp_matches(phrase, '{E.ORDINAL}')) OR regexp_matches(phrase, '{E.DATES}'))"
_WORDS = "regexp_extract_all(phrase, '[a-z][a-z''-]*')"
ENTITIES = {
    "named_phrases": f"WITH {_NAMES}\nSELECT phrase FROM hold",
    # the phrases are in lower case, so capitals count by the shares of their tokens alone
    "unnamed_phrases": f"""WITH {_NAMES},
ph AS (SELECT profile, phrase, count(*) AS n FROM cl GROUP BY ALL),
cr AS ({MEASURES["cap_ratio"]}),
tr AS (SELECT t.profile, t.phrase, max(cap_ratio) AS m, count(*) FILTER (WHERE cap_ratio >= {E.TWO}) AS two FROM (SELECT profile, phrase, unnest({_WORDS}) AS token FROM ph) t JOIN cr ON cr.profile = t.profile AND cr.token = t.token GROUP BY ALL)
SELECT ph.profile, ph.phrase, n FROM ph LEFT JOIN tr ON tr.profile = ph.profile AND tr.phrase = ph.phrase
WHERE NOT regexp_matches(ph.phrase, '[a-z]') AND coalesce(m, 0) < {E.ALONE} OR ph.phrase NOT IN (SELECT phrase FROM hold) AND NOT {_DATED.replace("phrase", "ph.phrase")}
  AND len(list_intersect({_WORDS.replace("phrase", "ph.phrase")}, [{listed(E.HONORIFICS)}])) = 0 AND coalesce(m, 0) < {E.ALONE} AND coalesce(two, 0) < 2""",
}
