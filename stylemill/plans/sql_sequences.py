"""DuckDB SQL of n-grams that cross documents, with ties by first occurrence."""

from __future__ import annotations

from ..functions import lexicons as L
from .sql import D, listed, sentences, top, with_, words
from .sql_lines import BLOCKS, MD, PARTS

_T = f"tk AS (SELECT profile, doc_id, unnest(range(len(w))) AS i, unnest(w) AS t FROM (SELECT profile, doc_id, {words('lower(text)')} AS w FROM d))"


def _corpus(n: int, name: str = "g") -> str:
    ahead = [f"lead(t, {k}) OVER w" for k in range(1, n)]
    stops = " + ".join(f"CAST({c} IN ({listed(L.STOP_WORDS)}) AS INT)" for c in ["t", *(f"t{k}" for k in range(1, n))])
    return (
        f"x{n} AS (SELECT profile, t, {', '.join(f'{e} AS t{k}' for k, e in enumerate(ahead, 1))}, row_number() OVER w AS pos FROM tk WINDOW w AS (PARTITION BY profile ORDER BY doc_id, i)), "
        + f"{name} AS (SELECT profile, t || ' ' || {' || chr(32) || '.join(f't{k}' for k in range(1, n))} AS phrase, count(*) AS n, min(pos) AS first FROM x{n} WHERE t{n - 1} IS NOT NULL AND {stops} < {n - 1} GROUP BY ALL)"
    )


def _share(n: int) -> str:
    return f"(SELECT profile, round(CAST(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS DOUBLE) / greatest(1, sum(n)), 6) AS r{n} FROM g{n} GROUP BY profile)"


SEQUENCES: dict[str, str] = {
    "bigrams_corpus": with_(D, _T, _corpus(2), select=top("g", "phrase", "n DESC, first", 30)),
    "trigrams_corpus": with_(D, _T, _corpus(3), select=top("g", "phrase", "n DESC, first", 30)),
    "repetition_corpus": with_(D, _T, _corpus(2, "g2"), _corpus(3, "g3"), select=f"SELECT profile, coalesce(r2, 0.0) AS bigram_repeat_rate, coalesce(r3, 0.0) AS trigram_repeat_rate FROM (SELECT DISTINCT profile FROM d) LEFT JOIN {_share(2)} USING (profile) LEFT JOIN {_share(3)} USING (profile)"),
    "openers_corpus": with_(
        D, f"s0 AS (SELECT profile, doc_id, unnest(range(len(x))) AS i, unnest(x) AS sentence FROM (SELECT profile, doc_id, {sentences('text')} AS x FROM d))",
        f"o AS (SELECT profile, doc_id, i, ({words('lower(sentence)')})[1:3] AS o FROM s0), p AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY doc_id, i) AS pos FROM o)",
        f"c AS (SELECT profile, array_to_string(o, ' ') AS phrase, count(*) AS n, min(pos) AS first FROM p WHERE len(o) >= 2 AND len(list_filter(o, lambda x: x IN ({listed(L.STOP_WORDS)}))) <= 1 GROUP BY ALL)",
        select=top("c", "phrase", "n DESC, first", 20),
    ),
}


def packing(source: str, group: str, budget: int) -> str:
    """A walk over the rows (group, r, size) of `source`, one after the other: group, r, batch."""
    return f"""walk AS (
  SELECT {group}, r, size AS used, 0 AS batch FROM {source} WHERE r = 1
  UNION ALL SELECT n.{group}, n.r, CASE WHEN used + n.size > {budget} THEN n.size ELSE used + n.size END, CASE WHEN used + n.size > {budget} THEN batch + 1 ELSE batch END
  FROM walk JOIN {source} n ON n.{group} = walk.{group} AND n.r = walk.r + 1
)"""


SEQUENCES["document_batches"] = f"""WITH RECURSIVE {D},
s AS (SELECT profile, doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS size, row_number() OVER (PARTITION BY profile ORDER BY doc_id) AS r FROM d),
{packing("s", "profile", 4096 - 512)}
SELECT profile, doc_id, size AS tokens, batch FROM walk JOIN s USING (profile, r)"""
SEQUENCES["chunk_bounds"] = f"""WITH RECURSIVE {MD},
{PARTS},
b AS ({BLOCKS}),
s AS (SELECT doc_id, block_no, length(t) + 2 AS size, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS r FROM b),
{packing("s", "doc_id", 4 * 64 + 2)}
SELECT doc_id, batch AS chunk, min(block_no) AS first, max(block_no) AS last, sum(size)::BIGINT - 2 AS chars FROM walk JOIN s USING (doc_id, r) GROUP BY doc_id, batch"""
