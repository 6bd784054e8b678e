"""DuckDB SQL of the measurement queries, over the same tables; the checks that hold the DataFrame versions to account."""

from __future__ import annotations

from ..functions import lexicons as L

WORDS = "regexp_extract_all({0}, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')"


def words(text: str) -> str:
    return WORDS.format(text)


def sentences(text: str) -> str:
    # RE2 has no look-around: a mark goes between the terminator and what follows it
    return rf"list_filter(string_split(regexp_replace(trim(regexp_replace({text}, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9\"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')"


def listed(terms: list[str]) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else listed([x]) for x in r) + ")" for r in rows)


D = "d AS (SELECT source AS profile, doc_id, text FROM documents)"
WT = f"wt AS (SELECT profile, sum(len({words('text')})) AS words FROM d GROUP BY profile)"
TOK = f"tok AS (SELECT profile, doc_id, unnest({words('lower(text)')}) AS token FROM d)"
S0 = f"s0 AS (SELECT profile, doc_id, unnest({sentences('text')}) AS sentence FROM d)"
S = f"s AS (SELECT profile, doc_id, sentence, len({words('sentence')}) AS words FROM s0)"
OPEN = f"o AS (SELECT profile, {words('lower(sentence)')} AS w FROM s0 WHERE len({words('sentence')}) > 0)"
TOP = "SELECT profile, {1}, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY {2}) AS rank FROM {0}) WHERE rank <= {3}"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def rate(n: str, total: str = "words") -> str:
    return f"round(CASE WHEN {total} > 0 THEN CAST({n} AS DOUBLE) / {total} * 1000.0 ELSE 0.0 END, 6)"


def bins(rows: str, value: str, edges: list[tuple[int, int | None]]) -> str:
    test = lambda lo, hi: f"{value} >= {lo}" + (f" AND {value} <= {hi}" if hi is not None else "")
    wide = ", ".join(f"count(*) FILTER (WHERE {test(*e)}) AS b{i}" for i, e in enumerate(edges))
    total = " + ".join(f"b{i}" for i in range(len(edges)))
    return f"h AS (SELECT profile, {wide} FROM {rows} GROUP BY profile) " + " UNION ALL ".join(f"SELECT profile, {i} AS bin, round(CASE WHEN {total} > 0 THEN CAST(b{i} AS DOUBLE) / ({total}) ELSE 0.0 END, 6) AS p FROM h" for i in range(len(edges)))


def categories(lexicon: dict[str, list[str]]) -> str:
    terms = values([(c, t) for c, ts in lexicon.items() for t in ts])
    return with_(
        D, WT, TOK, f"lex(category, token) AS (VALUES {terms})",
        "hit AS (SELECT profile, category, count(*) AS hits FROM tok JOIN lex USING (token) GROUP BY ALL)",
        "base AS (SELECT profile, words, category FROM wt, (SELECT DISTINCT category FROM lex))",
        select=f"SELECT base.profile, base.category, CAST(coalesce(hits, 0) AS BIGINT) AS hits, {rate('coalesce(hits, 0)')} AS rate FROM base LEFT JOIN hit ON base.profile = hit.profile AND base.category = hit.category",
    )


def grams(n: int, name: str = "g") -> str:
    stops = " + ".join(f"CAST(w[i + {k}] IN ({listed(L.STOP_WORDS)}) AS INT)" for k in range(n))
    phrase = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"{name} AS (SELECT profile, {phrase} AS phrase, count(*) AS n FROM (SELECT profile, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT profile, {words('lower(text)')} AS w FROM d) WHERE len(w) >= {n}) WHERE {stops} < {n - 1} GROUP BY ALL)"


def top(rows: str, columns: str, order: str, k: int) -> str:
    return TOP.format(rows, columns, order, k)


def count_of(text: str, part: str) -> str:
    p = part.replace("'", "''")
    return f"CAST((length({text}) - length(replace({text}, '{p}', ''))) / {len(part)} AS BIGINT)"


def contains_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def repeat(n: int) -> str:
    return f"(SELECT profile, round(CAST(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS DOUBLE) / greatest(1, sum(n)), 6) AS r{n} FROM g{n} GROUP BY profile)"


PUNCT = "p AS (SELECT profile, words, mark, n FROM (SELECT d.profile, " + ", ".join(f"sum({count_of('text', m)}) AS {k}" for k, m in L.PUNCTUATION.items()) + " FROM d GROUP BY d.profile) UNPIVOT (n FOR mark IN (" + ", ".join(L.PUNCTUATION) + ")) JOIN wt USING (profile))"
ENTROPY = "SELECT profile, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM {0} WHERE n > 0 GROUP BY profile"
FW = values([(w, i) for i, w in enumerate(L.FUNCTION_WORDS)])
FWC = f"fw(word, place) AS (VALUES {FW}), c AS (SELECT profile, token, count(*) AS n FROM tok GROUP BY ALL), f AS (SELECT wt.profile, word, place, words, CAST(coalesce(n, 0) AS BIGINT) AS n FROM wt CROSS JOIN fw LEFT JOIN c ON c.profile = wt.profile AND c.token = fw.word)"
CAPS = "regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')"

MEASURES: dict[str, str] = {
    "source_profile": with_(D, S0, S, WT, "h AS (SELECT profile, count(*) AS sentences, avg(words) AS m, stddev_pop(words) AS sd, " + ", ".join(f"round(CAST(count(*) FILTER (WHERE words >= {a}{'' if b is None else f' AND words <= {b}'}) AS DOUBLE) / count(*), 6) AS h{i}" for i, (a, b) in enumerate(L.SENTENCE_BINS)) + " FROM s GROUP BY profile)", f"x AS (SELECT profile, count(*) AS documents, sum({count_of('text', ',')}) AS commas FROM d GROUP BY profile)", select="SELECT profile, documents, CAST(words AS BIGINT) AS words, sentences, round(m, 6) AS mean, round(sd, 6) AS stdev, h0, h1, h2, h3, h4, round(CAST(commas AS DOUBLE) / greatest(1, words) * 100, 6) AS comma_density FROM h JOIN x USING (profile) JOIN wt USING (profile)"),
    "doc_size_stats": with_(D, select=f"SELECT doc_id, profile, CAST(len({words('text')}) AS BIGINT) AS words, CAST(len({sentences('text')}) AS BIGINT) AS sentences, CAST(length(text) AS BIGINT) AS chars, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS tokens FROM d"),
    "source_totals": with_(D, select=f"SELECT profile, count(*) AS documents, CAST(sum(len({words('text')})) AS BIGINT) AS words, CAST(sum(len({sentences('text')})) AS BIGINT) AS sentences, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda x: trim(x) <> ''))) AS BIGINT) AS paragraphs FROM d GROUP BY profile"),
    "sentence_len_stats": with_(D, S0, S, select="SELECT profile, round(avg(words), 6) AS mean, round(stddev_pop(words), 6) AS stdev, count(*) AS n FROM s GROUP BY profile"),
    "sentence_hist": with_(D, S0, S, bins("s", "words", L.SENTENCE_BINS).split(" SELECT", 1)[0].rstrip(), select="SELECT"),  # completed below
    "one_sentence_rate": with_(D, select=f"SELECT profile, round(avg(CASE WHEN len({sentences('text')}) = 1 THEN 1 ELSE 0 END), 6) AS one_sentence_rate FROM d WHERE trim(text) <> '' GROUP BY profile"),
    "punct_rates": with_(D, WT, PUNCT, select=f"SELECT profile, mark, CAST(n AS BIGINT) AS n, {rate('n')} AS rate FROM p"),
    "comma_density": with_(D, WT, f"c AS (SELECT profile, sum({count_of('text', ',')}) AS n FROM d GROUP BY profile)", select="SELECT profile, round(CAST(n AS DOUBLE) / greatest(1, words) * 100, 6) AS comma_density FROM c JOIN wt USING (profile)"),
    "contraction_rate": with_(D, WT, "c AS (SELECT profile, sum(len(regexp_extract_all(text, '\\b\\w+(?:n''t|''re|''ve|''ll|''d|''m|''s)\\b'))) AS hits FROM d GROUP BY profile)", select="SELECT profile, CAST(hits AS BIGINT) AS hits, round(CAST(hits AS DOUBLE) / greatest(1, words), 6) AS contraction_rate FROM c JOIN wt USING (profile)"),
    "oxford_signal": with_(D, f"c AS (SELECT profile, CAST(sum({count_of('lower(text)', ' and ')}) AS BIGINT) AS ands, CAST(sum({count_of('lower(text)', ', and ')}) AS BIGINT) AS comma_ands FROM d GROUP BY profile)", select="SELECT profile, ands, comma_ands, round(CAST(comma_ands AS DOUBLE) / greatest(1, ands), 6) AS oxford_signal FROM c"),
    "spelling_variant": with_(D, TOK, f"lex(us, ca) AS (VALUES {values(L.SPELLING_PAIRS)})", "x AS (SELECT profile, count(*) FILTER (WHERE token IN (SELECT us FROM lex)) AS us_hits, count(*) FILTER (WHERE token IN (SELECT ca FROM lex)) AS canadian_hits FROM d LEFT JOIN tok USING (profile, doc_id) GROUP BY profile)", select="SELECT profile, us_hits, canadian_hits, CASE WHEN us_hits + canadian_hits < 3 THEN 'unknown' WHEN us_hits > canadian_hits THEN 'us' WHEN canadian_hits > us_hits THEN 'canadian' ELSE 'unknown' END AS variant, CASE WHEN us_hits + canadian_hits < 3 THEN 'low' WHEN us_hits + canadian_hits >= 8 AND abs(us_hits - canadian_hits) >= 4 THEN 'high' ELSE 'medium' END AS confidence FROM x"),
    "function_word_rates": with_(D, WT, TOK, FWC, select=f"SELECT profile, word, n, {rate('n')} AS rate, place FROM f"),
    "function_word_top20": with_(D, WT, TOK, FWC, select=top("f", "word", "n DESC, place", 20)),
    "stance_rates": categories(L.STANCE),
    "epistemic_rates": categories(L.EPISTEMIC),
    "avoidance_rates": categories(L.AVOIDANCE),
    "lexicon_rates_present": categories({"articles": ["the", "a", "la", "der"], "prepositions": ["of", "in", "de", "en"]}),
    "syntax_texture": with_(D, WT, f"c AS (SELECT profile, sum({count_of('text', '(')} + {count_of('text', ')')}) AS par, sum(len(regexp_extract_all(regexp_replace(lower(text), '[À-ɏ]', 'z', 'g'), ',\\s+(?:a|an|the|which|who|that)\\b'))) AS app, sum(len(list_filter({words('lower(text)')}, lambda x: x IN ({listed(L.SUBORDINATORS)})))) AS sub FROM d GROUP BY profile)", select=f"SELECT profile, {rate('sub')} AS subordinate_rate, {rate('par')} AS parenthetical_rate, {rate('app')} AS appositive_rate FROM c JOIN wt USING (profile)"),
    "rhetoric_moves": with_(D, WT, S0, "c AS (SELECT profile, " + ", ".join(f"count(*) FILTER (WHERE {contains_any('lower(sentence)', t)}) AS {m}" for m, t in L.RHETORIC.items()) + " FROM s0 GROUP BY profile)", select="SELECT profile, " + ", ".join(f"{rate(m)} AS {m}_rate" for m in L.RHETORIC) + ", round(CAST(claim AS DOUBLE) / greatest(1, evidence), 6) AS claim_evidence_ratio FROM c JOIN wt USING (profile)"),
    "transition_openers": with_(D, S0, OPEN, "t AS (SELECT profile, coalesce(" + ", ".join(f"CASE WHEN len(w) >= {n} AND array_to_string(w[1:{n}], ' ') IN ({listed(L.TRANSITIONS)}) THEN array_to_string(w[1:{n}], ' ') END" for n in (3, 2, 1)) + ") AS phrase FROM o)", "c AS (SELECT profile, phrase, count(*) AS n FROM t WHERE phrase IS NOT NULL GROUP BY ALL)", select=top("c", "phrase", "n DESC, phrase", 15)),
    "discourse_positions": with_(D, WT, S0, OPEN, f"c AS (SELECT profile, count(*) FILTER (WHERE array_to_string(w[1:3], ' ') IN ({listed(L.TRANSITIONS)})) AS st, count(*) FILTER (WHERE array_to_string(w[1:3], ' ') NOT IN ({listed(L.TRANSITIONS)}) AND {contains_any(chr(97) + 'rray_to_string(w[2:len(w)], ' + chr(39) + ' ' + chr(39) + ')', L.TRANSITIONS)}) AS mi FROM o GROUP BY profile)", select=f"SELECT profile, {rate('st')} AS start_rate, {rate('mi')} AS mid_rate FROM c JOIN wt USING (profile)"),
    "sentence_openers_top20": with_(D, S0, OPEN, f"c AS (SELECT profile, array_to_string(w[1:3], ' ') AS phrase, count(*) AS n FROM o WHERE len(w) >= 2 AND len(list_filter(w[1:3], lambda x: x IN ({listed(L.STOP_WORDS)}))) <= 1 GROUP BY ALL)", select=top("c", "phrase", "n DESC, phrase", 20)),
    "paragraph_cadence": with_(D, f"c AS (SELECT profile, len({words('s[1]')}) AS o, len({words('s[len(s)]')}) AS c FROM (SELECT profile, {sentences('text')} AS s FROM d) WHERE len(s) > 0)", select="SELECT profile, round(avg(o), 6) AS opening_mean, round(stddev_pop(o), 6) AS opening_stdev, round(avg(c), 6) AS closing_mean, round(stddev_pop(c), 6) AS closing_stdev FROM c GROUP BY profile"),
    "bigrams_top30": with_(D, grams(2), select=top("g", "phrase", "n DESC, phrase", 30)),
    "trigrams_top30": with_(D, grams(3), select=top("g", "phrase", "n DESC, phrase", 30)),
    "repetition_rates": with_(D, grams(2, "g2"), grams(3, "g3"), select=f"SELECT p.profile, coalesce(r2, 0.0) AS bigram_repeat_rate, coalesce(r3, 0.0) AS trigram_repeat_rate FROM (SELECT DISTINCT profile FROM d) p LEFT JOIN {repeat(2)} a ON p.profile = a.profile LEFT JOIN {repeat(3)} b ON p.profile = b.profile"),
    "lexical_diversity": with_(D, TOK, "c AS (SELECT profile, token, count(*) AS n FROM tok GROUP BY ALL)", "x AS (SELECT profile, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, CAST(sum(n) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS v, CAST(sum(n * n) AS DOUBLE) AS m2, sum(n * length(token)) AS ch FROM c GROUP BY profile)", select="SELECT profile, tokens, types, round(v / t, 6) AS ttr, round(CASE WHEN t > 1 THEN ln(v) / ln(t) ELSE 0.0 END, 6) AS herdan_c, round(CASE WHEN t > 1 THEN v / sqrt(t) ELSE 0.0 END, 6) AS guiraud_r, round(CASE WHEN t > 1 THEN (ln(t) - ln(v)) / (ln(t) * ln(t)) ELSE 0.0 END, 6) AS maas, round(10000.0 * (m2 - t) / (t * t), 6) AS yule_k, round(CASE WHEN t > 1 THEN (m2 - t) / (t * (t - 1)) ELSE 0.0 END, 6) AS simpson_d, round(ch / t, 6) AS word_length FROM x"),
    "burstiness": with_(D, S0, S, "a AS (SELECT profile, round(stddev_pop(words) / avg(words), 6) AS sentence_burstiness FROM s WHERE words > 0 GROUP BY profile)", f"b AS (SELECT profile, round(CASE WHEN avg(n) > 0 THEN stddev_pop(n) / avg(n) ELSE 0.0 END, 6) AS paragraph_burstiness FROM (SELECT profile, len({sentences('text')}) AS n FROM d WHERE trim(text) <> '') GROUP BY profile)", select="SELECT profile, coalesce(sentence_burstiness, 0.0) AS sentence_burstiness, coalesce(paragraph_burstiness, 0.0) AS paragraph_burstiness FROM a FULL JOIN b USING (profile)"),
    "punct_entropy": with_(D, WT, PUNCT, select=ENTROPY.format("p")),
    "function_word_entropy": with_(D, WT, TOK, FWC, select=ENTROPY.format("f")),
    "char_trigram_entropy": with_(D, "l AS (SELECT profile, regexp_replace(lower(text), '[^a-zA-Z]+', '', 'g') AS s FROM d)", "c AS (SELECT profile, substr(s, i, 3) AS phrase, count(*) AS n FROM (SELECT profile, s, unnest(range(1, length(s) - 1)) AS i FROM l WHERE length(s) >= 3) GROUP BY ALL)", select=ENTROPY.format("c")),
    "cap_ratio": with_(D, f"t AS (SELECT profile, unnest({CAPS}) AS t FROM d)", select="SELECT profile, lower(t) AS token, count(*) AS n, round(CAST(count(*) FILTER (WHERE regexp_matches(substr(t, 1, 1), '[A-Z]')) AS DOUBLE) / count(*), 6) AS cap_ratio FROM t GROUP BY profile, lower(t)"),
    "absent_common_words": with_(D, TOK, f"cw(place, token) AS (VALUES {values(list(enumerate(w for w in L.COMMON_WORDS if len(w) >= 3 and w not in L.STOP_WORDS)))})", select="SELECT p.profile, cw.token, cw.place FROM (SELECT DISTINCT profile FROM d) p CROSS JOIN cw WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.profile = p.profile AND tok.token = cw.token)"),
    "emdash_quote_normalised": with_(D, select="SELECT doc_id, md5(translate(regexp_replace(text, '\\s*—\\s*', ' - ', 'g'), '“”„‟«»‘’‚‛‹›', '\"\"\"\"\"\"''''''''''''')) AS text_md5 FROM d"),
}
_h = bins("s", "words", L.SENTENCE_BINS)
MEASURES["sentence_hist"] = "WITH " + D + ",\n" + S0 + ",\n" + S + ",\n" + _h
MEASURES["paragraph_hist"] = "WITH " + D + f",\np AS (SELECT profile, len({sentences('text')}) AS n FROM d WHERE trim(text) <> ''),\n" + bins("p", "n", L.PARAGRAPH_BINS)

FUNCTION_SHARE = "b AS (SELECT profile, word, n / nullif(sum(n) OVER (PARTITION BY profile), 0) AS p FROM f)"
_RARE_OK = f"token NOT IN ({listed(L.STOP_WORDS)}) AND regexp_matches(token, '^[a-z]{{4,}}$') AND NOT regexp_matches(token, '^[ivxlcdm]+$') AND NOT (length(token) >= 8 AND len(list_filter(range(3, length(token) // 2 + 1), lambda k: length(token) % k = 0 AND repeat(substr(token, 1, CAST(k AS INT)), CAST(length(token) // k AS INT)) = token)) > 0) AND NOT (length(token) >= 12 AND regexp_matches(token, '^[^aeiouy]{{5}}'))"
MEASURES |= {
    "page_titles": r"WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages) SELECT page_id, coalesce(nullif(trim(regexp_replace(t, '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '')) AS title FROM p",
    "stripped_pages": r"WITH a AS (SELECT page_id, regexp_replace(html, '``[^`\n]+``|`[^`\n]+`', '', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)\\\[.*?\\\]', chr(10), 'g'), '(?s)\\\(.*?\\\)', '', 'g'), '(?s)\$\$.*?\$\$', chr(10), 'g'), '\$[^$]*\$', '', 'g'), '\\[A-Za-z]+(?:\{[^}]*\})?', '', 'g') AS t FROM a), c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<[A-Za-z][^>]*>.*?</[A-Za-z][^>]*>', chr(10), 'g'), '(?is)<!--.*?-->', '', 'g'), '<[A-Za-z/][^>]*>', '', 'g'), '&[A-Za-z0-9#]+;', '', 'g') AS t FROM b) SELECT page_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS text_md5 FROM c",
    "near_duplicate_docs": r"WITH k AS (SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '``[^`\n]+``|`[^`\n]+`', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS key FROM documents), g AS (SELECT key, min(doc_id) AS first_doc, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1) SELECT doc_id, first_doc, n FROM k JOIN g USING (key)",
    "conversation_role_profiles": MEASURES["source_totals"].replace("source AS profile, doc_id, text FROM documents", "role AS profile, conv_id AS doc_id, text FROM conversations").replace("SELECT profile, count(*)", "SELECT * FROM (SELECT profile, count(*)") + ") JOIN (" + MEASURES["comma_density"].replace("source AS profile, doc_id, text FROM documents", "role AS profile, conv_id AS doc_id, text FROM conversations") + ") USING (profile) JOIN (SELECT profile, mean, stdev FROM (" + MEASURES["sentence_len_stats"].replace("source AS profile, doc_id, text FROM documents", "role AS profile, conv_id AS doc_id, text FROM conversations") + ")) USING (profile)",
    "kl_function_words": with_(D, WT, TOK, FWC, "r AS (SELECT profile, word, n * 1000.0 / words + 1e-9 AS p FROM f)", "q0 AS (SELECT word, sum(n) * 1000.0 / (SELECT sum(words) FROM wt) + 1e-9 AS q FROM f GROUP BY word)", "x AS (SELECT profile, p / sum(p) OVER (PARTITION BY profile) AS p, q / sum(q) OVER (PARTITION BY profile) AS q FROM r JOIN q0 USING (word))", select="SELECT profile, round(sum(p * log2(p / q)), 6) AS kl FROM x GROUP BY profile"),
    "extractive_summary": with_(D, f"s AS (SELECT doc_id, unnest(range(0, len(s))) AS sent_no, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM d))", f"t AS (SELECT doc_id, sent_no, unnest({words('lower(sentence)')}) AS token FROM s)", f"c AS (SELECT doc_id, sent_no, token, count(*) AS n FROM t WHERE token NOT IN ({listed(L.STOP_WORDS)}) AND length(token) > 2 GROUP BY ALL)", "f AS (SELECT doc_id, token, sum(n) AS f FROM c GROUP BY ALL)", "x AS (SELECT doc_id, sent_no, sum(n * f) AS score FROM c JOIN f USING (doc_id, token) GROUP BY ALL)", select="SELECT doc_id, CAST(sent_no AS INT) AS sent_no, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_no) AS rank FROM x) WHERE rank <= 2"),
    "sampled_sentences": with_(D, f"s AS (SELECT doc_id, len(s) AS n, unnest(range(0, len(s))) AS sent_no, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM d))", select="SELECT doc_id, CAST(sent_no AS INT) AS sent_no, sentence FROM s WHERE sent_no % greatest(1, n // 24) = 0"),
    "rare_words": with_(D, WT, f"t AS (SELECT profile, unnest({words('text')}) AS t FROM d)", "c AS (SELECT profile, lower(t) AS token, count(*) AS n, count(*) FILTER (WHERE regexp_matches(substr(t, 1, 1), '[A-Z]')) AS caps FROM t GROUP BY ALL)", f"x AS (SELECT profile, words, token, n, CAST(caps AS DOUBLE) / n AS cap, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h FROM c JOIN wt USING (profile) WHERE n <= least(5, greatest(2, floor(words * 0.0001))) AND {_RARE_OK})", "y AS (SELECT *, row_number() OVER (PARTITION BY profile, substr(token, 1, 1) ORDER BY n, cap, h, token) AS rd FROM x)", "z AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY rd, substr(token, 1, 1)) AS k FROM y)", select=f"SELECT profile, token, n, {rate('n')} AS rate, row_number() OVER (PARTITION BY profile ORDER BY cap, n, h, token) AS rank FROM z WHERE k <= 40"),
    "fiction_flags": with_(D, WT, f"q AS (SELECT profile, doc_id, list_filter(list_transform(regexp_extract_all(text, '\"[^\"]+\"|“[^”]+”'), lambda x: substr(x, 2, length(x) - 2)), lambda x: len({words('x')}) >= 2) AS q, substr(trim(text), 1, 1) IN ('\"', '“') AS opens, trim(text) <> '' AS there FROM d)", f"c AS (SELECT profile, CAST(sum(len(q)) AS BIGINT) AS spans, CAST(sum(list_sum(list_transform(q, lambda x: len({words('x')})))) AS BIGINT) AS quoted, count(*) FILTER (WHERE there) AS paras, count(*) FILTER (WHERE opens) AS op FROM q GROUP BY profile)", "r AS (SELECT profile, coalesce(spans, 0) AS spans, coalesce(quoted, 0) AS quoted, CAST(coalesce(quoted, 0) AS DOUBLE) / greatest(1, words) AS qr, CAST(op AS DOUBLE) / greatest(1, paras) AS pr FROM c JOIN wt USING (profile))", select="SELECT profile, spans, quoted, round(qr, 6) AS quoted_ratio, round(pr, 6) AS quote_para_ratio, (spans >= 6 AND qr >= 0.03) OR (pr >= 0.2 AND qr >= 0.03) OR qr >= 0.08 AS fiction FROM r"),
}
_PLAIN = "regexp_replace(lower(text), '[À-ɏ]', 'z', 'g')"  # so that an accented letter is no word boundary
MEASURES["excerpts"] = with_(
    D,
    f"p AS (SELECT profile, doc_id, trim(text) AS text, len({words('text')}) AS n, length(trim(text)) AS size FROM d WHERE length(trim(text)) >= 200)",
    "s AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE (CASE WHEN n < 60 THEN 0.3 WHEN n > 280 THEN 0.6 ELSE 1.0 END) * (CASE WHEN regexp_matches(text, '^\\s*[-*+]\\s+') OR regexp_matches(text, '^\\s*\\d+\\.\\s+') THEN 0.5 ELSE 1.0 END) * (CASE WHEN CAST(len(regexp_extract_all(text, '\\p{Lu}')) AS DOUBLE) / size > 0.2 THEN 0.7 ELSE 1.0 END) * (CASE WHEN CAST(len(regexp_extract_all(text, '\\p{Nd}')) AS DOUBLE) / size > 0.08 THEN 0.7 ELSE 1.0 END) * (CASE WHEN regexp_matches(" + _PLAIN + ", '\\b(?:ibid|supra|infra|cf|op\\.|cit|pp?)\\b') THEN 0.4 ELSE 1.0 END) * (CASE WHEN regexp_matches(text, '\\[[0-9,\\s]+\\]') THEN 0.5 ELSE 1.0 END) END AS score FROM p)",
    "r AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(size) OVER (PARTITION BY profile ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WINDOW w AS (PARTITION BY profile ORDER BY score DESC, doc_id))",
    select="SELECT profile, rank, doc_id, 0 AS para_no, round(CAST(score AS DOUBLE), 6) AS score, substr(text, 1, CAST(6000 - before AS INT)) AS excerpt FROM r WHERE before < 6000",
)
_MARKS = {"commas": ",", "semicolons": ";", "colons": ":", "exclamations": "!", "questions": "?", "open": "(", "close": ")", "double": '"', "single": "'", "em_dashes": "—"}


def _spread(v: str) -> tuple[str, str]:
    """Mean and population deviation of a list; 0 if it is empty."""
    return f"coalesce(list_avg({v}), 0.0)", f"coalesce(list_stddev_pop({v}), 0.0)"


def _again(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"CASE WHEN len(w) >= {n} THEN 1.0 - CAST(len(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}))) AS DOUBLE) / (len(w) - {n - 1}) ELSE 0.0 END"


_SM, _SD = _spread("sl")
_PM, _PD = _spread("pl")
WINDOW_METRICS = {
    "token_count": "CAST(len(w) AS DOUBLE)", "type_token_ratio": "CAST(len(list_distinct(w)) AS DOUBLE) / len(w)", "avg_word_length": "CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w)",
    "sentence_length_mean": _SM, "sentence_length_stdev": _SD, "sentence_burstiness": f"CASE WHEN {_SM} > 0 THEN {_SD} / {_SM} ELSE 0.0 END",
    "paragraph_length_mean": _PM, "paragraph_length_stdev": _PD, "paragraph_burstiness": f"CASE WHEN {_PM} > 0 THEN {_PD} / {_PM} ELSE 0.0 END",
    "one_sentence_paragraph_rate": "CAST(len(list_filter(pl, lambda x: x = 1)) AS DOUBLE) / greatest(1, len(pl))", "bigram_repeat_rate": _again(2), "trigram_repeat_rate": _again(3),
    "punctuation_variety": "CAST(len(list_filter(m, lambda x: x > 0)) AS DOUBLE)",
    "punctuation_entropy": "coalesce(-list_sum(list_transform(list_filter(m, lambda x: x > 0), lambda x: x / list_sum(m) * log2(x / list_sum(m)))), 0.0)",
    **{f"punctuation_{k}_per_1000w": f"m[{i}] * 1000.0 / len(w)" for i, k in enumerate(_MARKS, 1) if k in ("commas", "semicolons", "colons", "exclamations", "questions", "em_dashes")},
    "comma_density_per_100w": "m[1] * 100.0 / len(w)",
}
_WINDOWS = ",\n".join([
    D, f"c AS (SELECT profile, doc_id, trim(text) AS text, len({words('text')}) AS n FROM d)",
    "o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY doc_id) AS i, sum(n) OVER (PARTITION BY profile ORDER BY doc_id) AS upto FROM c WHERE n > 0)",
    "e AS (SELECT a.profile, a.i, min(b.i) FILTER (WHERE b.upto - a.upto + a.n >= 400) + 1 AS next, coalesce(min(b.i) FILTER (WHERE b.upto - a.upto + a.n >= 800), max(b.i)) AS last, max(b.upto) FILTER (WHERE b.i <= 1000000) - a.upto + a.n AS rest FROM o a JOIN o b ON a.profile = b.profile AND b.i >= a.i GROUP BY a.profile, a.i, a.upto, a.n)",
    "st AS (SELECT profile, i, last, 0 AS window_no FROM e WHERE i = 1 AND rest >= 250 UNION ALL SELECT e.profile, e.i, e.last, st.window_no + 1 FROM st JOIN e p ON p.profile = st.profile AND p.i = st.i JOIN e ON e.profile = st.profile AND e.i = p.next WHERE e.rest >= 250 AND st.window_no < 199)",
    "t AS (SELECT st.profile, window_no, string_agg(o.text, chr(10) || chr(10) ORDER BY o.i) AS text, list(o.text ORDER BY o.i) AS paras FROM st JOIN o ON o.profile = st.profile AND o.i BETWEEN st.i AND st.last GROUP BY st.profile, window_no)",
    f"x AS (SELECT profile, window_no, {words('lower(text)')} AS w, list_transform({sentences('text')}, lambda s: len({words('s')})) AS sl, list_transform(paras, lambda q: len({sentences('q')})) AS pl, [{', '.join(f'CAST({count_of("text", m)} AS DOUBLE)' for m in _MARKS.values())}] AS m FROM t)",
    "l AS (SELECT profile, window_no, regexp_replace(lower(text), '[^a-zA-Z]+', '', 'g') AS s FROM t)",
    "g AS (SELECT profile, window_no, substr(s, i, 3) AS q, count(*) AS n FROM (SELECT profile, window_no, s, unnest(range(1, length(s) - 1)) AS i FROM l WHERE length(s) >= 3) GROUP BY ALL)",
    "h AS (SELECT profile, window_no, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS char_trigram_entropy FROM g GROUP BY ALL)",
    "metrics AS (SELECT x.profile, x.window_no, " + ", ".join(f"{e} AS {k}" for k, e in WINDOW_METRICS.items()) + ", coalesce(char_trigram_entropy, 0.0) AS char_trigram_entropy FROM x LEFT JOIN h ON h.profile = x.profile AND h.window_no = x.window_no)",
])
_ALL = [*WINDOW_METRICS, "char_trigram_entropy"]
MEASURES["baseline_windows"] = f"WITH RECURSIVE {_WINDOWS}\nSELECT profile, window_no, " + ", ".join(f"round({k}, 6) AS {k}" for k in _ALL) + " FROM metrics"
MEASURES["baseline_quantiles"] = (
    f"WITH RECURSIVE {_WINDOWS},\nlong AS (" + " UNION ALL ".join(f"SELECT profile, '{k}' AS metric, {k} AS value FROM metrics" for k in _ALL) + ")\n"
    "SELECT profile, metric, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev, "
    + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", count(*) AS n FROM long GROUP BY profile, metric"
)


def _vectors(name: str, key: str) -> str:
    """CTEs name_v(key, words, section lists...): the measurement vectors of the groups of documents with equal keys."""
    among = lambda terms: f"len(list_filter(w, lambda x: x IN ({listed(terms)})))"
    inside = lambda v, b: f"len(list_filter({v}, lambda x: x >= {b[0]}" + (f" AND x <= {b[1]}" if b[1] is not None else "") + "))"
    start = "array_to_string(x[1:3], ' ')"
    rest = "array_to_string(x[2:len(x)], ' ')"
    named = {
        "words": "len(w)", "sn": "len(sl)", "pn": "CAST(there AS INT)", "one": "CAST(there AND len(s) = 1 AS INT)",
        "con": "len(regexp_extract_all(text, '\\b\\w+(?:n''t|''re|''ve|''ll|''d|''m|''s)\\b'))", "ands": count_of("low", " and "), "cands": count_of("low", ", and "),
        "app": "len(regexp_extract_all(regexp_replace(low, '[À-ɏ]', 'z', 'g'), ',\\s+(?:a|an|the|which|who|that)\\b'))", "sub": among(L.SUBORDINATORS),
        "starts": f"len(list_filter(sw, lambda x: len(x) > 0 AND {start} IN ({listed(L.TRANSITIONS)})))", "mids": f"len(list_filter(sw, lambda x: len(x) > 0 AND {start} NOT IN ({listed(L.TRANSITIONS)}) AND {contains_any(rest, L.TRANSITIONS)}))",
        "op": "CAST(len(sl) > 0 AS INT)", "o1": "coalesce(sl[1], 0)", "o2": "coalesce(sl[1] * sl[1], 0)", "c1": "coalesce(sl[len(sl)], 0)", "c2": "coalesce(sl[len(sl)] * sl[len(sl)], 0)",
    }
    named |= {f"sh{i}": inside("sl", b) for i, b in enumerate(L.SENTENCE_BINS)}
    named |= {f"ph{i}": f"CAST(there AND len(s) >= {a}" + (f" AND len(s) <= {b}" if b is not None else "") + " AS INT)" for i, (a, b) in enumerate(L.PARAGRAPH_BINS)}
    named |= {f"pu_{k}": count_of("text", m) for k, m in L.PUNCTUATION.items()}
    for p, lexicon in (("st", L.STANCE), ("ep", L.EPISTEMIC), ("av", L.AVOIDANCE)):
        named |= {f"{p}_{k}": among(t) for k, t in lexicon.items()}
    named |= {f"rh_{k}": f"len(list_filter(s, lambda x: {contains_any('lower(x)', t)}))" for k, t in L.RHETORIC.items()}
    per = lambda c: f"CASE WHEN words > 0 THEN CAST({c} AS DOUBLE) / words * 1000.0 ELSE 0.0 END"
    over = lambda a, b: f"CAST({a} AS DOUBLE) / greatest(1, {b})"
    lists = lambda xs: "[" + ", ".join(xs) + "]"
    share = lambda p: lists([f"CASE WHEN {p}0 + {p}1 + {p}2 + {p}3 + {p}4 > 0 THEN CAST({p}{i} AS DOUBLE) / ({p}0 + {p}1 + {p}2 + {p}3 + {p}4) ELSE 0.0 END" for i in range(5)])
    sd = lambda a, b: f"CASE WHEN op > 0 THEN sqrt(greatest(0.0, CAST(op * {b} - {a} * {a} AS DOUBLE) / (op * op))) ELSE 0.0 END"
    repeat = lambda n: f"(SELECT k, CAST(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS DOUBLE) / greatest(1, sum(n)) AS r FROM {name}_g{n} GROUP BY k)"
    gram = lambda n: grams(n, f"{name}_g{n}").replace("SELECT profile", "SELECT k").replace("(SELECT profile, w", "(SELECT k, w").replace("FROM d)", f"FROM {name}_b)")
    sections = {
        "sentence": share("sh"), "paragraph": share("ph"), "one_sentence": lists([over("one", "pn")]), "punctuation": lists([per(f"pu_{k}") for k in L.PUNCTUATION]),
        "orthography": lists([over("con", "words"), over("cands", "ands")]), "stance": lists([per(f"st_{k}") for k in L.STANCE]),
        "rhetoric_moves": lists([per(f"rh_{k}") for k in L.RHETORIC] + [over("rh_claim", "rh_evidence")]), "epistemic_profile": lists([per(f"ep_{k}") for k in L.EPISTEMIC]),
        "paragraph_cadence": lists(["CASE WHEN op > 0 THEN CAST(o1 AS DOUBLE) / op ELSE 0.0 END", sd("o1", "o2"), "CASE WHEN op > 0 THEN CAST(c1 AS DOUBLE) / op ELSE 0.0 END", sd("c1", "c2")]),
        "syntax_texture": lists([per("sub"), per("pu_parentheses_open + pu_parentheses_close"), per("app")]), "lexical_avoidance": lists([per(f"av_{k}") for k in L.AVOIDANCE]),
        "discourse_markers": lists([per("starts"), per("mids")]), "repetition": "[round(coalesce(r2, 0.0), 6), round(coalesce(r3, 0.0), 6)]",
    }
    return ",\n".join([
        f"{name}_b AS (SELECT {key} AS k, text, lower(text) AS low, {words('lower(text)')} AS w, {sentences('text')} AS s, trim(text) <> '' AS there FROM d)",
        f"{name}_c AS (SELECT *, list_transform(s, lambda x: len({words('x')})) AS sl, list_transform(s, lambda x: {words('lower(x)')}) AS sw FROM {name}_b)",
        f"{name}_n AS (SELECT k, " + ", ".join(f"sum({e}) AS {c}" for c, e in named.items()) + f" FROM {name}_c GROUP BY k)",
        *[gram(n).replace("SELECT k, w, unnest", "SELECT k, w, unnest").replace(f"FROM (SELECT profile, {words('lower(text)')} AS w", "FROM (SELECT k, w") for n in (2, 3)],
        f"{name}_v AS (SELECT n.k, words, " + ", ".join(f"{e} AS {s}" for s, e in sections.items()) + f" FROM {name}_n n LEFT JOIN (SELECT k, r AS r2 FROM {repeat(2)}) a ON a.k = n.k LEFT JOIN (SELECT k, r AS r3 FROM {repeat(3)}) b ON b.k = n.k)",
    ])


_zip = lambda a, b, f: f"list_transform(range(1, len({a}) + 1), lambda i: {f.format(f'{a}[i]', f'{b}[i]')})"
_close = lambda d: f"greatest(0.0, 1.0 - least(1.0, {d}))"
_off = lambda s: _zip(f"o.{s}", f"t.{s}", "abs({0} - {1}) / greatest(abs({1}), 1.0)")
_half = lambda s: f"(list_sum({_zip(f'o.{s}', f't.{s}', 'abs({0} - {1})')}) / 2.0)"
_RATES = ("punctuation", "stance", "rhetoric_moves", "epistemic_profile", "paragraph_cadence", "syntax_texture", "lexical_avoidance", "discourse_markers", "repetition")
_ONE = "abs(o.one_sentence[1] - t.one_sentence[1])"
_PARTS = [_close(_half("sentence")), f"({_close(_half('paragraph'))} + {_close(_ONE)}) / 2", f"list_avg(list_transform({_off('orthography')}, lambda x: {_close('x')}))", *[_close(f"list_avg({_off(s)})") for s in _RATES]]
_LIMIT = {"punctuation": 0.5, "orthography": 0.5}
_DELTAS = " + ".join([f"CAST({_half(s)} > 0.15 AS INT)" for s in ("sentence", "paragraph")] + [f"CAST({_ONE} > 0.1 AS INT)"] + [f"len(list_filter({_off(s)}, lambda x: x > {_LIMIT.get(s, 0.6)}))" for s in (*_RATES, "orthography")])
_SCORED = f"WITH {D},\n{_vectors('o', 'doc_id')},\n{_vectors('t', 'profile')},\nz AS (SELECT o.k AS doc_id, t.k AS profile, o.words, ({' + '.join(_PARTS)}) / {len(_PARTS)} AS score, {_DELTAS} AS deltas FROM o_v o JOIN d ON d.doc_id = o.k JOIN t_v t ON t.k = d.profile)\n"
MEASURES["compliance_doc_vs_source"] = _SCORED + "SELECT doc_id, profile, round(score, 6) AS score, CAST(deltas AS INT) AS deltas FROM z"
_P = "0.5 + (1.0 - exp(-words / 250)) * (1.0 / (1.0 + exp(-(score - 0.59) / 0.12)) - 0.5)"
MEASURES["match_probability"] = _SCORED + f"SELECT CAST(doc_id AS VARCHAR) AS id, profile, CAST(words AS BIGINT) AS words, round(score, 6) AS score, round({_P}, 6) AS probability, round(greatest(0.0, {_P} - exp(-words / 250) * 0.5), 6) AS low, round(least(1.0, {_P} + exp(-words / 250) * 0.5), 6) AS high FROM z"


def _jsd(s: str) -> str:
    pos = lambda v: f"CASE WHEN list_sum({v}) > 0 THEN list_transform({v}, lambda x: x / list_sum({v})) ELSE list_transform({v}, lambda x: 1.0 / len({v})) END"
    one = "CASE WHEN {0} > 0 THEN {0} * log2(({0} + 1e-12) / (({0} + {1}) / 2 + 1e-12)) ELSE 0.0 END"
    a, b = f"({pos(f'a.{s}')})", f"({pos(f'b.{s}')})"
    return f"greatest(0.0, 1.0 - least(1.0, greatest(0.0, list_sum({_zip(a, b, f'0.5 * ({one} + {one.format(chr(123) + "1" + chr(125), chr(123) + "0" + chr(125))})')}))))"


_alike = lambda s: f"list_avg({_zip(f'a.{s}', f'b.{s}', '1.0 / (1.0 + abs({0} - {1}) / greatest((abs({0}) + abs({1})) / 2.0, 1e-9))')})"
_SIM = {
    "function_words_distribution": _jsd("fw"), "sentence_histogram": _jsd("sentence"), "paragraph_histogram": _jsd("paragraph"), "punctuation_rates": _alike("punctuation"),
    "stance_signals": _alike("stance"), "rhetoric_moves": _alike("rhetoric_moves"), "syntax_texture": _alike("syntax_texture"), "paragraph_cadence": _alike("paragraph_cadence"),
    "repetition": _alike("repetition"), "lexicon_preferred_overlap": "CAST(1.0 AS DOUBLE)", "lexicon_avoid_overlap": "CAST(1.0 AS DOUBLE)",
}
_PAIRS = f"WITH {D},\n{WT},\n{TOK},\n{FWC},\n{_vectors('t', 'profile')},\nfl AS (SELECT profile, list(n * 1000.0 / words ORDER BY place) AS fw FROM f GROUP BY profile),\nv AS (SELECT t_v.*, fw FROM t_v JOIN fl ON fl.profile = t_v.k),\ns AS (SELECT a.k AS a, b.k AS b, least(a.words, b.words) AS least_words, " + ", ".join(f"{e} AS {k}" for k, e in _SIM.items()) + " FROM v a JOIN v b ON a.k < b.k),\nq AS (SELECT *, " + " + ".join(f"least(1.0, {k}) * {w}" for k, w in L.SIMILARITY_WEIGHTS.items()) + f" AS total, least(1.0, 0.6 + 0.4 * (1.0 - exp(-least_words / 20000.0))) AS sure FROM s)\n"
_TOTAL = f"round(total / {sum(L.SIMILARITY_WEIGHTS.values())!r}, 6) AS similarity, round(sure, 6) AS confidence"
MEASURES["profile_similarity_pairs"] = _PAIRS + f"SELECT a, b, {_TOTAL} FROM q"
MEASURES["similarity_components"] = _PAIRS + "SELECT a, b, " + ", ".join(f"round({k}, 6) AS {k}" for k in _SIM) + f", {_TOTAL} FROM q"
MEASURES["worst_components"] = _PAIRS + "SELECT a, b, CAST(rank - 1 AS INT) AS rank, component, value FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY value, component) AS rank FROM (" + " UNION ALL ".join(f"SELECT a, b, '{k}' AS component, round({k}, 6) AS value FROM q" for k in _SIM) + ")) WHERE rank <= 5"

# texts of several paragraphs, put together from documents of one: what is measured by paragraph is the same
MEASURES |= {f"grouped_{k}": MEASURES[k] for k in ("paragraph_hist", "one_sentence_rate", "paragraph_cadence", "baseline_windows")}
OPENERS = ["the", "and", "in", "to", "i", "el", "la", "de", "der", "le"]
MEASURES["word_openers"] = MEASURES["transition_openers"].replace(listed(L.TRANSITIONS), listed(OPENERS))


def _share(v: str, whole: float) -> str:
    return f"CASE WHEN {v} > 0 THEN least(1.0, {v} / CAST({whole} AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END"


def _less(v: str, whole: float, zero: float = 0.0) -> str:
    return f"CASE WHEN {v} > 0 THEN greatest(0.0, 1.0 - least(1.0, {v} / CAST({whole} AS DOUBLE))) ELSE CAST({zero} AS DOUBLE) END"


def _count(a: int, b: int | None) -> str:
    return f"count(*) FILTER (WHERE words >= {a}" + (")" if b is None else f" AND words <= {b})")


_BIN = [f"b{i}" for i in range(len(L.SENTENCE_BINS))]
_JS = (
    "hb AS (SELECT profile, " + ", ".join(f"{_count(*b)} AS {k}" for k, b in zip(_BIN, L.SENTENCE_BINS, strict=True)) + " FROM s GROUP BY profile), "
    + "hw AS (SELECT " + ", ".join(f"sum({k}) AS {k}" for k in _BIN) + " FROM hb), "
    + f"hs AS (SELECT profile, [{', '.join(f'hb.{k} / nullif(' + ' + '.join('hb.' + j for j in _BIN) + ', 0)' for k in _BIN)}] AS x, [{', '.join(f'hw.{k} / nullif(' + ' + '.join('hw.' + j for j in _BIN) + ', 0)' for k in _BIN)}] AS y FROM hb, hw), "
    + "js AS (SELECT profile, round(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] * log2((p[1] + 1e-12) / ((p[1] + p[2]) / 2 + 1e-12)) + p[2] * log2((p[2] + 1e-12) / ((p[1] + p[2]) / 2 + 1e-12))) / 2)), 6) AS js FROM hs)"
)
_SCORES = {
    "lexical_diversity": _share("ttr", 0.5), "herdan_c": _share("herdan_c", 0.9), "guiraud_r": _share("guiraud_r", 15.0), "maas_inverse": _less("maas", 0.15), "yule_k_inverse": _less("yule_k", 100.0),
    "simpson_d_inverse": _less("simpson_d", 0.2), "repetition_inverse": _less("((bigram_repeat_rate + trigram_repeat_rate) / 2)", 0.2, 1.0), "sentence_burstiness": _share("sentence_burstiness", 1.0),
    "paragraph_burstiness": _share("paragraph_burstiness", 1.0), "punctuation_variety": _share("variety", 8.0), "punctuation_entropy": _share("pe", 3.0), "function_word_entropy": _share("fe", 4.0),
    "function_word_kl_inverse": _less("kl", 0.5, 1.0), "sentence_length_js_inverse": _less("js", 0.3, 1.0), "char_trigram_entropy": _share("te", 6.0),
    "word_length": "CASE WHEN word_length > 0 THEN greatest(0.0, 1.0 - abs(word_length - 5.0) / CAST(3.0 AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END",
}
MEASURES["naturalness"] = (
    "WITH " + ",\n".join([D, S0, S, _JS, *(f"{n} AS ({MEASURES[q]})" for n, q in (("ld", "lexical_diversity"), ("bu", "burstiness"), ("re", "repetition_rates"), ("pr", "punct_rates"), ("kw", "kl_function_words")))])
    + f",\npv AS (SELECT profile, CAST(count(*) FILTER (WHERE n > 0) AS DOUBLE) AS variety FROM pr GROUP BY profile),\n"
    + ",\n".join(f"{n} AS (SELECT profile, entropy AS {n} FROM ({MEASURES[q]}))" for n, q in (("pe", "punct_entropy"), ("fe", "function_word_entropy"), ("te", "char_trigram_entropy")))
    + ",\nx AS (SELECT ld.*, coalesce(sentence_burstiness, 0.0) AS sentence_burstiness, coalesce(paragraph_burstiness, 0.0) AS paragraph_burstiness, bigram_repeat_rate, trigram_repeat_rate, variety, coalesce(pe, 0.0) AS pe, coalesce(fe, 0.0) AS fe, coalesce(te, 0.0) AS te, kl, js"
    + " FROM ld LEFT JOIN bu USING (profile) LEFT JOIN re USING (profile) LEFT JOIN pv USING (profile) LEFT JOIN pe USING (profile) LEFT JOIN fe USING (profile) LEFT JOIN te USING (profile) JOIN kw USING (profile) JOIN js USING (profile)),\n"
    + "z AS (SELECT profile, " + ", ".join(f"{e} AS score_{k}" for k, e in _SCORES.items()) + " FROM x)\n"
    + "SELECT profile, " + ", ".join(f"round(score_{k}, 6) AS score_{k}" for k in _SCORES) + f", round(({' + '.join('score_' + k for k in _SCORES)}) / CAST({len(_SCORES)} AS DOUBLE) * 100.0, 4) AS aggregate_100 FROM z"
)
MEASURES["cosine_function_words"] = with_(
    D, WT, TOK, FWC, S0, S, _JS, "r AS (SELECT profile, word, n * 1000.0 / words AS p FROM f)", "q AS (SELECT word, sum(n) * 1000.0 / (SELECT sum(words) FROM wt) AS q FROM f GROUP BY word)",
    "co AS (SELECT profile, round(least(1.0, greatest(0.0, sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))))), 6) AS cosine FROM r JOIN q USING (word) GROUP BY profile)",
    select="SELECT profile, coalesce(cosine, 0.0) AS cosine, js AS sentence_js FROM co JOIN js USING (profile)",
)
_TOP_ALL = "SELECT word FROM (SELECT word, sum(n) AS n, min(place) AS place FROM f GROUP BY word) ORDER BY n DESC, place LIMIT 20"
MEASURES["function_word_overlap"] = with_(
    D, WT, TOK, FWC, f"a AS ({top('f', 'word', 'n DESC, place', 20)})", f"b AS ({_TOP_ALL})",
    select="SELECT profile, round(CAST(count(*) FILTER (WHERE word IN (SELECT word FROM b)) AS DOUBLE) / (count(*) + 20 - count(*) FILTER (WHERE word IN (SELECT word FROM b))), 6) AS overlap FROM a GROUP BY profile",
)
_SIZES = lambda t, p: f"len(string_split({t}, chr(10))) AS {p}lines, len({words(t)}) AS {p}words, len(list_filter(regexp_split_to_array({t}, '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS {p}paragraphs"
_PCT = lambda k: f"(b_{k} - a_{k}) / CAST(greatest(1, a_{k}) AS DOUBLE) * 100.0"
_WARN = ", ".join(f"CASE WHEN abs({_PCT(k)}) >= 10.0 THEN '{k}' END" for k in ("lines", "words", "paragraphs"))
MEASURES["document_changes"] = (
    f"WITH t AS (SELECT doc_id, text, substr(text, 1, CAST(floor(length(text) * 0.8) AS BIGINT)) AS cut FROM documents), x AS (SELECT doc_id, {_SIZES('text', 'a_')}, {_SIZES('cut', 'b_')} FROM t)\n"
    + "SELECT doc_id, " + ", ".join(f"round({_PCT(k)}, 6) AS {k}_pct" for k in ("lines", "words", "paragraphs")) + f", concat_ws(',', {_WARN}) AS warnings FROM x"
)
MEASURES["document_diagnostics"] = with_(
    D, f"s AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS t FROM (SELECT doc_id, {sentences('text')} AS s FROM d))", f"a AS (SELECT doc_id, 'sentence' AS kind, len({words('t')}) AS n, substr(t, 1, 280) AS text, pos FROM s WHERE len({words('t')}) >= 20)",
    f"w AS (SELECT doc_id, {words('lower(text)')} AS w FROM d)", "g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS text FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2))",
    "b AS (SELECT doc_id, 'bigram' AS kind, count(*) AS n, text, 0 AS pos FROM g GROUP BY doc_id, text HAVING count(*) >= 3)",
    select="SELECT doc_id, kind, CAST(rank AS INT) AS rank, CAST(n AS INT) AS n, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, pos, text) AS rank FROM (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b)) WHERE rank <= 3",
)
_DRAWN = (0.2, 0.5, 0.85, 0.95)
_KNOTS = [(0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90")]
_AT = "CASE WHEN q <= 0.1 THEN p10 " + " ".join(f"WHEN q <= {b} THEN {x} + ({y} - {x}) * (q - {a}) / (CAST({b} AS DOUBLE) - {a})" for (a, x), (b, y) in zip(_KNOTS, _KNOTS[1:], strict=False)) + " ELSE p90 END"
_DRAW = f"CAST([{', '.join(map(str, _DRAWN))}][CAST('0x' || substr(md5('0 ' || window_no || ' ' || metric), 1, 8) AS BIGINT) % {len(_DRAWN)} + 1] AS DOUBLE)"
_BAND = "least(CAST(5.0 AS DOUBLE), greatest(CAST(0.05 AS DOUBLE), abs(target) * CAST(0.1 AS DOUBLE)))"
_TARGETS = (
    f"SELECT profile, chunk_no, metric, q, round(target, 9) AS target, round(CASE WHEN metric LIKE '%!_rate' ESCAPE '!' THEN greatest(0.0, target - {_BAND}) ELSE target - {_BAND} END, 9) AS low, "
    + f"round(CASE WHEN metric LIKE '%!_rate' ESCAPE '!' THEN least(1.0, target + {_BAND}) ELSE target + {_BAND} END, 9) AS high FROM (SELECT *, {_AT} AS target FROM (SELECT *, window_no AS chunk_no, {_DRAW} AS q FROM bw JOIN bq USING (profile)))"
)
_BASE = f"WITH bw AS ({MEASURES['baseline_windows']}),\nbq AS ({MEASURES['baseline_quantiles']})"
MEASURES["baseline_targets"] = _BASE + "\n" + _TARGETS
_SLACK = "(high - low) * CAST(0.1 AS DOUBLE)"
MEASURES["windows_out_of_band"] = (
    _BASE + f",\nt AS ({_TARGETS}),\no AS (SELECT profile, window_no AS chunk_no, metric, value FROM (UNPIVOT bw ON {', '.join(_ALL)} INTO NAME metric VALUE value))\n"
    + f"SELECT profile, chunk_no, metric, value, low, high, CASE WHEN value < low THEN 'raise' ELSE 'lower' END AS advice FROM o JOIN t USING (profile, chunk_no, metric) WHERE value < low - {_SLACK} OR value > high + {_SLACK}"
)


def _masked() -> str:
    """The masks of a page: each kind's matches in what the kinds before it left. A citation's year is looked for in its own match."""
    from ..operators.markdown import MASKS

    plain = MASKS["CITATION"].split(r"|\((?=")[0]
    steps, last, n = [], "html", []
    for i, (kind, pattern) in enumerate((k, p) for k, p in MASKS.items() if k != "CITATION"):
        q = pattern.replace("'", "''")
        steps.append(f"regexp_replace({last}, '{q}', '[[{kind}_1]]', 'g') AS t{i}, len(regexp_extract_all({last}, '{q}')) AS n{i}")
        last = f"t{i}"
        n.append(f"n{i}")
    ctes, source = [], "pages"
    for i, s in enumerate(steps):
        ctes.append(f"m{i} AS (SELECT *, {s} FROM {source})")
        source = f"m{i}"
    either = plain.replace("'", "''") + r"|\([^()]{1,80}\)"
    cited = f"len(list_filter(regexp_extract_all({last}, '{either}'), lambda x: x[1:1] = '[' OR regexp_matches(x, '\\b(?:19|20)\\d{{2}}')))"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, CAST({' + '.join(n)} + {cited} AS INT) AS masks, true AS same FROM {source}"


MEASURES["mask_round_trip"] = _masked()
