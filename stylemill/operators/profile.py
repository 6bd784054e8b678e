"""Profiles as rows of fixed vectors, and what compares them.

Every measure but repetition is a function of counts that add up over documents. `counts` takes them in one pass over the
texts; `measurements` adds them up for each profile and turns them into a vector for each section. A document is measured
by the same code as a profile of its own. Comparing a document with its author is then one join, of rows, not of metrics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.stored import stored
from . import measure as M

SECTIONS = ("sentence", "paragraph", "one_sentence", "punctuation", "orthography", "stance", "rhetoric_moves", "epistemic_profile", "paragraph_cadence", "syntax_texture", "lexical_avoidance", "discourse_markers", "repetition")


#: The names of the metrics of each section, in the order of its vector, and where a stored profile holds them.
METRICS = {
    "punctuation": list(L.PUNCTUATION), "orthography": ["contractions_rate", "oxford_comma_signal"], "stance": [f"{k}_rate" for k in L.STANCE],
    "rhetoric_moves": [*[f"{k}_rate" for k in L.RHETORIC], "claim_evidence_ratio"], "epistemic_profile": [f"{k}_rate" for k in L.EPISTEMIC],
    "paragraph_cadence": ["opening_sentence_length_mean", "opening_sentence_length_stdev", "closing_sentence_length_mean", "closing_sentence_length_stdev"],
    "syntax_texture": ["subordinate_clause_rate", "parenthetical_rate", "appositive_rate"], "lexical_avoidance": list(L.AVOIDANCE),
    "discourse_markers": ["start_rate_per_1000w", "mid_rate_per_1000w"], "repetition": ["bigram_repeat_rate", "trigram_repeat_rate"],
}
PATHS = {
    "sentence_length_histogram": "sentence.length_words.histogram_p", "paragraph_length_histogram": "paragraph.length_sentences_histogram_p",
    "one_sentence_paragraph_rate": "paragraph.one_sentence_paragraph_rate", "punctuation": "punctuation.rates_per_1000w", "orthography": "orthography_signals",
    "stance": "stance_signals", "rhetoric_moves": "rhetoric_moves", "epistemic_profile": "epistemic_profile", "paragraph_cadence": "paragraph_cadence",
    "syntax_texture": "syntax_texture", "lexical_avoidance": "lexical_avoidance.category_rates_per_1000w",
    "discourse_markers": "templates_signals.transition_marker_positions", "repetition": "repetition",
}
#: What a writer can change about each section.
ADVICE = {
    "sentence_length_histogram": "split long sentences or join short ones", "paragraph_length_histogram": "move sentences between paragraphs",
    "one_sentence_paragraph_rate": "join or part paragraphs of one sentence", "punctuation": "punctuate as the author does", "orthography": "contractions and commas before and",
    "stance": "hedges, boosters and pronouns", "rhetoric_moves": "the balance of claims, evidence and concessions", "epistemic_profile": "how certain the text sounds",
    "paragraph_cadence": "how long paragraphs open and close", "syntax_texture": "subordinate clauses, asides and appositions", "lexical_avoidance": "words the author keeps away from",
    "discourse_markers": "where transitions stand", "repetition": "phrases that come again",
}


def _among(terms: list[str]) -> Column:
    return F.size(F.filter("w", lambda x: x.isin(terms)))


def _in_bins(values: str, bins: list[tuple[int, int | None]]) -> list[Column]:
    def inside(lo: int, hi: int | None) -> Column:
        return F.size(F.filter(values, lambda x: (x >= lo) & (F.lit(True) if hi is None else x <= hi)))

    return [inside(*b) for b in bins]


def _total(values: str, square: bool = False) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + (x * x if square else x))


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """profile, the columns to keep, and the additive counts of each document, by name."""
    listed = sorted({t for lexicon in (L.STANCE, L.EPISTEMIC, L.AVOIDANCE, {"": L.SUBORDINATORS}) for terms in lexicon.values() for t in terms})
    some = lambda text, terms: reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])
    # each step computes once what the next one uses many times
    x = docs.select("profile", *keep, "text", F.lower("text").alias("low"), T.lower_words("text").alias("w"), T.sentences("text").alias("s"), T.paragraphs("text").alias("p"))
    x = x.select(
        "profile", *keep, "text", "low", F.size("w").alias("nw"), F.filter("w", lambda t: t.isin(listed)).alias("w"),
        F.transform("s", lambda s: F.struct(F.lower(s).alias("low"), T.lower_words(s).alias("w"))).alias("s"), F.transform("p", T.sentences).alias("ps"),
    )
    x = x.select(
        "profile", *keep, "text", "low", "nw", "w", "ps", F.transform("s", lambda s: F.size(s["w"]).cast("long")).alias("len"),
        F.transform("s", lambda s: F.struct(s["low"], F.size(s["w"]).alias("n"), F.array_join(F.slice(s["w"], 1, 3), " ").alias("start"), F.array_join(F.slice(s["w"], 2, F.greatest(F.size(s["w"]) - 1, F.lit(0))), " ").alias("rest"))).alias("s"),
    )
    size = lambda s: T.word_count(s).cast("long")
    x = x.select("*", F.transform("ps", lambda p: F.size(p).cast("long")).alias("plen"), F.transform(F.filter("ps", lambda p: F.size(p) > 0), lambda p: F.struct(size(F.element_at(p, 1)).alias("o"), size(F.element_at(p, -1)).alias("c"))).alias("cad"))
    start = lambda s: s["start"].isin(L.TRANSITIONS)
    spoken = F.filter("s", lambda s: s["n"] > 0)
    named = {
        "words": F.col("nw"), "sentences": F.size("len"), "len1": _total("len"), "len2": _total("len", True), "paragraphs": F.size("plen"),
        "one": F.size(F.filter("plen", lambda x: x == 1)), "contractions": F.coalesce(F.regexp_count("text", F.lit(r"(?U)\b\w+(?:n't|'re|'ve|'ll|'d|'m|'s)\b")), F.lit(0)),
        "ands": T.occurrences("low", " and "), "comma_ands": T.occurrences("low", ", and "),
        "appositives": F.coalesce(F.regexp_count("low", F.lit(r"(?U),\s+(?:a|an|the|which|who|that)\b")), F.lit(0)), "subordinators": _among(L.SUBORDINATORS),
        "starts": F.size(F.filter(spoken, start)), "mids": F.size(F.filter(spoken, lambda s: ~start(s) & some(s["rest"], L.TRANSITIONS))),
        "openings": F.size("cad"), "o1": F.aggregate("cad", F.lit(0).cast("long"), lambda a, x: a + x["o"]), "o2": F.aggregate("cad", F.lit(0).cast("long"), lambda a, x: a + x["o"] * x["o"]),
        "c1": F.aggregate("cad", F.lit(0).cast("long"), lambda a, x: a + x["c"]), "c2": F.aggregate("cad", F.lit(0).cast("long"), lambda a, x: a + x["c"] * x["c"]),
    }
    named |= {f"sh{i}": c for i, c in enumerate(_in_bins("len", L.SENTENCE_BINS))} | {f"ph{i}": c for i, c in enumerate(_in_bins("plen", L.PARAGRAPH_BINS))}
    named |= {f"pu_{k}": T.occurrences("text", m) for k, m in L.PUNCTUATION.items()}
    for prefix, lexicon in (("st", L.STANCE), ("ep", L.EPISTEMIC), ("av", L.AVOIDANCE)):
        named |= {f"{prefix}_{k}": _among(t) for k, t in lexicon.items()}

    def marked(terms: list[str]) -> Column:
        return F.size(F.filter("s", lambda s: some(s["low"], terms)))

    named |= {f"rh_{k}": marked(t) for k, t in L.RHETORIC.items()}
    return x.select("profile", *keep, *[c.cast("long").alias(k) for k, c in named.items()])


def summed(counted: DataFrame) -> DataFrame:
    """One row of counts for each profile."""
    return counted.groupBy("profile").agg(*[F.sum(k).alias(k) for k, kind in counted.dtypes if kind == "bigint" and k not in ("profile", "doc_id")])


def _deviation(n: str, s1: str, s2: str) -> Column:
    return F.when(F.col(n) > 0, F.sqrt(F.greatest(F.lit(0.0), (F.col(n) * F.col(s2) - F.col(s1) * F.col(s1)) / (F.col(n) * F.col(n))))).otherwise(0.0)


def _share(keys: list[str]) -> Column:
    total = reduce(lambda a, b: a + b, map(F.col, keys))
    return F.array(*[F.when(total > 0, F.col(k) / total).otherwise(0.0) for k in keys])


def vectors(counted: DataFrame, *keep: str) -> DataFrame:
    """profile, the columns to keep, words and an array<double> for each section that counts give, of each row of counts."""
    words = F.col("words")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rates = lambda keys: F.array(*[M.rate(F.col(k), words) for k in keys])
    paren = (F.col("pu_parentheses_open") + F.col("pu_parentheses_close")).alias("par")
    x = counted.select("*", paren).select(
        "profile", *keep, "words", _share([f"sh{i}" for i in range(5)]).alias("sentence"), _share([f"ph{i}" for i in range(5)]).alias("paragraph"),
        F.array(F.col("one") / F.greatest(F.lit(1), "paragraphs")).alias("one_sentence"), rates([f"pu_{k}" for k in L.PUNCTUATION]).alias("punctuation"),
        F.array(F.col("contractions") / F.greatest(F.lit(1), words), F.col("comma_ands") / F.greatest(F.lit(1), "ands")).alias("orthography"),
        rates([f"st_{k}" for k in L.STANCE]).alias("stance"),
        F.concat(rates([f"rh_{k}" for k in L.RHETORIC]), F.array(F.col("rh_claim") / F.greatest(F.lit(1), "rh_evidence"))).alias("rhetoric_moves"),
        rates([f"ep_{k}" for k in L.EPISTEMIC]).alias("epistemic_profile"),
        F.array(ratio("o1", "openings"), _deviation("openings", "o1", "o2"), ratio("c1", "openings"), _deviation("openings", "c1", "c2")).alias("paragraph_cadence"),
        rates(["subordinators", "par", "appositives"]).alias("syntax_texture"), rates([f"av_{k}" for k in L.AVOIDANCE]).alias("lexical_avoidance"),
        rates(["starts", "mids"]).alias("discourse_markers"),
        ratio("len1", "sentences").alias("sentence_mean"), _deviation("sentences", "len1", "len2").alias("sentence_stdev"),
    )
    if "fw" in counted.columns:
        x = x.withColumn("function_words", _word_rates()).drop("fw")
    return x


def totals(docs: DataFrame, function_words: bool = True) -> DataFrame:
    """A stored row of counts for each profile, from which `vectors` and `whole` are read; fw: those of the function words, in their order."""
    x = summed(counts(docs))
    if function_words:
        listed = F.array_sort(F.collect_list(F.struct("place", "n")))  # a row for each word of the list
        x = x.join(M.function_words(docs).groupBy("profile").agg(F.transform(listed, lambda r: r["n"]).alias("fw")), "profile")
    return stored(x)


def word_use(docs: DataFrame, sentences: bool = False) -> DataFrame:
    """A stored row for each profile of the counts that need no more than words: words, fw, and the bins of the sentences' lengths."""
    listed = F.array_sort(F.collect_list(F.struct("place", "n")))
    fw = M.function_words(docs).groupBy("profile").agg(F.transform(listed, lambda r: r["n"]).alias("fw"))
    x = M.word_totals(docs)
    if sentences:
        lens = docs.select("profile", F.transform(T.sentences("text"), T.word_count).alias("len"))
        bins = lens.select("profile", *[c.alias(f"sh{i}") for i, c in enumerate(_in_bins("len", L.SENTENCE_BINS))])
        x = x.join(bins.groupBy("profile").agg(*[F.sum(f"sh{i}").alias(f"sh{i}") for i in range(len(L.SENTENCE_BINS))]), "profile")
    return stored(x.join(fw, "profile"))


def use_vectors(rows: DataFrame) -> DataFrame:
    """profile, function_words and sentence (if its bins are there), of rows of `word_use`."""
    bins = [f"sh{i}" for i in range(len(L.SENTENCE_BINS)) if f"sh{i}" in rows.columns]
    return rows.select("profile", _word_rates(), *([_share(bins).alias("sentence")] if bins else []))


def _word_rates() -> Column:
    return F.transform("fw", lambda n: M.rate(n, F.col("words"))).alias("function_words")


def whole(rows: DataFrame) -> DataFrame:
    """The counts of all profiles together, from those of each: the profile `all`."""
    x = summed(rows.withColumn("profile", F.lit("all")))
    if "fw" in rows.columns:
        each = rows.select(F.posexplode("fw").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n"))
        fw = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda r: r["n"]).alias("fw")).withColumn("profile", F.lit("all"))
        x = x.join(fw, "profile")
    return x


def measurements(docs: DataFrame, repetition: bool = True, function_words: bool = True, single: bool = False, stop: list[str] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """profile, words and an array<double> for each section. single: each profile is one document, so n-grams stay in the row.

    stop: the words that no n-gram may consist of but for one, where profiles are single documents. counted: `counts` of docs, if there.
    """
    c = summed(counts(docs) if counted is None else counted)
    if function_words:
        listed = F.array_sort(F.collect_list(F.struct("place", "n")))
        c = c.join(M.function_words(docs).groupBy("profile").agg(F.transform(listed, lambda r: r["n"]).alias("fw")), "profile")
    x = vectors(c, *(["fw"] if function_words else []))
    if not repetition:
        return x
    return with_repetition(x, M.document_repetition(docs, stop=stop) if single else M.repetition_rates(docs))


def with_repetition(x: DataFrame, rates: DataFrame) -> DataFrame:
    r = rates.select("profile", F.array("bigram_repeat_rate", "trigram_repeat_rate").alias("repetition"))
    return x.join(r, "profile", "left").withColumn("repetition", F.coalesce("repetition", F.array(F.lit(0.0), F.lit(0.0))))


def _fold(a: Column, b: Column, fn) -> Column:
    return F.aggregate(F.zip_with(a, b, fn), F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    """C1; 0 where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _fold(a, b, lambda x, y: F.abs(x - y))).otherwise(0.0)


def relative_difference(a: Column, b: Column) -> Column:
    """A against the target b; absolute for targets below 1."""
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0))


def normalised(v: Column) -> Column:
    """Negatives are 0; without anything positive all are alike."""
    pos = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(pos, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(pos, lambda x: x / total)).otherwise(F.transform(v, lambda x: 1.0 / F.size(v)))


def js_divergence(p: Column, q: Column) -> Column:
    """C4: base 2, of the normalised vectors; 1 where the lengths differ."""
    a, b, eps = normalised(p), normalised(q), 1e-12
    one = lambda x, m: F.when(x > 0, x * F.log2((x + eps) / (m + eps))).otherwise(0.0)
    value = _fold(a, b, lambda x, y: 0.5 * (one(x, (x + y) / 2) + one(y, (x + y) / 2)))
    return F.when((F.size(p) == F.size(q)) & (F.size(p) > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).otherwise(1.0)


def raw_js_divergence(p: Column, q: Column) -> Column:
    """Without normalising; 0 where the lengths differ."""
    eps = 1e-12
    one = lambda x, m: x * F.log2((x + eps) / (m + eps))
    return F.when(F.size(p) == F.size(q), _fold(p, q, lambda x, y: (one(x, (x + y) / 2) + one(y, (x + y) / 2)) / 2)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """C7, within 0 and 1; 0 for null vectors or where the lengths differ."""
    norm = F.sqrt(_fold(a, a, lambda x, y: x * y)) * F.sqrt(_fold(b, b, lambda x, y: x * y))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), _fold(a, b, lambda x, y: x * y) / norm))).otherwise(0.0)


def relative_similarity(a: Column, b: Column) -> Column:
    """C8"""
    return 1.0 / (1.0 + F.abs(a - b) / F.greatest((F.abs(a) + F.abs(b)) / 2.0, F.lit(1e-9)))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets; two conventions for empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def kl_divergence(p: Column, q: Column) -> Column:
    """Base 2, smoothed by 1e-9."""
    s = lambda v: F.transform(v, lambda x: F.greatest(x, F.lit(0.0)) + 1e-9)
    a, b = normalised(s(p)), normalised(s(q))
    return _fold(a, b, lambda x, y: x * F.log2(x / y))


def _mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def compliance(measured: DataFrame, profiles: DataFrame, weights: dict[str, float] | None = None, without: dict[str, list[str]] | None = None) -> DataFrame:
    """How well each row of `measured` (id, profile, sections) matches the profile of that name: id, profile, score, deltas.

    deltas: the metrics that are off by more than their tolerance, with how far, and the values of both sides (histograms: of each bin).
    without: metrics by section that are not compared, because one side doesn't measure them.
    """
    weights, without = weights or {}, without or {}
    target = profiles.select("profile", *[F.col(s).alias(f"t_{s}") for s in SECTIONS])
    x = measured.join(target, "profile")

    rates = [s for s in SECTIONS if s not in ("sentence", "paragraph", "one_sentence", "orthography")]
    used_at = {s: [i for i, m in enumerate(METRICS[s]) if m not in without.get(s, [])] for s in (*rates, "orthography")}

    def differences(s: str) -> Column:
        every = F.zip_with(F.col(s), F.col(f"t_{s}"), relative_difference)
        return every if len(used_at[s]) == len(METRICS[s]) else F.filter(every, lambda _, i: i.isin(used_at[s]))

    # how far each section is off, once; then the score and the deltas read it
    off = {s: differences(s).alias(f"off_{s}") for s in used_at}
    x = x.select(
        "id", "profile", "words", *SECTIONS, *[f"t_{s}" for s in SECTIONS], *off.values(), F.abs(F.col("one_sentence")[0] - F.col("t_one_sentence")[0]).alias("one"),
        *[(l1(F.col(s), F.col(f"t_{s}")) / 2.0).alias(f"half_{s}") for s in ("sentence", "paragraph")],
    )

    def close(d: Column) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), d))

    score = {"sentence": close(F.col("half_sentence")), "paragraph": (close(F.col("half_paragraph")) + close(F.col("one"))) / 2, "orthography": _mean(F.transform("off_orthography", close))}
    score |= {s: close(_mean(F.col(f"off_{s}"))) for s in rates}
    used = {s: float(weights.get(s, 1.0)) for s in score if float(weights.get(s, 1.0)) > 0}
    value = reduce(lambda a, b: a + b, [score[s] * w for s, w in used.items()]) / sum(used.values()) if used else F.lit(1.0)

    def delta(metric: Column, diff: Column, actual: Column, target: Column) -> Column:
        return F.struct(metric.alias("metric"), diff.alias("diff"), actual.alias("actual"), target.alias("target"))

    def single(metric: str, diff: str, section: str, limit: float) -> Column:
        return F.when(F.col(diff) > limit, F.array(delta(F.lit(metric), F.col(diff), F.col(section), F.col(f"t_{section}")))).otherwise(F.array().cast("array<struct<metric:string,diff:double,actual:array<double>,target:array<double>>>"))

    def listed(section: str, limit: float) -> Column:
        names, places = (F.array(*map(F.lit, v)) for v in ([f"{section}.{METRICS[section][i]}" for i in used_at[section]], used_at[section]))
        value = lambda side, i: F.array(F.get(F.col(side), F.get(places, i)))
        named = F.transform(f"off_{section}", lambda d, i: delta(F.get(names, i), d, value(section, i), value(f"t_{section}", i)))
        return F.filter(named, lambda r: r["diff"] > limit)

    deltas = [single("sentence_length_histogram", "half_sentence", "sentence", 0.15), single("paragraph_length_histogram", "half_paragraph", "paragraph", 0.15), single("one_sentence_paragraph_rate", "one", "one_sentence", 0.1)]
    deltas += [listed(s, 0.5 if s in ("punctuation", "orthography") else 0.6) for s in (*rates, "orthography")]
    return x.select("id", "profile", "words", value.alias("score"), F.concat(*deltas).alias("deltas"))


def feedback(scored: DataFrame, k: int = 5) -> DataFrame:
    """C11: of each row of `compliance`, the k deltas that are most off, the first listed of equal ones: what to change, and which way.

    path: where a stored profile holds the metric; actual and target: its values; change: less or more, null for histograms.
    """
    place = F.transform("deltas", lambda d, i: F.struct((-d["diff"]).alias("by"), i.alias("place"), d.alias("d")))
    x = scored.select("id", "profile", "score", F.posexplode(F.slice(F.array_sort(place), 1, k)).alias("rank", "x")).select("id", "profile", "score", "rank", "x.d.*")
    section, name = F.substring_index("metric", ".", 1), F.when(F.contains("metric", F.lit(".")), F.substring_index("metric", ".", -1))
    look = lambda table: F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), section)
    one = F.when(F.size("actual") == 1, F.when(F.col("actual")[0] > F.col("target")[0], "less").otherwise("more"))
    return x.select("id", "profile", "score", "rank", "metric", "diff", F.concat_ws(".", look(PATHS), name).alias("path"), "actual", "target", one.alias("change"), look(ADVICE).alias("advice"))


def match_probability(scored: DataFrame, threshold: float = 0.59, slope: float = 0.12, evidence: int = 250) -> DataFrame:
    """A logistic curve of the score, drawn to one half for short texts, with its interval."""
    raw = 1.0 / (1.0 + F.exp(-(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))) - threshold) / max(1e-6, slope)))
    sure = 1.0 - F.exp(-F.greatest(F.lit(0), "words") / max(1, evidence))
    p = 0.5 + sure * (raw - 0.5)
    half = (1.0 - sure) * 0.5
    keep = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return scored.select("id", "profile", "words", M.r6("score").alias("score"), M.r6(keep(p)).alias("probability"), M.r6(keep(p - half)).alias("low"), M.r6(keep(p + half)).alias("high"))


def similarity(profiles: DataFrame, weights: dict[str, float] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Each pair of profiles (a, b) with its components and their weighted mean.

    pairs: rows (a, b) of names; without it all pairs a < b, which are what is asked for, dealt by pairs of blocks of profiles.
    """
    profiles = stored(profiles)
    if pairs is None:
        pairs = all_pairs(profiles)
    a, b = (profiles.select(F.col("profile").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in profiles.columns]) for p in "ab")
    return similarity_of(pairs.join(a, "a").join(b, "b"), L.SIMILARITY_WEIGHTS | (weights or {}))


def all_pairs(profiles: DataFrame, block: int = 256) -> DataFrame:
    """a, b: each pair of names a < b once. A profile goes to the pairs of its block with every block, and meets its partners there."""
    blocks = -(-profiles.count() // block) or 1
    own = F.pmod(F.xxhash64("profile"), F.lit(blocks))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    x = profiles.select("profile", own.alias("own"), F.explode(every).alias("other")).select("profile", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    l, r = x.select("lo", "hi", F.col("profile").alias("a")), x.select("lo", "hi", F.col("profile").alias("b"))
    # two of one block meet in its pair with itself alone
    l, r = (d.join(profiles.select(F.col("profile").alias(c), own.alias(f"own_{c}")), c) for d, c in ((l, "a"), (r, "b")))
    return l.join(r, ["lo", "hi"]).where((F.col("a") < F.col("b")) & ((F.col("own_a") != F.col("own_b")) | (F.col("lo") == F.col("hi")))).select("a", "b")


def similarity_of(pairs: DataFrame, w: dict[str, float] | None = None) -> DataFrame:
    """The same for given pairs: rows with the columns of two profiles, prefixed a_ and b_.

    A component of which either profile lacks the section (null, empty or no such column) is null; the others' weights are what the
    mean is over, and coverage is their share. Profiles without lexicons agree in having none.
    """
    w = w or L.SIMILARITY_WEIGHTS
    c = lambda s: (F.col(f"a_{s}"), F.col(f"b_{s}"))
    has = lambda s: f"a_{s}" in pairs.columns

    def both(s: str, value: Column) -> Column:
        return F.when((F.size(f"a_{s}") > 0) & (F.size(f"b_{s}") > 0), value)

    apart = lambda s: both(s, F.greatest(F.lit(0.0), 1.0 - js_divergence(*c(s)))) if has(s) else F.lit(None).cast("double")
    close = lambda s: both(s, _mean(F.zip_with(*c(s), relative_similarity))) if has(s) else F.lit(None).cast("double")
    words = lambda s: jaccard(*[F.coalesce(v, F.array().cast("array<string>")) for v in c(s)]) if has(s) else F.lit(1.0)
    parts = {
        "function_words_distribution": apart("function_words"), "sentence_histogram": apart("sentence"), "paragraph_histogram": apart("paragraph"),
        "punctuation_rates": close("punctuation"), "stance_signals": close("stance"), "rhetoric_moves": close("rhetoric_moves"), "syntax_texture": close("syntax_texture"),
        "paragraph_cadence": close("paragraph_cadence"), "repetition": close("repetition"),
        "lexicon_preferred_overlap": words("preferred"), "lexicon_avoid_overlap": words("avoid"),
    }
    add = lambda cs: reduce(lambda x, y: x + y, cs)
    x = pairs.select(F.col("a_profile").alias("a"), F.col("b_profile").alias("b"), *[v.alias(k) for k, v in parts.items()], F.least("a_words", "b_words").alias("least"))
    used = add([F.when(F.col(k).isNotNull(), w[k]).otherwise(0.0) for k in parts])
    overall = F.when(used > 0, add([F.when(F.col(k).isNotNull(), F.least(F.lit(1.0), F.col(k)) * w[k]).otherwise(0.0) for k in parts]) / used).otherwise(0.0)
    coverage = used / sum(w.values())
    sure = F.least(F.lit(1.0), 0.6 * coverage + 0.4 * (1.0 - F.exp(-F.coalesce("least", F.lit(0)) / 20000.0)))
    return x.select("a", "b", *[M.r6(F.col(k)).alias(k) for k in parts], M.r6(overall).alias("similarity"), M.r6(sure).alias("confidence"), M.r6(coverage).alias("coverage"))


def worst(pairs: DataFrame, k: int = 5) -> DataFrame:
    """O3: the k components in which each pair differs most."""
    rows = pairs.unpivot(["a", "b"], list(L.SIMILARITY_WEIGHTS), "component", "value").where("value is not null")
    best = F.slice(F.array_sort(F.collect_list(F.struct("value", "component"))), 1, k)  # eleven rows for each pair
    return rows.groupBy("a", "b").agg(best.alias("x")).select("a", "b", F.posexplode("x").alias("rank", "x")).select("a", "b", "rank", "x.component", "x.value")
