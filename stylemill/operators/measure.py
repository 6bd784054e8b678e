"""Corpus measurements. Input: docs(profile, doc_id, text), a document being a text of the profile's author.

Counts are taken for each document first and added up for each profile, so that a profile with most of the rows costs
no more than its share: every group-by has a partial aggregate on the map side. N-grams and openers don't cross
documents, for documents come in no order. Rates are per 1000 words and 0 without words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicons as L
from ..functions import text as T
from .hashed import gram_hashes


def rate(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total * 1000.0).otherwise(0.0)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def lexicon(docs: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """category, term: a literal table of a few hundred rows at most, which joins broadcast."""
    rows = [(c, t) for c, terms in categories.items() for t in terms]
    return F.broadcast(docs.sparkSession.createDataFrame(rows, "category string, token string"))


def tokens(docs: DataFrame) -> DataFrame:
    return docs.select("profile", "doc_id", F.explode(T.lower_words("text")).alias("token"))


def token_counts(docs: DataFrame) -> DataFrame:
    return tokens(docs).groupBy("profile", "token").agg(F.count("*").alias("n"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    s = docs.select("profile", "doc_id", F.explode(T.sentences("text")).alias("sentence"))
    return s.select("profile", "doc_id", "sentence", T.word_count("sentence").alias("words"))


def totals(docs: DataFrame) -> DataFrame:
    """A1: documents, words, sentences and paragraphs."""
    return docs.groupBy("profile").agg(
        F.count("*").alias("documents"), F.sum(T.word_count("text")).alias("words"),
        F.sum(F.size(T.sentences("text"))).alias("sentences"), F.sum(F.size(T.paragraphs("text"))).alias("paragraphs"),
    )


def word_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("profile").agg(F.sum(T.word_count("text")).alias("words"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """Size estimates of each document."""
    return docs.select("doc_id", "profile", T.word_count("text").cast("long").alias("words"), F.size(T.sentences("text")).cast("long").alias("sentences"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), T.token_estimate("text").alias("tokens"))


def sentence_lengths(docs: DataFrame) -> DataFrame:
    """A2: mean and population deviation of the words of a sentence."""
    return sentence_rows(docs).groupBy("profile").agg(r6(F.avg("words")).alias("mean"), r6(F.stddev_pop("words")).alias("stdev"), F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, bins: list[tuple[int, int | None]]) -> DataFrame:
    """A3, A4: shares of fixed bins, one row a bin; values in no bin don't count."""
    hits = [F.count_if((F.col(value) >= lo) & (F.lit(True) if hi is None else F.col(value) <= hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(bins)]
    wide = rows.groupBy("profile").agg(*hits)
    total = sum((F.col(f"b{i}") for i in range(len(bins))), F.lit(0))
    parts = F.array(*[F.struct(F.lit(i).alias("bin"), F.when(total > 0, r6(F.col(f"b{i}") / total)).otherwise(0.0).alias("p")) for i in range(len(bins))])
    return wide.select("profile", F.explode(parts).alias("x")).select("profile", "x.bin", "x.p")


def sentence_histogram(docs: DataFrame) -> DataFrame:
    return histogram(sentence_rows(docs), "words", L.SENTENCE_BINS)


def paragraph_rows(docs: DataFrame) -> DataFrame:
    p = docs.select("profile", "doc_id", F.explode(T.paragraphs("text")).alias("paragraph"))
    return p.select("profile", "doc_id", T.sentences("paragraph").alias("s")).select("profile", "doc_id", F.size("s").alias("sentences"), "s")


def paragraph_histogram(docs: DataFrame) -> DataFrame:
    return histogram(paragraph_rows(docs), "sentences", L.PARAGRAPH_BINS)


def one_sentence_rate(docs: DataFrame) -> DataFrame:
    """A5"""
    return paragraph_rows(docs).groupBy("profile").agg(r6(F.avg((F.col("sentences") == 1).cast("int"))).alias("one_sentence_rate"))


def punctuation_rates(docs: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """The count and rate of each mark."""
    keys = keys or L.PUNCTUATION
    wide = docs.groupBy("profile").agg(F.sum(T.word_count("text")).alias("words"), *[F.sum(T.occurrences("text", s)).alias(k) for k, s in keys.items()])
    return wide.unpivot(["profile", "words"], list(keys), "mark", "n").select("profile", "mark", "n", r6(rate(F.col("n"), F.col("words"))).alias("rate"))


def comma_density(docs: DataFrame) -> DataFrame:
    x = docs.groupBy("profile").agg(F.sum(T.word_count("text")).alias("words"), F.sum(T.occurrences("text", ",")).alias("commas"))
    return x.select("profile", r6(F.col("commas") / F.greatest(F.lit(1), "words") * 100).alias("comma_density"))


def contraction_rate(docs: DataFrame) -> DataFrame:
    """Words with n't, 're, 've, 'll, 'd, 'm or 's for each word."""
    hits = F.coalesce(F.regexp_count("text", F.lit(r"(?U)\b\w+(?:n't|'re|'ve|'ll|'d|'m|'s)\b")), F.lit(0))
    x = docs.groupBy("profile").agg(F.sum(T.word_count("text")).alias("words"), F.sum(hits).alias("hits"))
    return x.select("profile", F.col("hits"), r6(F.col("hits") / F.greatest(F.lit(1), "words")).alias("contraction_rate"))


def oxford_signal(docs: DataFrame) -> DataFrame:
    """The share of " and " that follow a comma."""
    low = F.lower("text")
    x = docs.groupBy("profile").agg(F.sum(T.occurrences(low, " and ")).alias("ands"), F.sum(T.occurrences(low, ", and ")).alias("comma_ands"))
    return x.select("profile", "ands", "comma_ands", r6(F.col("comma_ands") / F.greatest(F.lit(1), "ands")).alias("oxford_signal"))


def spelling_variant(docs: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """A10: evidence for US or Canadian and British spellings."""
    x = category_rates(docs, {"us": [a for a, _ in pairs or L.SPELLING_PAIRS], "canadian": [b for _, b in pairs or L.SPELLING_PAIRS]})
    x = x.groupBy("profile").agg(*[F.max(F.when(F.col("category") == c, F.col("hits"))).alias(f"{c}_hits") for c in ("us", "canadian")])
    total = F.col("us_hits") + F.col("canadian_hits")
    variant = F.when(total < 3, "unknown").when(F.col("us_hits") > F.col("canadian_hits"), "us").when(F.col("canadian_hits") > F.col("us_hits"), "canadian").otherwise("unknown")
    sure = F.when(total < 3, "low").when((total >= 8) & (F.abs(F.col("us_hits") - F.col("canadian_hits")) >= 4), "high").otherwise("medium")
    return x.select("profile", "us_hits", "canadian_hits", variant.alias("variant"), sure.alias("confidence"))


def category_rates(docs: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Hits and rates of each category of terms; categories without hits are there with 0.

    Words that are in no category are dropped within the row. What is left of a few categories is counted there too, in one
    scan and with a row for each profile to shuffle; the words of many categories are counted by a join instead.
    """
    listed = sorted({t for terms in categories.values() for t in terms})
    x = docs.select("profile", T.lower_words("text").alias("w")).select("profile", F.size("w").alias("words"), F.filter("w", lambda t: t.isin(listed)).alias("w"))
    if len(categories) <= 16:

        def hits_of(terms: list[str]) -> Column:
            return F.sum(F.size(F.filter("w", lambda t: t.isin(terms))))

        wide = x.groupBy("profile").agg(F.sum("words").alias("words"), *[hits_of(t).alias(c) for c, t in categories.items()])
        x = wide.unpivot(["profile", "words"], list(categories), "category", "hits")
    else:
        found = x.select("profile", F.explode_outer("w").alias("token")).join(lexicon(docs, categories), "token").groupBy("profile", "category").agg(F.count("*").alias("hits"))
        names = F.explode(F.array(*[F.lit(c) for c in categories])).alias("category")
        base = word_totals(docs).select("profile", "words", names)
        x = base.join(found, ["profile", "category"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return x.select("profile", "category", "hits", r6(rate(F.col("hits"), F.col("words"))).alias("rate"))


def function_words(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """The count and rate of each function word, zeros included, with its place in the list."""
    words = words or L.FUNCTION_WORDS
    counts = category_rates(docs, {w: [w] for w in words})
    order = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i)])
    return counts.select("profile", F.col("category").alias("word"), F.col("hits").alias("n"), "rate", order[F.col("category")].alias("place"))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """O1, O2: the first k rows of each profile; Spark keeps k of each group before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("profile").orderBy(*order))).where(F.col("rank") <= k)


def function_word_top(docs: DataFrame, k: int = 20) -> DataFrame:
    return top(function_words(docs), k, F.desc("n"), F.asc("place")).select("profile", "word", "n", "rank")


def syntax_texture(docs: DataFrame) -> DataFrame:
    """Subordinators, parentheses and appositives."""
    sub = category_rates(docs, {"subordinate": L.SUBORDINATORS}).select("profile", F.col("rate").alias("subordinate_rate"))
    x = docs.groupBy("profile").agg(
        F.sum(T.word_count("text")).alias("words"), F.sum(T.occurrences("text", "(") + T.occurrences("text", ")")).alias("par"),
        F.sum(F.coalesce(F.regexp_count(F.lower("text"), F.lit(r"(?U),\s+(?:a|an|the|which|who|that)\b")), F.lit(0))).alias("app"),
    )
    y = x.select("profile", r6(rate(F.col("par"), F.col("words"))).alias("parenthetical_rate"), r6(rate(F.col("app"), F.col("words"))).alias("appositive_rate"))
    return sub.join(y, "profile")


def rhetoric_moves(docs: DataFrame, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """Sentences that contain a marker as a string, per 1000 words, and claims for each piece of evidence."""
    markers = markers or L.RHETORIC
    low = F.lower("sentence")
    hit = {m: reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms]) for m, terms in markers.items()}
    hits = sentence_rows(docs).groupBy("profile").agg(*[F.count_if(c).alias(m) for m, c in hit.items()])
    x = word_totals(docs).join(hits, "profile", "left").na.fill(0)
    return x.select("profile", *[r6(rate(F.col(m), F.col("words"))).alias(f"{m}_rate") for m in markers], r6(F.col("claim") / F.greatest(F.lit(1), "evidence")).alias("claim_evidence_ratio"))


#: As much of a text as holds its first three words.
_THREE = rf"^[^A-Za-z0-9]*+{T.WORD}(?:[^A-Za-z0-9]++{T.WORD}){{0,2}}+"


def _openings(docs: DataFrame, first: bool = False) -> DataFrame:
    """profile, w: the words of each sentence that has one, or the first three; made once, before rows are."""
    cut = (lambda s: T.words(F.regexp_extract(F.lower(s), _THREE, 0))) if first else T.lower_words
    w = F.filter(F.transform(T.sentences("text"), cut), lambda w: F.size(w) > 0)
    return docs.select("profile", F.explode(w).alias("w"))


def _joined(w: str, n: int) -> Column:
    return F.array_join(F.slice(w, 1, n), " ")


def transition_openers(docs: DataFrame, k: int = 15, terms: list[str] | None = None) -> DataFrame:
    """Transitions that open sentences, the longest first."""
    listed = [F.when((F.size("w") >= n) & _joined("w", n).isin(terms or L.TRANSITIONS), _joined("w", n)) for n in (3, 2, 1)]
    found = _openings(docs, True).select("profile", F.coalesce(*listed).alias("phrase")).where("phrase is not null").groupBy("profile", "phrase").agg(F.count("*").alias("n"))
    return top(found, k, F.desc("n"), F.asc("phrase")).select("profile", "phrase", "n", "rank")


def discourse_positions(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Transitions at the start (the longest opening alone is tested) and after the first word."""
    terms = terms or L.TRANSITIONS
    start = _joined("w", 3).isin(terms)
    rest = F.array_join(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), " ")
    mid = reduce(lambda a, b: a | b, [F.contains(rest, F.lit(t)) for t in terms])
    hits = _openings(docs).groupBy("profile").agg(F.count_if(start).alias("s"), F.count_if(~start & mid).alias("m"))
    x = word_totals(docs).join(hits, "profile", "left").na.fill(0)
    return x.select("profile", r6(rate(F.col("s"), F.col("words"))).alias("start_rate"), r6(rate(F.col("m"), F.col("words"))).alias("mid_rate"))


def _stops(grams: Column, stop: list[str]) -> Column:
    return F.size(F.filter(grams, lambda x: x.isin(stop)))


def sentence_openers(docs: DataFrame, k: int = 20, stop: list[str] | None = None) -> DataFrame:
    """The first three (or two) words of sentences, with one stop word at most."""
    o = _openings(docs, True).where(F.size("w") >= 2).select("profile", F.slice("w", 1, 3).alias("o")).where(_stops(F.col("o"), stop or L.STOP_WORDS) <= 1)
    found = o.groupBy("profile", F.array_join("o", " ").alias("phrase")).agg(F.count("*").alias("n"))
    return top(found, k, F.desc("n"), F.asc("phrase")).select("profile", "phrase", "n", "rank")


def paragraph_cadence(docs: DataFrame) -> DataFrame:
    """Length of the sentences that open and close paragraphs."""
    p = paragraph_rows(docs).where("sentences > 0").select("profile", T.word_count(F.element_at("s", 1)).alias("o"), T.word_count(F.element_at("s", -1)).alias("c"))
    return p.groupBy("profile").agg(r6(F.avg("o")).alias("opening_mean"), r6(F.stddev_pop("o")).alias("opening_stdev"), r6(F.avg("c")).alias("closing_mean"), r6(F.stddev_pop("c")).alias("closing_stdev"))


def ngrams(docs: DataFrame, n: int, stop: list[str] | None = None) -> DataFrame:
    """T4: profile, phrase for each n-gram of a document with fewer than n - 1 stop words."""
    stop = L.STOP_WORDS if stop is None else stop
    w = docs.select("profile", T.lower_words("text").alias("w"))
    shifted = [F.slice("w", k + 1, F.greatest(F.size("w") - (n - 1), F.lit(0))).alias(f"w{k}") for k in range(n)]
    g = w.select("profile", F.inline(F.arrays_zip(*shifted)))  # of an expression: for a column, Spark would cut the words again to see that there are some
    few = sum((F.col(f"w{k}").isin(stop).cast("int") for k in range(n)), F.lit(0)) < n - 1
    return g.where(few).select("profile", F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("phrase"))


def ngram_counts(docs: DataFrame, n: int, stop: list[str] | None = None) -> DataFrame:
    return ngrams(docs, n, stop).groupBy("profile", "phrase").agg(F.count("*").alias("n"))


def top_ngrams(docs: DataFrame, n: int, k: int = 30) -> DataFrame:
    return top(ngram_counts(docs, n), k, F.desc("n"), F.asc("phrase")).select("profile", "phrase", "n", "rank")


def _hashed(words: Column, stop: list[str]) -> Column:
    """63 bits of each word's hash, and a last bit that is set for stop words."""
    return F.transform(words, lambda t: F.xxhash64(t).bitwiseAND(F.lit(-2)).bitwiseOR(t.isin(stop).cast("long")))


def _shifted(w: str) -> Column:
    """An array of (h0, h1, h2): each hash and the two that follow it, null beyond the end."""
    after = lambda k: F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0))).alias(f"h{k}")
    return F.arrays_zip(F.col(w).alias("h0"), after(1), after(2))


def _few(hashes: list[Column]) -> Column:
    """Whether a bigram has no stop word, a trigram one at most; null where it would end beyond the text."""
    return reduce(lambda a, b: a + b, [h.bitwiseAND(F.lit(1)) for h in hashes]) < len(hashes) - 1


def gram_repeats(docs: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """profile, size, n: how often each bigram and trigram of `ngrams` occurs, counted by hashes of their words.

    They are dealt out before they are counted: most occur once, and counting them twice would be in vain.
    """
    return repeats_of(gram_hashes(docs, (2, 3), L.STOP_WORDS if stop is None else stop))


def repeats_of(grams: DataFrame) -> DataFrame:
    """profile, size, n of each n-gram of `gram_hashes`."""
    g = grams.repartition("profile", "a")
    return g.groupBy("profile", "a", "b").agg(F.sum("n").alias("n")).select("profile", (F.col("b").bitwiseAND(F.lit(1)) + 2).alias("size"), "n")


def repetition_rates(docs: DataFrame, least: int = 3) -> DataFrame:
    """The share of n-grams that occur at least three times."""
    return repeat_shares(docs, gram_repeats(docs), least)


def repeat_shares(docs: DataFrame, repeats: DataFrame, least: int) -> DataFrame:
    x = repeats.groupBy("profile").agg(*[
        F.sum(F.when((F.col("size") == n) & ok, F.col("n")).otherwise(0)).alias(f"{k}{n}") for n in (2, 3) for k, ok in (("r", F.col("n") >= least), ("t", F.lit(True)))
    ])
    rates = x.select("profile", *[r6(F.col(f"r{n}") / F.greatest(F.lit(1), f"t{n}")).alias(name) for n, name in ((2, "bigram_repeat_rate"), (3, "trigram_repeat_rate"))])
    return docs.select("profile").distinct().join(rates, "profile", "left").na.fill(0.0)


def document_repetition(docs: DataFrame, *keep: str, stop: list[str] | None = None) -> DataFrame:
    """A23 where each profile is one document: its n-grams' hashes are sorted within the row, so nothing is shuffled. keep: further columns.

    In sorted order, a run of r >= 3 equal n-grams has r - 2 places where the next but one is alike.
    """
    stop = L.STOP_WORDS if stop is None else stop

    def sorted_grams(n: int) -> Column:
        h = lambda g: [g[f"h{k}"] for k in range(n)]
        return F.sort_array(F.array_compact(F.transform("g", lambda g: F.when(_few(h(g)), F.xxhash64(*h(g))))))

    def share(s: str) -> Column:
        runs = F.array_compact(F.zip_with(s, F.slice(s, 3, F.greatest(F.size(s) - 2, F.lit(0))), lambda a, b: F.when(a == b, a)))
        return r6((F.size(runs) + 2 * F.size(F.array_distinct(runs))) / F.greatest(F.lit(1), F.size(s)))

    x = docs.select("profile", *keep, _hashed(T.lower_words("text"), stop).alias("w")).select("profile", *keep, _shifted("w").alias("g"))
    x = x.select("profile", *keep, sorted_grams(2).alias("two"), sorted_grams(3).alias("three"))
    return x.select("profile", *keep, share("two").alias("bigram_repeat_rate"), share("three").alias("trigram_repeat_rate"))


def lexical_diversity(docs: DataFrame) -> DataFrame:
    """Type-token measures, Yule's K, Simpson's D and mean word length, from one frequency table."""
    x = token_counts(docs).groupBy("profile").agg(
        F.sum("n").alias("t"), F.count("*").alias("v"), F.sum(F.col("n") * F.col("n")).alias("m2"), F.sum(F.col("n") * F.length("token")).alias("c"),
    )
    t, v, m2 = (F.col(c).cast("double") for c in ("t", "v", "m2"))
    some = t > 1
    return x.select(
        "profile", F.col("t").alias("tokens"), F.col("v").alias("types"), r6(v / t).alias("ttr"),
        F.when(some, r6(F.ln(v) / F.ln(t))).otherwise(0.0).alias("herdan_c"), F.when(some, r6(v / F.sqrt(t))).otherwise(0.0).alias("guiraud_r"),
        F.when(some, r6((F.ln(t) - F.ln(v)) / (F.ln(t) * F.ln(t)))).otherwise(0.0).alias("maas"),
        r6(10000.0 * (m2 - t) / (t * t)).alias("yule_k"), F.when(some, r6((m2 - t) / (t * (t - 1)))).otherwise(0.0).alias("simpson_d"), r6(F.col("c") / t).alias("word_length"),
    )


def burstiness(docs: DataFrame) -> DataFrame:
    """Deviation over mean of sentence lengths (without empty ones) and of paragraphs' sentences."""
    ratio = lambda c: F.when(F.avg(c) > 0, r6(F.stddev_pop(c) / F.avg(c))).otherwise(0.0)
    s = sentence_rows(docs).where("words > 0").groupBy("profile").agg(ratio("words").alias("sentence_burstiness"))
    p = paragraph_rows(docs).groupBy("profile").agg(ratio("sentences").alias("paragraph_burstiness"))
    return s.join(p, "profile", "full").na.fill(0.0)


def entropy(counts: DataFrame, n: str = "n", exact: bool = False) -> DataFrame:
    """Shannon entropy in bits of the positive counts of each profile, in one aggregation."""
    c = F.col(n).cast("double")
    x = counts.where(F.col(n) > 0).groupBy("profile").agg(F.sum(c).alias("t"), F.sum(c * F.log2(c)).alias("cl"))
    bits = F.log2("t") - F.col("cl") / F.col("t")
    return x.select("profile", (bits if exact else r6(bits)).alias("entropy"))


def punctuation_entropy(docs: DataFrame) -> DataFrame:
    return entropy(punctuation_rates(docs))


def function_word_entropy(docs: DataFrame) -> DataFrame:
    return entropy(function_words(docs))


def char_trigrams(docs: DataFrame) -> DataFrame:
    """T5: trigrams of a document's letters."""
    letters = F.regexp_replace(F.lower("text"), "[^a-zA-Z]+", "")
    x = docs.select("profile", F.explode(F.regexp_extract_all(letters, F.lit("(?=(.{3}))"), F.lit(1))).alias("phrase"))
    return x.groupBy("profile", "phrase").agg(F.count("*").alias("n"))


def char_trigram_entropy(docs: DataFrame) -> DataFrame:
    return entropy(char_trigrams(docs))


def capitalisation(docs: DataFrame) -> DataFrame:
    """Occurrences of each token and the share of them that begin with a capital."""
    x = docs.select("profile", F.explode(F.coalesce(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0)), F.array().cast("array<string>"))).alias("t"))
    x = x.groupBy("profile", F.lower("t").alias("token")).agg(F.count("*").alias("n"), F.count_if(F.substring("t", 1, 1).rlike("[A-Z]")).alias("caps"))
    return x.select("profile", "token", "n", r6(F.col("caps") / F.col("n")).alias("cap_ratio"))


def absent_common_words(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Everyday words that a profile never uses."""
    words = [w for w in words or L.COMMON_WORDS if len(w) >= 3 and w.isalpha() and w not in L.STOP_WORDS]
    used = tokens(docs).where(F.col("token").isin(words)).select("profile", "token").distinct()
    listed = docs.select("profile").distinct().select("profile", F.posexplode(F.array(*map(F.lit, words))).alias("place", "token"))
    return listed.join(used, ["profile", "token"], "left_anti").select("profile", "token", "place")


def rare_words(docs: DataFrame, k: int = 40) -> DataFrame:
    """Rare content words, dealt by initial letter so that none prevails, ordered to avoid names."""
    counted = docs.select("profile", F.explode(T.words("text")).alias("t")).groupBy("profile", F.lower("t").alias("token")).agg(F.count("*").alias("n"), F.count_if(F.substring("t", 1, 1).rlike("[A-Z]")).alias("caps"))
    most = word_totals(docs).select("profile", "words", F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("words") * 0.0001))).alias("most"))
    t = F.col("token")
    ok = ~t.isin(L.STOP_WORDS) & t.rlike("^[a-z]{4,}$") & ~t.rlike("^[ivxlcdm]+$") & ~t.rlike(r"^(?=.{8})(.{3,})\1+$") & ~t.rlike("^(?=.{12})[^aeiouy]{5}")
    x = counted.where(ok).join(most, "profile").where(F.col("n") <= F.col("most"))
    x = x.withColumn("cap", F.col("caps") / F.col("n")).withColumn("h", F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long"))
    by_initial = W.partitionBy("profile", F.substring("token", 1, 1)).orderBy("n", "cap", "h", "token")
    x = x.withColumn("round", F.row_number().over(by_initial)).where(F.col("round") <= k)
    x = top(x, k, F.asc("round"), F.substring("token", 1, 1))
    again = W.partitionBy("profile").orderBy("cap", "n", "h", "token")
    return x.select("profile", "token", "n", r6(rate(F.col("n"), F.col("words"))).alias("rate"), F.row_number().over(again).alias("rank"))


def fiction_flags(docs: DataFrame, span_min: int = 6, ratio_min: float = 0.03, para_min: float = 0.2, force: float = 0.08) -> DataFrame:
    """Whether a profile reads like fiction, from its quotations."""
    q = T.quoted("text")
    opens = F.size(F.filter(T.paragraphs("text"), lambda p: F.substring(p, 1, 1).isin('"', "“")))
    x = docs.groupBy("profile").agg(
        F.sum(T.word_count("text")).alias("words"), F.sum(F.size(q)).alias("spans"), F.sum(F.aggregate(q, F.lit(0), lambda a, s: a + F.regexp_count(s, F.lit(T.WORD)))).alias("quoted"),
        F.sum(F.size(T.paragraphs("text"))).alias("paras"), F.sum(opens).alias("quote_paras"),
    )
    ratio, para = F.col("quoted") / F.greatest(F.lit(1), "words"), F.col("quote_paras") / F.greatest(F.lit(1), "paras")
    fiction = ((F.col("spans") >= span_min) & (ratio >= ratio_min)) | ((para >= para_min) & (ratio >= ratio_min)) | (ratio >= force)
    return x.select("profile", "spans", "quoted", r6(ratio).alias("quoted_ratio"), r6(para).alias("quote_para_ratio"), fiction.alias("fiction"))
