"""Scores and diagnostics of texts: naturalness, Markdown style, what changed, what stands out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import markdown
from . import measure as M
from . import profile as P


def _share(value: str, whole: float) -> Column:
    """1 at `whole` and beyond; 0 for nothing."""
    return F.when(F.col(value) > 0, F.least(F.lit(1.0), F.col(value) / whole)).otherwise(0.0)


def _inverse(value: str, whole: float, zero: float = 0.0) -> Column:
    """1 near 0, 0 at `whole` and beyond; `zero` where there is nothing."""
    return F.when(F.col(value) > 0, F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.col(value) / whole))).otherwise(zero)


def naturalness(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """A score from 0 to 1 for each signal of varied prose, and their weighted mean out of 100.

    The two signals against a reference profile are those of the whole corpus given.
    """
    words = M.lexical_diversity(docs).select("profile", "tokens", "ttr", "herdan_c", "guiraud_r", "maas", "yule_k", "simpson_d", "word_length")
    marks = M.punctuation_rates(docs).groupBy("profile").agg(F.count_if(F.col("n") > 0).cast("double").alias("punct_variety"))
    named = lambda df, n: df.select("profile", F.col("entropy").alias(n))
    x = reduce(
        lambda a, b: a.join(b, "profile", "left"),
        [M.burstiness(docs), M.repetition_rates(docs), marks, named(M.punctuation_entropy(docs), "punct_entropy"), named(M.function_word_entropy(docs), "fw_entropy"), named(M.char_trigram_entropy(docs), "tri_entropy")],
        words,
    ).na.fill(0.0)
    counted = P.totals(docs)
    own = P.vectors(counted, "fw").select("profile", "sentence", "function_words")
    whole = P.vectors(P.whole(counted), "fw").select(F.lit(1).alias("one"), F.col("sentence").alias("ts"), F.col("function_words").alias("tf"))
    near = own.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")  # a single row
    near = near.select("profile", M.r6(P.kl_divergence(F.col("function_words"), F.col("tf"))).alias("kl"), M.r6(P.raw_js_divergence(F.col("sentence"), F.col("ts"))).alias("js"))
    x = x.join(near, "profile").withColumn("repeat", (F.col("bigram_repeat_rate") + F.col("trigram_repeat_rate")) / 2)
    s = {
        "lexical_diversity": _share("ttr", 0.5), "herdan_c": _share("herdan_c", 0.9), "guiraud_r": _share("guiraud_r", 15.0), "maas_inverse": _inverse("maas", 0.15),
        "yule_k_inverse": _inverse("yule_k", 100.0), "simpson_d_inverse": _inverse("simpson_d", 0.2), "repetition_inverse": _inverse("repeat", 0.2, 1.0),
        "sentence_burstiness": _share("sentence_burstiness", 1.0), "paragraph_burstiness": _share("paragraph_burstiness", 1.0),
        "punctuation_variety": _share("punct_variety", 8.0), "punctuation_entropy": _share("punct_entropy", 3.0), "function_word_entropy": _share("fw_entropy", 4.0),
        "function_word_kl_inverse": _inverse("kl", 0.5, 1.0), "sentence_length_js_inverse": _inverse("js", 0.3, 1.0), "char_trigram_entropy": _share("tri_entropy", 6.0),
        "word_length": F.when(F.col("word_length") > 0, F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("word_length") - 5.0) / 3.0)).otherwise(0.0),
    }
    w = {k: float((weights or {}).get(k, 1.0)) for k in s}
    used = {k: v for k, v in w.items() if v > 0}
    mean = reduce(lambda a, b: a + b, [s[k] * v for k, v in used.items()]) / sum(used.values()) if used else F.lit(0.0)
    return x.select("profile", *[M.r6(c).alias(f"score_{k}") for k, c in s.items()], F.round(mean * 100.0, 4).alias("aggregate_100"))


def markdown_style(docs: DataFrame, corrected: bool = True) -> DataFrame:
    """Share of headings in title case, bold spans per 1000 words, share of list items that open with a bold label.

    corrected=False counts runs of anything but asterisks as bold and finds no list items, as the original patterns do.
    """
    lines = docs.select("profile", F.explode(F.split(F.coalesce(markdown.rows(markdown.without_fences)("text"), F.lit("")), "\n")).alias("line"))
    t = F.trim("line")
    words = F.regexp_extract_all(F.regexp_replace(t, r"[^A-Za-z\s]", ""), F.lit("[A-Za-z]+"), F.lit(0))
    caps = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    heading = F.startswith(t, F.lit("#"))
    item = t.rlike(r"^(?:[-*+]|\d+\.)\s+") if corrected else F.lit(False)
    label = t.rlike(r"^(?:[-*+]|\d+\.)\s+\*\*[^*]+:\*\*") if corrected else F.lit(False)
    bold = F.regexp_count("line", F.lit(r"\*\*[^*]+\*\*" if corrected else r"[^*]+"))
    x = lines.groupBy("profile").agg(
        F.count_if(heading).alias("h"), F.count_if(heading & (F.size(words) > 0) & (caps / F.greatest(F.size(words), F.lit(1)) >= 0.6)).alias("hc"),
        F.count_if(item).alias("i"), F.count_if(label).alias("il"), F.sum(bold).alias("b"), F.sum(T.word_count("line")).alias("w"),
    )
    over = lambda a, b: F.when(F.col(b) > 0, M.r6(F.col(a) / F.col(b))).otherwise(0.0)
    return x.select("profile", over("hc", "h").alias("title_case_rate"), M.r6(F.col("b") / F.greatest(F.lit(1), "w") * 1000.0).alias("bold_per_1000w"), over("il", "i").alias("label_rate"))


def changes(before: DataFrame, after: DataFrame, warn: float = 10.0) -> DataFrame:
    """How lines, words and paragraphs of each doc_id changed, in per cent, and which changed by `warn` or more."""
    size = lambda df, p: df.select("doc_id", F.size(F.split("text", "\n")).alias(f"{p}lines"), T.word_count("text").alias(f"{p}words"), F.size(T.paragraphs("text")).alias(f"{p}paragraphs"))
    x = size(before, "a_").join(size(after, "b_"), "doc_id")
    kinds = ("lines", "words", "paragraphs")
    pct = {k: (F.col(f"b_{k}") - F.col(f"a_{k}")) / F.greatest(F.lit(1), f"a_{k}") * 100.0 for k in kinds}
    warned = F.filter(F.array(*[F.when(F.abs(c) >= warn, F.lit(k)) for k, c in pct.items()]), lambda k: k.isNotNull())
    return x.select("doc_id", *[M.r6(c).alias(f"{k}_pct") for k, c in pct.items()], warned.alias("warnings"))


def diagnostics(docs: DataFrame, k: int = 3) -> DataFrame:
    """The longest sentences of 20 words or more, and bigrams that occur three times, of each document."""
    s = docs.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "text")).withColumn("n", T.word_count("text")).where("n >= 20")
    longest = s.select("doc_id", F.lit("sentence").alias("kind"), "n", F.substring("text", 1, 280).alias("text"), "pos")
    own = docs.select(F.col("doc_id").alias("profile"), "doc_id", "text")
    grams = M.ngram_counts(own, 2, []).where("n >= 3").select(F.col("profile").alias("doc_id"), F.lit("bigram").alias("kind"), F.col("n").cast("int").alias("n"), F.col("phrase").alias("text"), F.lit(0).alias("pos"))
    order = W.partitionBy("doc_id", "kind").orderBy(F.desc("n"), "pos", "text")
    return longest.unionByName(grams).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "kind", "rank", "n", "text")


def merge_avoid_list(lexicons: DataFrame, extra: list[str]) -> DataFrame:
    """Listed terms join a profile's avoid_words, in order, once each; soft terms that are now hard leave the soft list."""
    hard = F.array_distinct(F.concat(F.coalesce("avoid_words", F.array().cast("array<string>")), F.array(*map(F.lit, extra))))
    return lexicons.withColumn("avoid_words", hard).withColumn("avoid_words_soft", F.array_except("avoid_words_soft", "avoid_words"))
