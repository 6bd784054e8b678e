"""Editing rules against profiles, and the choice among attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of `screen`: rates of the profile or the input from which a rule contradicts them.
LIMITS = {"em_dash": 0.5, "hedge": 1.0, "first_person": 0.5, "contractions_avoid": 2.0, "contractions_use": 0.5, "title_case": 0.6, "bold": 3.0, "label": 0.2}


def _terms(words: Column) -> Column:
    """The alternatives of a rule's words to watch: parts between slashes, trimmed, in lower case."""
    return F.array_remove(F.array_distinct(F.transform(F.split(F.lower(F.array_join(words, "/")), "/"), F.trim)), "")


def screen(rules: DataFrame, profiles: DataFrame, forbidden_dashes: bool = False, emoji: str = "none", fixed_headings: bool = False, limits: dict[str, float] | None = None) -> DataFrame:
    """Each rule (title, words_to_watch) for each profile, with why it is dropped, or null if it is kept.

    profiles: profile, em_dash_rate, hedge_rate, first_person_rate, contraction_rate, preferred, avoided (arrays of terms),
    formal, title_case_rate, bold_per_1000w, label_rate. Of several reasons the last in this order holds. Rules are a short
    list, broadcast to the profiles.
    """
    at = LIMITS | (limits or {})
    r = rules.select("title", F.coalesce("words_to_watch", F.array().cast("array<string>")).alias("words_to_watch"))
    listed = r.agg(F.collect_list(F.struct("title", "words_to_watch")).alias("rules")).withColumn("one", F.lit(1))
    x = profiles.withColumn("one", F.lit(1)).join(F.broadcast(listed), "one").withColumn("rule", F.explode("rules")).drop("rules", "one")
    title, words, terms = F.lower("rule.title"), F.lower(F.array_join("rule.words_to_watch", " ")), _terms(F.col("rule.words_to_watch"))

    def about(*parts: str) -> Column:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(title, F.lit(p)) | F.contains(words, F.lit(p))
        return hit

    def titled(*parts: str) -> Column:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(title, F.lit(p))
        return hit

    reasons = [
        (about("em dash") & F.lit(forbidden_dashes), "em dashes are forbidden"),
        (about("em dash") & F.lit(not forbidden_dashes) & (F.col("em_dash_rate") >= at["em_dash"]), "the author uses em dashes"),
        (about("emoji") & F.lit(emoji in ("remove", "replace")), "emoji are handled by rule"),
        (about("hedging") & (F.col("hedge_rate") >= at["hedge"]), "the author hedges"),
        (titled('use "i"', "first person") & (F.col("first_person_rate") < at["first_person"]), "the author avoids the first person"),
        (about("contraction") & titled("avoid") & (F.col("contraction_rate") >= at["contractions_avoid"]), "the author uses contractions"),
        (about("contraction") & titled("use") & (F.col("contraction_rate") < at["contractions_use"]), "the author rarely uses contractions"),
        (F.arrays_overlap(terms, "avoided"), "its terms are to be avoided"),
        (F.arrays_overlap(terms, "preferred"), "its terms are preferred"),
        (F.col("formal") & titled("add voice", "have opinions", "humor", "edge", "mess", "feelings"), "the voice is formal"),
        (titled("title case") & (F.lit(fixed_headings) | (F.col("title_case_rate") >= at["title_case"])), "headings keep their case"),
        (titled("boldface") & (F.col("bold_per_1000w") >= at["bold"]), "the input uses bold"),
        (titled("inline-header", "inline header") & (F.col("label_rate") >= at["label"]), "the input uses labelled lists"),
    ]
    return x.select("profile", "rule.title", F.coalesce(*[F.when(c, F.lit(why)) for c, why in reversed(reasons)]).alias("reason"))


def best_attempts(attempts: DataFrame) -> DataFrame:
    """Of the attempts at each chunk (doc_id, chunk_no, attempt, violations, score, text), the one with the fewest
    violations, then the highest score, then the first."""
    order = F.struct(-F.col("violations"), F.col("score"), -F.col("attempt"))
    best = F.max_by(F.struct("attempt", "violations", "score", "text"), order).alias("best")
    return attempts.groupBy("doc_id", "chunk_no").agg(best).select("doc_id", "chunk_no", "best.*")


def stitched(chunks: DataFrame) -> DataFrame:
    """The chunks (doc_id, chunk_no, text) of each document, in order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\n\n").alias("text"))
