"""The library's entry points: build, rate, compare and apply profiles, in bulk."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import markdown, profile, rewrite, scores
from ..sources import files


def make(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A profile, with an id that its name gives, of each author (profile, doc_id, text); stored under path if one is given."""
    out = profile.measurements(docs).withColumn("id", F.regexp_replace(F.md5("profile"), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
    if path is None:
        return out
    files.save_profiles(out, path)
    return docs.sparkSession.read.parquet(path)


def get(spark: SparkSession, path: str, guid: str) -> DataFrame:
    return files.load_profile(spark, path, guid)


def rate(texts: DataFrame, profiles: DataFrame, filtered: bool = False, top: int = 10) -> DataFrame:
    """Each text (id, profile, text) against its profile: score, probability with its interval, the first deltas.

    filtered: the texts' voice is filtered first, as it is when a profile is built from files.
    """
    t = texts.withColumn("text", markdown.voice_filter("text")) if filtered else texts
    own = profile.measurements(t.select(F.col("id").alias("profile"), F.monotonically_increasing_id().alias("doc_id"), "text"), function_words=False, single=True, stop=L.RATED_STOP_WORDS)
    own = own.withColumnRenamed("profile", "id").join(texts.select("id", "profile"), "id")
    scored = profile.compliance(own, profiles, without=L.UNRATED)
    return profile.match_probability(scored).join(scored.select("id", F.slice("deltas", 1, top).alias("deltas")), "id")


def similarity(profiles: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    return profile.similarity(profiles, pairs=pairs)


@dataclass(frozen=True)
class Rules:
    """What apply() enforces."""

    locale: str | None = None
    heading_styles: dict[int, str] = field(default_factory=dict)
    names: tuple[str, ...] = ()
    emoji: str = "none"
    emoji_table: dict[str, str] = field(default_factory=dict)
    near_duplicates: bool = True
    list_density: bool = False


def apply(docs: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) rewritten by rule, and how much changed; a document is a row, so all run side by side."""

    def by_rule(text: str) -> str:
        masked, found = markdown.mask_text(text, ("BASE64_IMAGE", "FROZEN_BLOCK", "HTML", "INLINE_CODE"))
        masked = rewrite.headings(masked, rules.heading_styles, rules.names)
        masked = rewrite.drop_near_duplicates(masked)[0] if rules.near_duplicates else masked
        masked = rewrite.group_lists(masked) if rules.list_density else masked
        for key, value in reversed(found.items()):
            masked = masked.replace(key, value)
        return rewrite.guarded_spelling(masked, rules.locale) if rules.locale else masked

    marks = rewrite.replace_emoji(rewrite.straight_quotes(rewrite.plain_dashes("text")), rules.emoji_table, rules.emoji)
    out = docs.select("doc_id", markdown.rows(by_rule)(marks).alias("text"))
    return out, scores.changes(docs, out)
