"""How a profile drifts: its additive counts over event-time windows of a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def drift(texts: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """texts: profile, ts, text. profile, start, words, sentences, commas and their ratios; late rows beyond the watermark are dropped."""
    n = texts.withWatermark("ts", late).groupBy("profile", F.window("ts", window).alias("w")).agg(
        F.count("*").alias("texts"), F.sum(T.word_count("text")).alias("words"), F.sum(F.size(T.sentences("text"))).alias("sentences"), F.sum(T.occurrences("text", ",")).alias("commas"),
    )
    per = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), b), 6)
    return n.select("profile", F.col("w.start").alias("start"), "texts", "words", "sentences", per("words", "sentences").alias("sentence_words"), per("commas", "words").alias("comma_rate"))
