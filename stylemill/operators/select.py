"""Choosing text: excerpts, summaries, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicons as L
from ..functions import text as T
from .lines import with_blocks
from .spans import block_of, packed, prefix_sums


def voice_score(p: str | Column) -> Column:
    """C17: how much a paragraph looks like the author's own narrative prose."""
    p = F.col(p) if isinstance(p, str) else p
    n, size = T.word_count(p), F.greatest(F.lit(1), F.length(p))
    share = lambda cls: F.regexp_count(p, F.lit(cls)) / size
    factor = lambda test, f: F.when(test, f).otherwise(1.0)
    score = F.when(n < 60, 0.3).when(n > 280, 0.6).otherwise(1.0)
    score = score * factor(p.rlike(r"^\s*[-*+]\s+") | p.rlike(r"^\s*\d+\.\s+"), 0.5) * factor(share(r"\p{Lu}") > 0.2, 0.7) * factor(share(r"\p{Nd}") > 0.08, 0.7)
    score = score * factor(F.lower(p).rlike(r"(?U)\b(?:ibid|supra|infra|cf|op\.|cit|pp?)\b"), 0.4) * factor(p.rlike(r"\[[0-9,\s]+\]"), 0.5)
    return F.when(n == 0, 0.0).otherwise(score)


def excerpts(docs: DataFrame, budget: int = 6000, least: int = 200, most: int = 1000) -> DataFrame:
    """For each profile, the best paragraph of each document first, then the rest by score, up to `budget` characters.

    The last one is cut to fit. Paragraphs of under `least` characters are none. Of each profile only the first
    budget / least paragraphs in that order can fit, so no task orders more than those.
    """
    p = docs.select("profile", "doc_id", F.posexplode(T.paragraphs("text")).alias("para_no", "paragraph")).where(F.length("paragraph") >= least)
    p = p.select("profile", "doc_id", "para_no", voice_score("paragraph").alias("score"), F.substring("paragraph", 1, budget).alias("paragraph"), F.length("paragraph").alias("size"))
    own = p.groupBy("profile", "doc_id").agg(F.min_by(F.struct("para_no"), F.struct(-F.col("score"), F.col("para_no"))).alias("best"))
    p = p.join(own, ["profile", "doc_id"]).withColumn("turn", (F.col("para_no") != F.col("best.para_no")).cast("int"))
    order = W.partitionBy("profile").orderBy("turn", F.desc("score"), "doc_id", "para_no")
    p = p.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= -(-budget // least) + 1)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("before", before).where(F.col("before") < budget)
    return p.select("profile", "rank", "doc_id", "para_no", F.round("score", 6).alias("score"), F.expr(f"substring(paragraph, 1, {budget} - cast(before as int))").alias("excerpt"))


def batches(docs: DataFrame, budget: int = 4096, base: int = 0) -> DataFrame:
    """Profile, doc_id, tokens, batch: a profile's texts in order of doc_id, as many to a prompt as its budget leaves beside `base`."""
    x = docs.select("profile", "doc_id", T.token_estimate("text").alias("tokens"))
    placed = prefix_sums(x, ["profile"], block_of(docs), ["doc_id"], "tokens")
    return packed(placed, ["profile"], "tokens", max(1, budget - base)).select("profile", "doc_id", "tokens", "batch")


def chunk_bounds(docs: DataFrame, tokens: int = 256, key: str = "doc_id") -> DataFrame:
    """G1: key, chunk, first and last block, chars: Markdown blocks in order, as many to a chunk as four characters a token hold.

    Blocks are joined by blank lines and never cut; one that is larger is a chunk alone, for `chunks` to take apart. The fold over a
    text's blocks stays in its row.
    """
    x = with_blocks(docs.select(key, "text")).select(key, F.transform("blocks", lambda b: F.length(b["text"]).cast("long") + 2).alias("sizes"))
    of = lambda first, last, size: F.struct(first.alias("first"), last.alias("last"), (size - 2).alias("chars"))
    state = lambda at, first, size, done: F.struct(at.alias("at"), first.alias("first"), size.alias("size"), done.alias("done"))
    zero = F.lit(0).cast("long")
    empty = state(zero, zero, zero, F.array().cast("array<struct<first:bigint,last:bigint,chars:bigint>>"))

    def step(s: Column, size: Column) -> Column:
        fits = (s["size"] == 0) | (s["size"] + size <= 4 * tokens + 2)
        more = state(s["at"] + 1, s["first"], s["size"] + size, s["done"])
        return F.when(fits, more).otherwise(state(s["at"] + 1, s["at"], size, F.array_append(s["done"], of(s["first"], s["at"] - 1, s["size"]))))

    chunks = F.aggregate("sizes", empty, step, lambda s: F.when(s["at"] > 0, F.array_append(s["done"], of(s["first"], s["at"] - 1, s["size"]))).otherwise(s["done"]))
    return x.select(key, F.posexplode(chunks).alias("chunk", "x")).select(key, F.col("chunk").cast("long").alias("chunk"), "x.first", "x.last", "x.chars")


def sampled_sentences(docs: DataFrame, parts: int = 24) -> DataFrame:
    """Every n-th sentence of a document, so that about `parts` are taken."""
    s = docs.select("doc_id", T.sentences("text").alias("s")).select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("sent_no", "sentence"))
    return s.where(F.pmod("sent_no", F.greatest(F.lit(1), F.floor(F.col("n") / parts)).cast("int")) == 0).select("doc_id", "sent_no", "sentence")


def extractive_summary(docs: DataFrame, k: int = 2, stop: list[str] | None = None) -> DataFrame:
    """The k sentences with the most frequent terms of their document, in their order."""
    stop = stop or L.STOP_WORDS
    # texts are dealt out once, by document; terms, frequencies and scores stay where their text is
    s = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(T.sentences("text")).alias("sent_no", "sentence"))
    t = s.select("doc_id", "sent_no", F.explode(T.lower_words("sentence")).alias("token")).where(~F.col("token").isin(stop) & (F.length("token") > 2))
    freq = F.count("*").over(W.partitionBy("doc_id", "token"))
    score = t.withColumn("f", freq).groupBy("doc_id", "sent_no").agg(F.sum("f").alias("score"))
    best = W.partitionBy("doc_id").orderBy(F.desc("score"), "sent_no")
    return score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("doc_id", "sent_no", "score", "rank")
