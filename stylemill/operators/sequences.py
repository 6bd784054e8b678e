"""n-grams of a whole corpus: its documents one after the other, ties by what comes first.

An n-gram may begin in one document and end in a later one. Those inside a document are made in its row. For the others, the
first and last n - 1 words of each document are enough: documents with a word are numbered by prefix sums over blocks, each
sends its first words to the n - 1 documents before it, and the n-grams that cross are made where they arrive. What occurs
first is the least of (document, word), so no profile is ever put in order.

Counting takes the hashes of `hashed`, with the least document of each n-gram, a number. Only for those that may be among the
first k are place and words read from that document.

Documents are in order of doc_id; a null doc_id comes first. Ids should be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.stored import stored
from . import measure as M
from .hashed import NO_ID, gram_hashes, gram_places, word_edges
from .spans import block_of, prefix_sums


def _grams(words: Column, n: int, first: int | Column = 0) -> Column:
    """An array of (w: n words, at: where they begin, counted from `first`) of a text's words."""
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words) - (n - 1), F.lit(0))) for k in range(n)]
    rows = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    return F.transform(rows, lambda g, i: F.struct(F.array(*[g[f"w{k}"] for k in range(n)]).alias("w"), (i + first).cast("long").alias("at")))


def edges_of(docs: DataFrame, n: int) -> DataFrame:
    """profile, doc_id, n, head, tail and the block of each document with a word: what `crossing` needs for n-grams of n words or fewer."""
    return stored(word_edges(docs, n - 1).withColumn("block", block_of(docs)))


def crossing(docs: DataFrame, n: int, edges: DataFrame | None = None) -> DataFrame:
    """profile, doc_id, g: the n-grams that begin in a document and end in a later one. edges: of `edges_of`, if there."""
    edges = edges_of(docs, n) if edges is None else edges
    most = F.least(F.size("tail"), F.lit(n - 1))
    edges = edges.withColumns({"head": F.slice("head", 1, n - 1), "tail": F.slice("tail", F.size("tail") - most + 1, most)})
    edges = prefix_sums(edges, ["profile"], F.col("block"), ["doc_id", "head"], "n")
    own = edges.select("profile", "at", F.lit(0).alias("off"), "doc_id", "n", F.col("tail").alias("part"))
    sent = edges.select("profile", "at", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("off"), "head").where("off <= at")
    sent = sent.select("profile", (F.col("at") - F.col("off")).alias("at"), "off", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), F.col("head").alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("off", "part")))  # n of n - 1 words at most
    met = own.unionByName(sent).groupBy("profile", "at").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), parts.alias("parts"))
    after = F.slice(F.flatten(F.transform(F.slice("parts", 2, n), lambda p: p["part"])), 1, n - 1)
    before = F.col("parts")[0]["part"]
    return met.select("profile", "doc_id", F.explode(_grams(F.concat(before, after), n, F.col("n") - F.size(before))).alias("g"))


def corpus_ngrams(docs: DataFrame, n: int, stop: list[str] | None = None) -> DataFrame:
    """Profile, phrase, n, first (doc_id and word) of each n-gram of a profile with fewer than n - 1 stop words."""
    stop = L.STOP_WORDS if stop is None else stop
    inside = docs.select("profile", "doc_id", F.explode(_grams(T.lower_words("text"), n)).alias("g"))
    every = inside.unionByName(crossing(docs, n)).where(F.size(F.filter("g.w", lambda x: x.isin(stop))) < n - 1)
    first = F.min(F.struct("doc_id", F.col("g.at").alias("at"))).alias("first")
    return every.groupBy("profile", F.array_join("g.w", " ").alias("phrase")).agg(F.count("*").alias("n"), first)


def _as_texts(grams: DataFrame) -> DataFrame:
    """Rows of `crossing` as texts of one n-gram each."""
    return grams.select("profile", "doc_id", F.array_join("g.w", " ").alias("text"), F.col("g.at").alias("first"))


def top_corpus_ngrams(docs: DataFrame, n: int, k: int = 30, stop: list[str] | None = None) -> DataFrame:
    """O2: the k most frequent n-grams; of equals, those that occur first."""
    stop = L.STOP_WORDS if stop is None else stop
    across = stored(_as_texts(crossing(docs, n)))
    g = gram_hashes(docs, (n,), stop, ids=True).unionByName(gram_hashes(across, (n,), stop, ids=True))
    g = g.repartition("profile", "a").groupBy("profile", "a", "b").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))
    # of those that equal the k-th in number and document, the places decide
    may = F.rank().over(W.partitionBy("profile").orderBy(F.desc("n"), "doc_id"))
    found = stored(g.withColumn("rank", may).where(F.col("rank") <= k).drop("rank"))
    homes = found.select(F.col("profile").alias("profile_"), F.col("doc_id").alias("doc_id_")).distinct()
    texts = docs.select("profile", "doc_id", "text", F.lit(0).cast("long").alias("first")).unionByName(across)
    home = F.coalesce("doc_id", F.lit(NO_ID))
    texts = texts.join(homes, F.col("profile").eqNullSafe(F.col("profile_")) & (home == F.col("doc_id_")), "left_semi")
    places = gram_places(texts, n, stop).withColumn("doc_id", home).withColumnsRenamed({c: f"{c}_" for c in ("profile", "doc_id", "a", "b")})
    same = [F.col("profile").eqNullSafe(F.col("profile_")), *[F.col(c) == F.col(f"{c}_") for c in ("doc_id", "a", "b")]]
    first = found.join(places, same).groupBy("profile", "a", "b", "n", "doc_id").agg(F.min(F.struct("at", "phrase")).alias("x"))
    return M.top(first.select("profile", "n", "doc_id", "x.*"), k, F.desc("n"), F.asc("doc_id"), F.asc("at")).select("profile", "phrase", "n", "rank")


def corpus_repetition(docs: DataFrame, least: int = 3, stop: list[str] | None = None) -> DataFrame:
    """A23 over the whole corpus: the share of its n-grams that occur at least three times."""
    stop, edges = L.STOP_WORDS if stop is None else stop, edges_of(docs, 3)
    g = gram_hashes(docs, (2, 3), stop)
    for n in (2, 3):
        g = g.unionByName(gram_hashes(_as_texts(crossing(docs, n, edges)), (n,), stop))
    return M.repeat_shares(docs, M.repeats_of(g), least)


def top_openers(docs: DataFrame, k: int = 20, stop: list[str] | None = None) -> DataFrame:
    """The first three (or two) words of sentences, with one stop word at most; of equals, those that occur first."""
    s = docs.select("profile", "doc_id", F.posexplode(T.sentences("text")).alias("at", "sentence"))
    o = s.select("profile", "doc_id", "at", F.slice(T.lower_words("sentence"), 1, 3).alias("o")).where(F.size("o") >= 2)
    o = o.where(F.size(F.filter("o", lambda x: x.isin(stop or L.STOP_WORDS))) <= 1)
    found = o.groupBy("profile", F.array_join("o", " ").alias("phrase")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first"))
    return M.top(found, k, F.desc("n"), F.asc("first")).select("profile", "phrase", "n", "rank")
