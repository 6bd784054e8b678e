"""Prose blocks that nearly repeat one of the last blocks kept.

Whether a block goes depends on which blocks before it were kept, so the rule is a fold over a text's blocks in their order: its
state is the keys of the last blocks kept and the numbers of those dropped. The fold is an expression, its work a bounded number of
comparisons for each block, and a text's blocks meet in one row, as they were in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import lines

#: Fixed patterns: code, links and addresses, which a block's key leaves out.
UNKEYED = (r"`[^`]*`", r"\[[^\]]+\]\([^)]+\)", r"(?U)https?://\S+", r"(?U)[^a-zA-Z0-9\s]")


def prose_key(block: str | Column) -> Column:
    """A block's letters and digits in lower case, words parted by one space."""
    t = block
    for pattern in UNKEYED:
        t = F.regexp_replace(t, pattern, " ")
    return F.lower(T.squeeze(t))


def edits_allowed(a: Column, b: Column, ratio: float) -> Column:
    """How many edits leave two keys alike: with e edits, of which the difference of lengths d are insertions, 2e - d characters
    of both together have no partner; ratio is the share that has one."""
    return F.floor(((F.length(a) + F.length(b)) * (1.0 - ratio) + F.abs(F.length(a) - F.length(b))) / 2.0 + 1e-9).cast("int")


def shares_piece(a: Column, b: Column, edits: Column) -> Column:
    """Holds for all keys that so many edits make alike: of as many pieces of a and one more, edits leave one whole, and move it no further.

    It costs a small part of the edits' count and holds for few others.
    """

    def found(x: Column, i: Column) -> Column:
        at = i * x["w"] + 1
        low = F.greatest(F.lit(1), at - x["e"])
        return F.contains(F.substring(b, low, at + x["e"] + x["w"] - low), F.substring(a, at, x["w"]))

    size = F.struct(edits.alias("e"), F.floor(F.length(a) / (edits + 1)).cast("int").alias("w"))
    return F.exists(F.array(size), lambda x: F.exists(F.sequence(F.lit(0), x["e"]), lambda i: found(x, i)))


def alike(a: Column, b: Column, ratio: float) -> Column:
    # arrays of one element hold what is used several times
    near = lambda e: (F.abs(F.length(a) - F.length(b)) <= e) & shares_piece(a, b, e) & (F.call_function("levenshtein", a, b, e) >= 0)
    return (a == b) | F.exists(F.array(edits_allowed(a, b, ratio)), near)


def is_prose(block: Column, least: int) -> Column:
    """Of a block of `lines.with_blocks`: running text of `least` words or more with the end of a sentence; no heading, list, table or code."""
    t = block["text"]
    return ~block["code"] & ~t.rlike(r"(?U)\A\s*#{1,8}\s") & ~t.rlike(r"(?mU)^\s*(?:[-*+]\s|\d+[.)]\s|\|)") & (T.word_count(t) >= least) & t.rlike("[.!?]")


def repeated_blocks(docs: DataFrame, key: str = "doc_id", ratio: float = 0.985, lookback: int = 20, share: float = 0.15, least: int = 30) -> DataFrame:
    """A row a text that has blocks: key, blocks (block_no, text, in order) and dropped (the numbers of those that repeat).

    A block goes if it is prose and its key is that of one of the last `lookback` blocks kept, or alike by `ratio`; no more than
    that share of a text's blocks goes, or one. Blocks without a key are kept and not looked back at.
    """
    return _folded(docs, key, ratio, lookback, share, least).where(F.size("blocks") > 0).drop("text")


def _folded(docs: DataFrame, key: str, ratio: float = 0.985, lookback: int = 20, share: float = 0.15, least: int = 30) -> DataFrame:
    """key, text, blocks and dropped of every text."""
    x = lines.with_blocks(docs.select(key, "text")).withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<code:boolean,text:string>>")))
    keyed = F.transform("blocks", lambda b, i: F.struct(i.alias("block_no"), b["text"].alias("text"), prose_key(b["text"]).alias("k"), is_prose(b, least).alias("prose")))
    x = x.select(key, "text", keyed.alias("b"))
    most = F.greatest(F.lit(1), F.floor(F.size("b") * F.lit(share) + 1e-9)).cast("int")
    empty = F.struct(F.array().cast("array<string>").alias("recent"), F.array().cast("array<int>").alias("dropped"))

    def step(s: Column, b: Column) -> Column:
        repeats = b["prose"] & (b["k"] != "") & (F.size(s["dropped"]) < most) & F.exists(s["recent"], lambda r: alike(r, b["k"], ratio))
        last = F.slice(F.array_append(s["recent"], b["k"]), F.greatest(F.lit(1), F.size(s["recent"]) + 2 - lookback), lookback)
        kept = F.struct(F.when(b["k"] == "", s["recent"]).otherwise(last).alias("recent"), s["dropped"].alias("dropped"))
        return F.when(repeats, F.struct(s["recent"].alias("recent"), F.array_append(s["dropped"], b["block_no"]).alias("dropped"))).otherwise(kept)

    blocks = F.transform("b", lambda b: F.struct(b["block_no"].alias("block_no"), b["text"].alias("text")))
    return x.select(key, "text", blocks.alias("blocks"), F.aggregate("b", empty, step, lambda s: s["dropped"]).alias("dropped"))


def drop_repeated_blocks(docs: DataFrame, key: str = "doc_id", **rule: float) -> DataFrame:
    """Key, text of the blocks that stay, parted by blank lines, and dropped: how many went. rule: of `repeated_blocks`.

    key must be unique. Texts without a block come back as they are, null ones too.
    """
    x = _folded(docs, key, **rule)
    kept = F.filter("blocks", lambda b: ~F.array_contains("dropped", b["block_no"]))
    text = F.array_join(F.transform(kept, lambda b: F.regexp_replace(b["text"], r"(?U)\A\s+|\s+\z", "")), "\n\n")
    return x.select(key, F.when(F.size("blocks") > 0, text).otherwise(F.col("text")).alias("text"), F.size("dropped").alias("dropped"))
