"""Matching the sections of a rewritten text with the original's, and putting back what was lost."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .markdown import heading_rows

RATIO, JACCARD, SHARED, RESTORED = 0.8, 0.35, 4, 20


def title_ratio(a: str, b: str) -> float:
    """J13"""
    return difflib.SequenceMatcher(None, a, b).ratio()


def match(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, start_line (of the original section), out_line (of its counterpart, or null), how.

    Both: doc_id, text. First equal keys of one level, then the most similar title, then the signature that overlaps most
    among the sections not yet matched. A document's sections are a bounded group.
    """
    a = heading_rows(before).select("doc_id", F.struct("key", "level", "start_line", "signature").alias("h"), F.lit(0).alias("side"))
    b = heading_rows(after).select("doc_id", F.struct("key", "level", "start_line", "signature").alias("h"), F.lit(1).alias("side"))

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        old, new = ([h for h in rows[rows["side"] == s]["h"]] for s in (0, 1))
        old.sort(key=lambda h: h["start_line"])
        used, out = set(), []
        for h in old:
            same = [x for x in new if x["level"] == h["level"]]
            exact = [x for x in same if x["key"] == h["key"]]
            near = max(same, key=lambda x: title_ratio(h["key"], x["key"]), default=None)
            if exact:
                hit, how = exact[0], "key"
            elif near is not None and title_ratio(h["key"], near["key"]) >= RATIO:
                hit, how = near, "title"
            else:
                own = set(h["signature"])
                score = lambda x: (len(own & set(x["signature"])) / max(1, len(own | set(x["signature"]))), len(own & set(x["signature"])))  # noqa: B023, E731
                free = [x for x in new if x["start_line"] not in used]
                best = max(free, key=score, default=None)
                hit, how = (best, "signature") if best is not None and score(best)[0] >= JACCARD and score(best)[1] >= SHARED else (None, None)
            if hit is not None:
                used.add(hit["start_line"])
            out.append((rows["doc_id"].iloc[0], h["start_line"], None if hit is None else hit["start_line"], how))
        return pd.DataFrame(out, columns=["doc_id", "start_line", "out_line", "how"]).astype({"out_line": "Int32"})

    return a.unionByName(b).groupBy("doc_id").applyInPandas(pair, "doc_id long, start_line int, out_line int, how string")


def restore(before: DataFrame, after: DataFrame, most: int = RESTORED) -> DataFrame:
    """doc_id, text: the rewritten text with its lost sections before the next section that was found, at most `most`."""
    lost = match(before, after)
    order = W.partitionBy("doc_id").orderBy("start_line")
    anchor = F.first("out_line", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    lost = lost.withColumn("anchor", anchor).where("out_line is null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    blocks = heading_rows(before).select("doc_id", "start_line", "block")
    add = lost.join(blocks, ["doc_id", "start_line"]).select("doc_id", F.struct(F.coalesce("anchor", F.lit(1 << 30)).alias("line"), F.lit(0).alias("k"), F.col("start_line").alias("at"), F.col("block").alias("text")).alias("x"))
    lines = after.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc_id", F.struct("line", F.lit(1).alias("k"), F.lit(0).alias("at"), "text").alias("x"))
    joined = lines.unionByName(add).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return joined.select("doc_id", F.array_join(F.transform("x", lambda x: F.when(x["k"] == 0, F.concat(x["text"], F.lit("\n"))).otherwise(x["text"])), "\n").alias("text"))
