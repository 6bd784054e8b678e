"""Rolling windows of a profile's paragraphs, measured in words, and the spread of what they measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stored import stored
from . import measure as M
from .spans import block_of, chain, prefix_sums, steps

WINDOW, STRIDE, LEAST, MOST = 800, 400, 250, 200
MARKS = {"commas": ",", "semicolons": ";", "colons": ":", "exclamations": "!", "questions": "?", "open": "(", "close": ")", "double": '"', "single": "'", "em_dashes": "—"}


def membership(docs: DataFrame, window: int = WINDOW, stride: int = STRIDE, least: int = LEAST, most: int | None = MOST) -> DataFrame:
    """Profile, window_no, doc_id, para_no of each paragraph of each window.

    A window takes paragraphs until it has `window` words, and the next one starts `stride` words on; a window of fewer than
    `least` words is none, and ends the profile's. At most `most` windows are a feature of the baseline; None takes them all.
    Paragraphs are placed by prefix sums over blocks of documents, starts of windows follow each other as a chain of steps, and
    paragraphs meet the windows that reach over them in buckets of a window's size, so no task reads a profile.
    """
    window, stride, least, most = max(50, window), max(25, stride), max(50, least), most if most is None else max(10, most)
    p = docs.select("profile", "doc_id", F.posexplode(T.paragraphs("text")).alias("para_no", "paragraph"))
    p = stored(p.select("profile", "doc_id", "para_no", T.word_count("paragraph").cast("long").alias("n")).where("n > 0"))
    # the first `most` windows can't reach beyond so many paragraphs of a word or more
    p = stored(prefix_sums(p, ["profile"], block_of(docs), ["doc_id", "para_no"], "n", None if most is None else most * stride + window))
    first = chain(steps(p, ["profile"], stride), ["profile"], most)
    starts = p.join(first.withColumnsRenamed({"profile": "_p", "at": "_at"}), F.col("profile").eqNullSafe(F.col("_p")) & (F.col("at") == F.col("_at"))).select("profile", F.col("k").cast("int").alias("window_no"), F.col("start").alias("begin"))
    reached = F.explode(F.array(F.floor(F.col("begin") / window), F.floor(F.col("begin") / window) + 1)).alias("bucket")
    w = starts.select(F.col("profile").alias("_p"), "window_no", "begin", reached)
    p = p.withColumn("_bucket", F.floor(F.col("start") / window))
    rows = p.join(w, F.col("profile").eqNullSafe(F.col("_p")) & (F.col("_bucket") == F.col("bucket"))).where((F.col("start") >= F.col("begin")) & (F.col("start") < F.col("begin") + window))
    rows = stored(rows.select("profile", "window_no", "doc_id", "para_no", "n"))
    short = rows.groupBy("profile", "window_no").agg(F.sum("n").alias("n")).where(F.col("n") < least).groupBy("profile").agg(F.min("window_no").alias("end"))
    short = short.withColumnRenamed("profile", "_p")
    whole = rows.join(short, F.col("profile").eqNullSafe(F.col("_p")), "left").where("end is null or window_no < end")
    return whole.select("profile", "doc_id", "para_no", "window_no")


def window_texts(docs: DataFrame, **sizes: int) -> DataFrame:
    """profile, window_no, text: a window's paragraphs, joined by blank lines; some `window` words each."""
    p = docs.select("profile", "doc_id", F.posexplode(T.paragraphs("text")).alias("para_no", "paragraph"))
    own = membership(docs, **sizes).join(p, ["profile", "doc_id", "para_no"])
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "para_no", "paragraph")))
    return own.groupBy("profile", "window_no").agg(F.array_join(F.transform(ordered, lambda x: x["paragraph"]), "\n\n").alias("text"))


def _spread(v: str) -> dict[str, Column]:
    n, s = F.size(v), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x * x)
    mean = F.when(n > 0, s / n).otherwise(0.0)
    sd = F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), (n * q - s * s) / (n * n)))).otherwise(0.0)
    return {"mean": mean, "stdev": sd, "burst": F.when(mean > 0, sd / mean).otherwise(0.0)}


def metrics(texts: DataFrame) -> DataFrame:
    """A row for each window with its measures."""
    x = texts.select("profile", "window_no", "text", T.lower_words("text").alias("w"), F.transform(T.sentences("text"), lambda s: T.word_count(s).cast("long")).alias("sl"), F.transform(T.paragraphs("text"), lambda p: F.size(T.sentences(p)).cast("long")).alias("pl"))
    n = F.size("w")
    marks = F.array(*[T.occurrences("text", m).cast("double") for m in MARKS.values()])
    x = x.withColumn("marks", marks).withColumn("two", F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    x = x.withColumn("three", F.zip_with(F.slice("two", 1, F.greatest(n - 2, F.lit(0))), F.slice("w", 3, F.greatest(n - 2, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    s, p = _spread("sl"), _spread("pl")
    again = lambda g: F.when(F.size(g) > 0, 1.0 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0)
    total = F.aggregate("marks", F.lit(0.0), lambda a, v: a + v)
    entropy = F.when(total > 0, -F.aggregate("marks", F.lit(0.0), lambda a, v: a + F.when(v > 0, v / total * F.log2(v / total)).otherwise(0.0))).otherwise(0.0)
    words = F.greatest(n, F.lit(1))
    out = {
        "token_count": n.cast("double"), "type_token_ratio": F.size(F.array_distinct("w")) / words, "avg_word_length": F.aggregate("w", F.lit(0), lambda a, v: a + F.length(v)) / words,
        "sentence_length_mean": s["mean"], "sentence_length_stdev": s["stdev"], "sentence_burstiness": s["burst"],
        "paragraph_length_mean": p["mean"], "paragraph_length_stdev": p["stdev"], "paragraph_burstiness": p["burst"],
        "one_sentence_paragraph_rate": F.size(F.filter("pl", lambda v: v == 1)) / F.greatest(F.size("pl"), F.lit(1)),
        "bigram_repeat_rate": again("two"), "trigram_repeat_rate": again("three"), "punctuation_variety": F.size(F.filter("marks", lambda v: v > 0)).cast("double"), "punctuation_entropy": entropy,
    }
    for i, k in enumerate(MARKS):
        if k in ("commas", "semicolons", "colons", "exclamations", "questions", "em_dashes"):
            out[f"punctuation_{k}_per_1000w"] = F.col("marks")[i] * 1000.0 / words
    out["comma_density_per_100w"] = F.col("marks")[0] * 100.0 / words
    rows = x.select("profile", "window_no", *[c.alias(k) for k, c in out.items()])
    letters = M.entropy(M.char_trigrams(texts.select(F.struct("profile", "window_no").alias("profile"), "text")), exact=True)
    letters = letters.select("profile.profile", "profile.window_no", F.col("entropy").alias("char_trigram_entropy"))
    return rows.join(letters, ["profile", "window_no"], "left").na.fill(0.0)


def baseline_windows(docs: DataFrame, **sizes: int) -> DataFrame:
    return rounded(metrics(window_texts(docs, **sizes)))


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select("profile", "window_no", *[M.r6(F.col(c)).alias(c) for c in rows.columns[2:]])


def baseline_quantiles(docs: DataFrame, **sizes: int) -> DataFrame:
    """The range, mean, deviation and quantiles of each measure over a profile's windows."""
    return quantiles(metrics(window_texts(docs, **sizes)))


def quantiles(rows: DataFrame) -> DataFrame:
    long = rows.unpivot(["profile"], [c for c in rows.columns if c not in ("profile", "window_no")], "metric", "value")
    q = F.percentile("value", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    x = long.groupBy("profile", "metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev"), q.alias("q"), F.count("*").alias("n"))
    return x.select("profile", "metric", *[M.r6(c).alias(c) for c in ("min", "max", "mean", "stdev")], *[M.r6(F.col("q")[i]).alias(f"p{k}") for i, k in enumerate((10, 25, 50, 75, 90))], "n")


def at_quantile(q: Column) -> Column:
    """The value of a row with p10 to p90 at quantile q, by straight lines between them, level beyond."""
    points = [(0.10, "p10"), (0.25, "p25"), (0.50, "p50"), (0.75, "p75"), (0.90, "p90")]
    out = F.when(q <= 0.10, F.col("p10"))
    for (a, x), (b, y) in zip(points, points[1:], strict=False):
        out = out.when(q <= b, F.col(x) + (F.col(y) - F.col(x)) * (q - a) / (b - a))
    return out.otherwise(F.col("p90"))


def overlay(baseline: DataFrame, chunks: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), share: float = 0.1, narrow: float = 0.05, wide: float = 5.0, seed: int = 0) -> DataFrame:
    """For each chunk (profile, chunk_no) and metric a target from the baseline and a band around it.

    The quantile is drawn by the MD5 of seed, chunk and metric, so that the draw doesn't depend on partitioning.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(seed), "chunk_no", "metric")), 1, 8), 16, 10).cast("long") % len(quantiles)
    q = F.element_at(F.array(*map(F.lit, quantiles)), (1 + draw).cast("int"))
    x = chunks.join(baseline, "profile").withColumn("q", q).withColumn("target", at_quantile(F.col("q")))
    band = F.least(F.lit(wide), F.greatest(F.lit(narrow), F.abs("target") * share))
    low, high = F.col("target") - band, F.col("target") + band
    is_rate = F.col("metric").endswith("_rate")
    return x.select("profile", "chunk_no", "metric", "q", "target", F.when(is_rate, F.greatest(F.lit(0.0), low)).otherwise(low).alias("low"), F.when(is_rate, F.least(F.lit(1.0), high)).otherwise(high).alias("high"))


def out_of_band(observed: DataFrame, targets: DataFrame, tolerance: float = 0.1, keys: tuple[str, ...] = ("chunk_no", "metric")) -> DataFrame:
    """Observed metrics (keys, value) beyond the band by more than a share of its width."""
    x = observed.join(targets, list(keys))
    slack = (F.col("high") - F.col("low")) * tolerance
    return x.where((F.col("value") < F.col("low") - slack) | (F.col("value") > F.col("high") + slack)).select(*keys, "value", "low", "high", F.when(F.col("value") < F.col("low"), "raise").otherwise("lower").alias("advice"))


def chunk_factor(sentence_stdev: Column, paragraph_burst: Column, stdev_ref: float = 18.0, burst_ref: float = 0.7, low: float = 0.6, high: float = 1.0) -> Column:
    """C14: smaller chunks, down to low, for text that varies up to twice as much as the references."""
    strain = (F.least(F.lit(2.0), sentence_stdev / stdev_ref) + F.least(F.lit(2.0), paragraph_burst / burst_ref)) / 2
    return F.lit(high) - (high - low) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), strain - 1.0))
