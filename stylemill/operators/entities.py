"""Phrases that hold a listed name, and the filter of phrases that look like names or dates.

The list is a table of any size. A bounded number of names, those of the fewest tokens, are looked up within the tasks by two
keys of 64 bits, made of hashes of their tokens in batches, so that a phrase that holds one is settled there. For the others phrases
are cut into runs of as many tokens as names have, and the runs are joined with the names on equality; runs that surely are no
name don't leave their task: bits of the names' hashes, of a bounded number, tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .hashed import BATCH_BYTES, BATCH_TEXTS, mix, tokens_in

# Words that mark a title of persons or a date, and capitalised words that mark no name.
HONORIFICS = "mr mrs ms dr sir madam lord lady duke emir imam saint st president prime minister governor senator rep mp king queen prince princess".split()
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split()
GENERIC = "United States World Bank European Union Congress Parliament".split()
DATES = r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b|\b\d{8}\b"
ORDINAL = r"\b\d{1,2}(?:st|nd|rd|th)\b"
#: Words of 64 bits in the table of `sieve`, which bounds what is broadcast.
SIEVE = 1 << 19
#: Names that tasks hold keys of.
HELD_NAMES = 1 << 21
#: Shares of capitals from which a token alone, or two of them, make a phrase a name.
ALONE, TWO = 0.6, 0.4
_TOKEN = "abcdefghijklmnopqrstuvwxyz0123456789"


def _all(text: str | Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def name_tokens(text: str | Column) -> Column:
    return _all(F.lower(text), "[a-z0-9]++")


def plain_letters(text: str | Column) -> Column:
    """Letters of Latin-1 without their accents, in lower case; a list of names is brought to this form."""
    marked, bare = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(F.lower(text), marked, bare)


def listed_names(entities: DataFrame, column: str = "name") -> DataFrame:
    """name: the tokens of each name, joined by spaces, once; nulls, names without a token and single ones of fewer than 3 letters go."""
    x = entities.select(F.array_join(name_tokens(plain_letters(column)), " ").alias("name")).where((F.length("name") >= 3) | F.col("name").contains(" "))
    return x.where("name <> ''").distinct()


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """_slot, _bits: a bit for each key's hash, in at most SIEVE words, so that what `passes` broadcasts is bounded."""
    slot, bit = _place(*columns)
    return keys.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_bits"))


def _place(*columns: str) -> tuple[Column, Column]:
    h = f"xxhash64(7, {', '.join(columns)})"
    return F.expr(f"pmod({h}, {SIEVE}L)"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({h}, 32), 64L) as int))")


def passes(rows: DataFrame, bits: DataFrame, *columns: str) -> DataFrame:
    """The rows whose key may be one of those of `bits`; the others are none, and need no shuffle in the join that follows."""
    slot, bit = _place(*columns)
    return rows.withColumn("_slot", slot).join(F.broadcast(bits), "_slot").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_slot", "_bits")


def holding(phrases: DataFrame, names: DataFrame, key: str = "phrase") -> DataFrame:
    """The key, each once, of the phrases that hold one of the names (of `listed_names`) as a run of tokens.

    A run is looked up only where its first two tokens (or its single one) may begin a name, by bits that are broadcast; what is
    left is joined. The lengths of names come to the driver: numbers, no more than the longest name has tokens.
    """
    sizes = sorted(r[0] for r in names.select(F.size(F.split("name", " "))).distinct().collect())
    if not sizes:
        return phrases.select(key).limit(0)
    bits = sieve(names.select(F.substring_index("name", " ", 2).alias("begin")), "begin")
    own = list(dict.fromkeys([key, "phrase"]))
    x = phrases.select(*own, name_tokens("phrase").alias("w"))
    # each row has a token and the next one, not all; no filter on the tokens, which would cut them once more
    pairs = F.arrays_zip(F.col("w").alias("one"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))
    starts = x.select(*own, F.posexplode(pairs).alias("i", "x")).select(*own, "i", "x.one", F.concat("x.one", F.lit(" "), "x.next").alias("two"))
    runs = []
    if sizes[0] == 1:
        runs.append(passes(starts.select(key, F.col("one").alias("name")), bits, "name"))
    longer = [n for n in sizes if n > 1]
    if longer:
        more = passes(starts.where("two is not null").select(*own, "i", F.col("two").alias("begin")), bits, "begin").withColumn("w", name_tokens("phrase"))
        fit = F.filter(F.array(*map(F.lit, longer)), lambda n: F.col("i") + n <= F.size("w"))
        runs.append(more.select(key, F.explode(F.transform(fit, lambda n: F.array_join(F.slice("w", F.col("i") + 1, n), " "))).alias("name")))
        runs[-1] = passes(runs[-1], sieve(names, "name"), "name")
    found = runs[0] if len(runs) == 1 else runs[0].unionByName(runs[1])
    return found.distinct().join(names, "name", "left_semi").select(key).distinct()


def _longer(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of runs that are a token longer."""
    return mix((a ^ w) * np.uint64(0x9E3779B97F4A7C15))


def _second(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Another key of the runs of n tokens that begin at these places."""
    b = np.full(len(at), n, np.uint64)
    for k in range(n):
        b = mix((b + h[at + k]) * np.uint64(0xD6E8FEB86659FD93))
    return b


def _name_keys(names: DataFrame) -> DataFrame:
    """a, b, begin: the two keys of each name, and the first key of its first two tokens, null for a name of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _, sizes = tokens_in(batch.column("name"), _TOKEN)
            first = np.cumsum(sizes) - sizes
            a, b, begin = (np.zeros(len(sizes), np.uint64) for _ in range(3))
            for k in range(sizes.max(initial=0)):
                more, own = np.flatnonzero(sizes > k), np.flatnonzero(sizes == k + 1)
                a[more] = _longer(a[more], h[first[more] + k])
                if k == 1:
                    begin[more] = a[more]
                b[own] = _second(h, first[own], k + 1)
            cols = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(begin.view(np.int64), mask=sizes < 2)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "begin"])

    return names.select("name").mapInArrow(run, "a long, b long, begin long")


class Marks:
    """Bits for keys, by which most others are told apart."""

    def __init__(self, keys: np.ndarray):
        width = max(10, (8 * len(keys)).bit_length())
        self.shift, self.there = np.uint64(64 - width), np.zeros(1 << width, bool)
        self.there[keys >> self.shift] = True

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Which of these may be one of them."""
        return np.flatnonzero(self.there[keys >> self.shift])


class HeldNames:
    """Names by their keys. a, b, begin: of `_name_keys`, begin without nulls; sizes: how many tokens names have."""

    def __init__(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray, sizes: list[int]):
        order = np.argsort(a)
        self.a, self.b, self.whole, self.begins = a[order], b[order], Marks(a), Marks(begin)
        self.sizes = sizes

    def within(self, phrases: pa.Array) -> np.ndarray:
        """Whether each of these phrases holds a name."""
        h, own, n = tokens_in(phrases, _TOKEN)
        end = np.cumsum(n)[own]  # of each token's phrase
        found, at, a = np.zeros(len(n), bool), np.arange(len(h)), np.zeros(len(h), np.uint64)
        for k in range(self.sizes[-1] if self.sizes else 0):
            on = np.flatnonzero((at + k < end[at]) & ~found[own[at]])
            if not len(on):
                break
            at = at[on]
            a = _longer(a[on], h[at + k])
            if k == 1:
                on = self.begins.among(a)
                at, a = at[on], a[on]
            if k + 1 in self.sizes:
                on = self.whole.among(a)
                place = np.minimum(np.searchsorted(self.a, a[on]), len(self.a) - 1)
                same = self.a[place] == a[on]
                if same.any():
                    on, place = on[same], place[same]
                    found[own[at[on[self.b[place] == _second(h, at[on], k + 1)]]]] = True
        return found


def split_names(names: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]] | None, DataFrame | None]:
    """What HeldNames takes of the names of the fewest tokens, HELD_NAMES at most, and the other names; None for none.

    How many names have how many tokens comes to the driver: no more numbers than the longest name has tokens.
    """
    size = F.size(F.split("name", " "))
    held, total, counts = [], 0, sorted(tuple(r) for r in names.groupBy(size).count().collect())
    for tokens, n in counts:
        total += n
        if total > HELD_NAMES:
            break
        held.append(tokens)
    most = held[-1] if held else 0
    rest = names.where(size > most) if len(held) < len(counts) else None
    if not held:
        return None, rest
    keys = _name_keys(names.where(size <= most)).toArrow()
    a, b, begin = (keys[c].drop_null().to_numpy().view(np.uint64) for c in ("a", "b", "begin"))
    return (a, b, np.unique(begin), held), rest


def _told(phrases: DataFrame, held: tuple, there: bool, lettered: bool = False) -> DataFrame:
    """The rows whose phrase holds one of the held names, or those of which it does not; lettered: a phrase without a letter of A-Z counts as one without names."""
    shared = phrases.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HeldNames(*shared.value)
        for batch in batches:
            found = known.within(batch.column("phrase"))
            if lettered:
                found &= pc.match_substring_regex(batch.column("phrase"), "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found == there))

    phrases.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_TEXTS))
    phrases.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return phrases.mapInArrow(run, phrases.schema)


def naming(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """As `holding` by phrase, but only phrases that hold none of the names of the fewest tokens are cut into runs for a join."""
    held, rest = split_names(names)
    phrases = phrases.select("phrase")
    if held is None:
        return holding(phrases, names) if rest is not None else phrases.limit(0)
    found = _told(phrases, held, True)
    if rest is not None:
        found = found.unionByName(holding(_told(phrases, held, False), rest))
    return found.distinct()


def without_held(phrases: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose phrase holds none of the names of the fewest tokens, or has no letter, and the names still to be looked for; None for none.

    Nothing is shuffled for it, so it may come before phrases are counted.
    """
    held, rest = split_names(names)
    return (_told(phrases, held, False, lettered=True) if held else phrases), rest


def is_dated(phrase: str | Column) -> Column:
    """A month with a number or an ordinal, or digits in the form of a date."""
    low = F.lower(phrase)
    token = lambda p: low.rlike(f"(?<![a-z0-9])(?:{p})(?![a-z0-9])")
    return (token("|".join(MONTHS)) & (token("[0-9]+") | low.rlike(ORDINAL))) | (low.rlike("[0-9]") & low.rlike(DATES))


def is_titled(phrase: str | Column) -> Column:
    """A title of persons, two capitalised words, or one that is no generic word."""
    p = F.col(phrase) if isinstance(phrase, str) else phrase
    w = _all(p, "[A-Za-z][A-Za-z'-]*")
    caps = F.filter(w, lambda t: t.rlike("^[A-Z]"))
    named = (F.size(caps) >= 2) | ((F.size(caps) == 1) & ~F.get(caps, F.lit(0)).isin(GENERIC))
    titled = F.exists(w, lambda t: F.lower(t).isin(HONORIFICS))
    # words are cut only where a pattern leaves the question open
    may = p.rlike(f"(?i)(?<![A-Za-z])(?:{'|'.join(HONORIFICS)})(?![A-Za-z'-])")
    return F.when(may, titled).otherwise(False) | F.when(p.rlike("[A-Z]"), named).otherwise(False)


def drop_names(phrases: DataFrame, ratios: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Phrases (profile, phrase, ...) without those that look like names, titles or dates, or hold a listed name.

    ratios: capitalisation of the profile's tokens (measure.capitalisation). entities: names, one a row; those that hold one of the names
    of the fewest tokens go first, in their tasks. A phrase without a letter
    of A-Z stays; null phrases go. Phrases that occur in several rows stay or go together within a profile. The rows are stored
    with a number, so that what is looked up carries the number and no phrase.
    """
    lettered = F.col("phrase").rlike("[A-Za-z]")
    kept = phrases.where(F.col("phrase").isNotNull() & (~lettered | ~(is_dated("phrase") | is_titled("phrase"))))
    if entities is None and ratios is None:
        return kept
    rest = None
    if entities is not None:
        kept, rest = without_held(kept, stored(listed_names(entities, entities.columns[0])))
        if rest is None and ratios is None:
            return kept
    kept = stored(kept.withColumn("_row", F.monotonically_increasing_id()))
    gone = []
    if rest is not None:
        gone.append(holding(kept.where(lettered), rest, "_row"))
    if ratios is not None:
        high = stored(ratios.select("profile", "token", "cap_ratio").where(F.col("cap_ratio") >= TWO))
        t = kept.select("_row", "profile", F.explode(_all(F.lower("phrase"), "[a-z][a-z'-]*")).alias("token"))
        t = passes(t, sieve(high, "profile", "token"), "profile", "token").join(high, ["profile", "token"])
        named = t.groupBy("_row").agg(F.max("cap_ratio").alias("m"), F.count("*").alias("n")).where((F.col("m") >= ALONE) | (F.col("n") >= 2))
        gone.append(named.select("_row"))
    for g in gone:
        kept = kept.join(g, "_row", "left_anti")
    return kept.select(phrases.columns)
