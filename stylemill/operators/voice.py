"""Pronouns of a text's voice: which person they are of, which of them are subjects, and phrases that are put into another person.

All of it is expressions of the row: a text becomes an array of words, each judged by itself and its neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Pronouns by person, and the words that tell what a pronoun is in its clause.
PERSONS = {
    "first": "i me my mine myself we us our ours ourselves".split(),
    "second": "you your yours yourself yourselves".split(),
    "third": "he him his himself she her hers herself they them their theirs themselves it its itself".split(),
}
SUBJECTS = "i we you he she they it".split()
OBJECTS = "me us him her them".split()
OPENING_WORDS = "and but or so yet nor that because if when while although though".split()
VERBS = (
    "am is are was were be been being have has had do does did can could will would shall should may might must "
    "help see know tell ask call watch hear find keep give show send bring take leave love hate trust support follow join "
    "thank warn teach remind meet chase save move lead guide blame praise inform"
).split()
NO_VERBS = "a an the this that these those some any each every my your his her our their its".split()
#: Phrases and what stands for them in the voice of a person.
REPHRASED = {
    "first": [("you can see", "I can see"), ("one can see", "I can see"), ("it is possible to see", "I can see"), ("this analysis argues that", "I argue that"), ("this analysis suggests that", "I suggest that")],
    "second": [
        ("I can see", "you can see"), ("we can see", "you can see"), ("one can see", "you can see"), ("it is possible to see", "you can see"),
        ("this analysis argues that", "you can argue that"), ("this analysis suggests that", "you can infer that"),
    ],
    "third": [
        ("you can see", "it is possible to see"), ("you should note", "it is worth noting"), ("you might ask", "one might ask"), ("you may ask", "one may ask"), ("you have to", "it is necessary to"),
        ("you need to", "it is necessary to"), ("we can see", "it is possible to see"), ("we should note", "it is worth noting"), ("I argue that", "this analysis argues that"),
        ("I suggest that", "this analysis suggests that"), ("I think that", "this analysis suggests that"), ("I believe that", "this analysis suggests that"),
    ],
}
WORD = "[A-Za-z]+(?:'[A-Za-z]+)?"
OPENERS = '[,(\\[{"“”]'


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def root(word: Column) -> Column:
    """A word in lower case; of a subject pronoun with a contraction, the pronoun."""
    w = F.lower(word)
    return F.when(F.substring_index(w, "'", 1).isin(SUBJECTS), F.substring_index(w, "'", 1)).otherwise(w)


def person(norm: Column) -> Column:
    out = F.when(norm.isin(PERSONS["first"]), "first")
    return out.when(norm.isin(PERSONS["second"]), "second").when(norm.isin(PERSONS["third"]), "third")


def like_a_verb(w: Column) -> Column:
    """A listed verb, or an ending of one in a word that is no article and no pronoun."""
    ends = w.rlike("(?:ed|ing|en)$") | (w.rlike("s$") & (F.length(w) > 3))
    return F.coalesce(w.isin(VERBS) | (~w.isin(NO_VERBS) & person(w).isNull() & ends), F.lit(False))


def pronouns(text: str | Column, marks: bool = False) -> Column:
    """Array of (word, person, subject) of a text's pronouns in order; of a null text, none.

    A subject pronoun is a subject at the start of a clause or before a verb, an object pronoun only at a start before a verb, `and`
    or `or`. A clause starts with the text and after a conjunction; with `marks` after punctuation too, and neighbours
    beyond the end of a sentence don't count. The tool whose results these are means to look at marks and never sees one, so it's off by default.
    """
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(text, F.lit("")), "[.!?;:]") if marks else F.array(F.coalesce(text, F.lit("")))

    def judged(tokens: Column) -> Column:
        opened = lambda i: (i == 0) | F.get(tokens, i - 1).rlike(f"^{OPENERS}$") if marks else i == 0
        norms = F.transform(tokens, lambda t, i: F.struct(t.alias("word"), root(t).alias("norm"), opened(i).alias("opens")))
        return F.filter(norms, lambda t: t["word"].rlike("^[A-Za-z]")) if marks else norms

    def beside(words: Column) -> Column:
        w = lambda i, by: F.get(words, i + by)

        def one(t: Column, i: Column) -> Column:
            before = F.coalesce(F.lower(F.when(i > 0, w(i, -1)["word"])), F.lit(""))
            return F.struct(t["word"].alias("word"), t["norm"].alias("norm"), (t["opens"] | (i == 0) | before.isin(OPENING_WORDS)).alias("opens"), F.coalesce(w(i, 1)["norm"], F.lit("")).alias("next"))

        return F.filter(F.transform(words, one), lambda t: person(t["norm"]).isNotNull())

    tokens = F.transform(parts, lambda part: _all(part, f"{WORD}|{OPENERS}" if marks else WORD))
    found = F.flatten(F.transform(F.transform(tokens, judged), beside))
    subject = lambda t: (t["norm"].isin(SUBJECTS) & (t["opens"] | like_a_verb(t["next"]))) | (t["norm"].isin(OBJECTS) & t["opens"] & (like_a_verb(t["next"]) | t["next"].isin("and", "or")))
    return F.transform(found, lambda t: F.struct(t["word"].alias("word"), person(t["norm"]).alias("person"), subject(t).alias("subject")))


def _count(found: Column, test) -> Column:
    return F.size(F.filter(found, test))


def voice(docs: DataFrame, mode: str, key: str = "doc_id", marks: bool = False) -> DataFrame:
    """Key, allowed (pronouns of the person `mode`), violations (subjects of other persons) and other (the rest of their pronouns)."""
    x = docs.select(key, pronouns("text", marks).alias("p"))
    off = lambda t: t["person"] != mode
    return x.select(
        key, _count(F.col("p"), lambda t: t["person"] == mode).alias("allowed"), _count(F.col("p"), lambda t: off(t) & t["subject"]).alias("violations"),
        _count(F.col("p"), lambda t: off(t) & ~t["subject"]).alias("other"),
    )


def violations(docs: DataFrame, mode: str, key: str = "doc_id", marks: bool = False) -> DataFrame:
    """C16 by sentence: key, sent_no, sentence, how many subjects of each person and all pronouns that are not of `mode`; sentences with a violation alone."""
    x = docs.select(key, F.posexplode(T.sentences("text")).alias("sent_no", "sentence")).withColumn("p", pronouns("sentence", marks))
    x = x.withColumn("p", F.filter("p", lambda t: t["person"] != mode))
    subjects = lambda who: _count(F.col("p"), lambda t: t["subject"] & (t["person"] == who)).alias(who)
    each = [subjects(who) for who in PERSONS]
    return x.where(F.exists("p", lambda t: t["subject"])).select(key, "sent_no", "sentence", *each, F.transform("p", lambda t: t["word"]).alias("tokens"))


def rephrased(sentence: str | Column, mode: str) -> Column:
    """The first of each listed phrase put into the voice of `mode`, with its capital."""

    def one(t: Column, p: Column) -> Column:
        found = F.call_function("regexp_extract", t, p["at"], F.lit(0))
        new = F.when(found.rlike("^[A-Z]"), F.concat(F.upper(F.substr(p["new"], F.lit(1), F.lit(1))), F.substr(p["new"], F.lit(2), F.length(p["new"])))).otherwise(p["new"])
        start = F.call_function("locate", found, t)
        return F.when(found != "", F.concat(F.substr(t, F.lit(1), start - 1), new, F.substr(t, start + F.length(found), F.length(t)))).otherwise(t)

    pairs = F.array(*[F.struct(F.lit(rf"(?i)\b{old}\b").alias("at"), F.lit(new).alias("new")) for old, new in REPHRASED[mode]])
    return F.aggregate(pairs, F.col(sentence) if isinstance(sentence, str) else sentence, one)


def repaired(docs: DataFrame, mode: str, key: str = "doc_id", marks: bool = False) -> DataFrame:
    """Key, text, repairs: sentences with a violation rephrased, where fewer violations, or as many and more allowed pronouns, come of it.

    A sentence is replaced where it first stands in the text, if it stands there with the same spaces.
    """
    judged = lambda t: F.struct(t.alias("t"), pronouns(t, marks).alias("p"))
    x = docs.select(key, "text", F.transform(T.sentences("text"), lambda s: F.struct(s.alias("old"), rephrased(s, mode).alias("new"))).alias("s"))
    x = x.select(key, "text", F.transform(F.filter("s", lambda s: s["old"] != s["new"]), lambda s: F.struct(judged(s["old"]).alias("old"), judged(s["new"]).alias("new"))).alias("s"))
    bad = lambda p: F.size(F.filter(p, lambda t: (t["person"] != mode) & t["subject"]))
    good = lambda p: F.size(F.filter(p, lambda t: t["person"] == mode))
    better = lambda s: (bad(s["new"]["p"]) < bad(s["old"]["p"])) | ((bad(s["new"]["p"]) == bad(s["old"]["p"])) & (good(s["new"]["p"]) > good(s["old"]["p"])))
    mended = F.filter("s", lambda s: (bad(s["old"]["p"]) > 0) & better(s))

    def put(state: Column, s: Column) -> Column:
        t, old, new = state["text"], s["old"]["t"], s["new"]["t"]
        at = F.call_function("locate", old, t)
        text = F.concat(F.substr(t, F.lit(1), at - 1), new, F.substr(t, at + F.length(old), F.length(t)))
        return F.when(at > 0, F.struct(text.alias("text"), (state["n"] + 1).alias("n"))).otherwise(state)

    done = F.aggregate(mended, F.struct(F.col("text").alias("text"), F.lit(0).alias("n")), put)
    return x.select(key, done.alias("x")).select(key, "x.text", F.col("x.n").alias("repairs"))
