"""Phrases that hold names, against sets of runs; the rules on titles and dates one by one."""

import random
import re

from pyspark.sql import functions as F

from stylemill.operators import entities as E
from stylemill.operators import measure as M
from stylemill.plans import catalogue


def rows(spark, *phrases):
    return spark.createDataFrame([(p,) for p in phrases], "phrase string")


def test_runs_of_tokens(spark):
    rng = random.Random(5)
    letters = "ab cd ef gh ij12".split()
    names = [" ".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(12)] + [None, "", "x", "!!"]
    phrases = [rng.choice([" ", ", "]).join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(300)] + ["x", "AB", None]
    listed = E.listed_names(spark.createDataFrame([(n,) for n in names], "name string"))
    known = {n for n in names if n and n not in ("x", "!!") and (" " in n or len(n) >= 3)}
    assert {r.name for r in listed.collect()} == known

    def holds(p):
        w = (p or "").lower().replace(",", "").split()
        return any(" ".join(w[i:j]) in known for i in range(len(w)) for j in range(i + 1, len(w) + 1))

    assert sorted(r.phrase for r in E.holding(rows(spark, *phrases, *phrases), listed).collect()) == sorted({p for p in phrases if holds(p)})
    assert E.holding(rows(spark, "ab"), listed.limit(0)).count() == 0 and E.holding(rows(spark).limit(0), listed).count() == 0


def test_accents_of_names(spark):
    listed = E.listed_names(spark.createDataFrame([("São Tomé",), ("são tome",)], "name string"))
    assert [r.name for r in listed.collect()] == ["sao tome"]
    assert [r.phrase for r in E.holding(rows(spark, "of sao tome.", "sao to me"), listed).collect()] == ["of sao tome."]


def test_dates_and_titles(spark):
    dated = ["may 4", "in march 1990", "the 3rd of june", "2020-01-31", "at 1.2.2003", "on 20200131 then"]
    plain = ["it may be", "march on", "the 3rd man", "room 12", "1-2", "120200131"]
    got = {r.phrase: r.d for r in rows(spark, *dated, *plain).select("phrase", E.is_dated("phrase").alias("d")).collect()}
    assert got == dict.fromkeys(dated, True) | dict.fromkeys(plain, False)
    titled = ["the prime cause", "dr who", "Anna met Bell", "saw Anna"]
    plain = ["the World stage", "old mill", "drought"]
    got = {r.phrase: r.d for r in rows(spark, *titled, *plain).select("phrase", E.is_titled("phrase").alias("d")).collect()}
    assert got == dict.fromkeys(titled, True) | dict.fromkeys(plain, False)


def test_phrase_filter(docs, spark):
    d = docs("Anna Bell met Anna Bell in March. The old mill stood. the old mill fell.")
    said = ["anna bell", "old mill", "in march", "mill stood", "the mill", "the the", "12 34", "2020-01-31", "may 4 mill", None, "old mill"]
    phrases = spark.createDataFrame([("a", p, i) for i, p in enumerate(said)], "profile string, phrase string, name long")
    names = spark.createDataFrame([("Mill Stood!",)], "any string")
    kept = E.drop_names(phrases, M.capitalisation(d), names)
    # `the` has capitals in half of its places: once it is no name, twice it is
    assert kept.columns == phrases.columns and sorted(r.phrase for r in kept.collect()) == ["12 34", "2020-01-31", "old mill", "old mill", "the mill"]
    assert E.drop_names(phrases).where(F.col("phrase") == "mill stood").count() == 1


def test_runs_that_are_no_name_stay_where_they_are(spark):
    """Phrases of 60 tokens against names of 1 to 9: what is shuffled follows the runs that may be names, not all runs."""
    names = [" ".join(f"n{i}x{j}" for j in range(i)) for i in range(1, 10)]
    x = spark.range(2000).selectExpr("concat_ws(' ', transform(sequence(1, 60), k -> concat('w', id, 'y', k))) as phrase", "id as n", "'a' as profile")
    named = spark.createDataFrame([(f"the {n} is", 1, "a") for n in names], "phrase string, n long, profile string")
    listed = E.listed_names(spark.createDataFrame([(n,) for n in names], "name string"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sieve", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a long list
    try:
        found = [r.phrase for r in E.holding(x.unionByName(named), listed).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found) == sorted(f"the {n} is" for n in names)
    store, written = spark.sparkContext._jsc.sc().statusStore(), 0
    for job in tracker.getJobIdsForGroup("sieve"):
        for stage in tracker.getJobInfo(job).stageIds:
            written += store.lastStageAttempt(stage).shuffleWriteRecords()
    assert 0 < written < 10_000  # all runs of 1 to 9 tokens are a million


def test_names_held_by_tasks_and_others(spark, monkeypatch):
    """As runs of tokens say, whether all names are held by the tasks, those of the fewest tokens, or none."""
    rng = random.Random(6)
    letters = ["ab", "cd", "ef", "abcdefgh", "abcdefghi", "abcdefghabcdefghi", "K1", "i12"]
    names = [" ".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(12)] + ["K1 ab"]
    phrases = [rng.choice([" ", "é", "\n", "."]).join(rng.choices([*letters, "AB", "K1", "İ1"], k=rng.randint(0, 7))) for _ in range(400)] + ["", None]
    listed = E.listed_names(spark.createDataFrame([(n,) for n in names], "name string"))
    known = {r.name for r in listed.collect()}

    def holds(p):
        w = re.findall("[a-z0-9]+", (p or "").lower())
        return any(" ".join(w[i:j]) in known for i in range(len(w)) for j in range(i + 1, len(w) + 1))

    want = sorted({p for p in phrases if holds(p)})
    sizes = sorted(len(n.split()) for n in known)
    for most in (len(known), sizes.count(1) + sizes.count(2), 0):
        monkeypatch.setattr(E, "HELD_NAMES", most)
        assert sorted(r.phrase for r in E.naming(rows(spark, *phrases, *phrases).repartition(3), listed).collect()) == want
    assert E.naming(rows(spark, "ab"), listed.limit(0)).count() == 0


def shuffled(spark, run):
    """Rows that a run writes for shuffles, without broadcast joins, as for long lists."""
    tracker, store, group = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), f"rows{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return out, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_a_phrase_with_many_names_is_shuffled_once(spark, tmp_path):
    """500 clauses that hold 30 names each: a row for each, not one for each name in it."""
    names = [f"name{i}" for i in range(30)]
    texts = [(i, "a", ". ".join(f"{' '.join(names)} clause{i}x{j}" for j in range(5))) for i in range(100)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"<title>{n}</title>") for i, n in enumerate(names)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found, n = shuffled(spark, lambda: catalogue.named_phrases(spark, str(tmp_path)).collect())
    assert len({r.phrase for r in found}) == len(found) == 500
    assert n < 1500  # with each name 15,000


def test_names_are_dropped_whether_held_or_not(docs, spark, monkeypatch):
    d = docs("Anna Bell met Anna Bell in March. The old mill stood. the old mill fell.")
    said = ["anna bell", "old mill", "mill stood", "a by mill stood x", "of wood", "the mill", "12 34", "12 34 wood", None, "old mill"]
    phrases = spark.createDataFrame([("a", p, i) for i, p in enumerate(said)], "profile string, phrase string, name long")
    names = spark.createDataFrame([("Mill Stood!",), ("wood",), ("12 34",)], "any string")
    for most in (3, 1, 0):
        monkeypatch.setattr(E, "HELD_NAMES", most)
        kept = E.drop_names(phrases, M.capitalisation(d), names)
        assert kept.columns == phrases.columns and sorted(r.phrase for r in kept.collect()) == ["12 34", "old mill", "old mill", "the mill"]
        kept = E.drop_names(phrases, None, names)
        assert sorted(r.phrase for r in kept.collect()) == ["12 34", "anna bell", "old mill", "old mill", "the mill"]


def test_clauses_with_names_are_not_shuffled_to_be_counted(spark, tmp_path):
    """500 clauses that hold a name, and one that holds none: what is shuffled doesn't follow the 500."""
    texts = [(i, "a", ". ".join(f"of mill {i}x{j}" for j in range(5)) + ". by the by") for i in range(100)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<title>Mill</title>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found, n = shuffled(spark, lambda: catalogue.unnamed_phrases(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in found] == [("a", "by the by", 100)]
    assert n < 200
