"""Measurements on small texts by hand, and their properties."""

import math
import re
import statistics
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stylemill.functions import text as T
from stylemill.operators import measure as M
from stylemill.operators import profile as P
from stylemill.operators import select, windows


def one(df):
    return df.collect()[0]


def test_tokenisers(spark):
    row = one(spark.sql("SELECT 'One token, two tokens.' a, 'One. Two?' b, 'A\\n\\nB' c").select(T.words("a"), T.sentences("b"), T.paragraphs("c")))
    assert [len(x) for x in row] == [4, 2, 2]
    empty = one(spark.createDataFrame([(None,)], "t string").select(T.words("t"), T.sentences("t"), T.paragraphs("t"), T.word_count("t"), T.token_estimate("t")))
    assert list(empty) == [[], [], [], 0, 1]


def test_normalize(spark):
    s = "---\ntitle: x\n---\nThe ﬁrst exam-\nple.\r\n\r\n\r\n\r\n\r\nEnd ﬂow\n"
    assert one(spark.createDataFrame([(s,)], "t string").select(T.normalize("t")))[0] == "The first example.\n\n\nEnd flow"


def test_citations(spark):
    s = "As said (Smith, 2001) and [3-5] and [^1] it (see Jones 1999) held in (May 2001) (no year) ok."
    assert one(spark.createDataFrame([(s,)], "t string").select(T.strip_citations("t")))[0] == "As said and and it held in (May 2001) (no year) ok."


def test_titles(spark):
    rows = ["<html><title> A\n b </title>", "<h1>C <b>d</b></h1>", "\n# E\nx", "F\n---\n", "plain\ntext", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select(T.title("t")).collect()]
    assert got == ["A b", "C d", "E", "F", None, None]


def test_sentence_statistics(docs):
    d = docs("One two three. Four five! Six?", "Seven eight nine ten.")
    row = one(M.sentence_lengths(d))
    assert (row.mean, row.n) == (2.5, 4) and abs(row.stdev - statistics.pstdev([3, 2, 1, 4])) < 1e-6
    assert abs(sum(r.p for r in M.sentence_histogram(d).collect()) - 1) < 1e-9


def test_markers(docs):
    d = docs("However, we may argue. It is clearly so, and, for example, true. But the button (perhaps) works.")
    stance = {r.category: r.hits for r in M.category_rates(d, {"hedge": ["may", "perhaps"], "booster": ["clearly"], "none": ["zzz"]}).collect()}
    assert stance == {"hedge": 2, "booster": 1, "none": 0}
    moves = one(M.rhetoric_moves(d))
    assert moves.counterpoint_rate > 0 and moves.evidence_rate > 0 and moves.synthesis_rate == 0
    assert [r.phrase for r in M.transition_openers(d).collect()] == ["however"]
    assert one(M.oxford_signal(docs("a, and b and c"))).oxford_signal == 0.5
    assert one(M.contraction_rate(docs("I don't know it's fine"))).hits == 2


def test_spelling_evidence(docs):
    low, high = docs("The colour of it."), docs("color center color theater meter fiber labor honor check " * 2)
    assert (one(M.spelling_variant(low)).variant, one(M.spelling_variant(low)).confidence) == ("unknown", "low")
    assert (one(M.spelling_variant(high)).variant, one(M.spelling_variant(high)).confidence) == ("us", "high")


def test_diversity_and_entropy(docs):
    row = one(M.lexical_diversity(docs("a b a c a b")))
    n = Counter("abacab")
    m2 = sum(v * v for v in n.values())
    assert (row.tokens, row.types) == (6, 3) and abs(row.yule_k - 1e4 * (m2 - 6) / 36) < 1e-6 and abs(row.simpson_d - (m2 - 6) / 30) < 1e-6
    p = [3 / 6, 2 / 6, 1 / 6]
    assert abs(one(M.entropy(M.token_counts(docs("a b a c a b")))).entropy + sum(x * math.log2(x) for x in p)) < 1e-6


def test_ngrams_stay_in_documents(docs):
    got = {r.phrase: r.n for r in M.ngram_counts(docs("red fox runs", "red fox sleeps", "the of fox"), 2).collect()}
    assert got == {"red fox": 2, "fox runs": 1, "fox sleeps": 1}


def test_rare_words_leave_artifacts_out(docs):
    got = {r.token for r in M.rare_words(docs("chairmanchairman xxiii strngthly brambles Whistle the 4th abcdefghabcdefgh")).collect()}
    assert got == {"brambles", "whistle", "strngthly"}


VECTORS = st.lists(st.floats(0, 10), min_size=4, max_size=4)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=VECTORS, b=VECTORS)
def test_divergences(spark, a, b):
    x = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    ab, ba, aa, cos = one(x.select(P.js_divergence(F.col("a"), F.col("b")), P.js_divergence(F.col("b"), F.col("a")), P.js_divergence(F.col("a"), F.col("a")), P.cosine(F.col("a"), F.col("b"))))
    assert 0 <= ab <= 1 and abs(ab - ba) < 1e-9 and abs(aa) < 1e-9 and 0 <= cos <= 1


def brute(texts):
    """What the measurement vectors should hold, in plain Python, for a few of the sections."""
    words = [w.lower() for t in texts for w in re.findall(T.WORD, t)]
    sents = [s for t in texts for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", " ".join(t.split())) if s]
    lens = [len(re.findall(T.WORD, s)) for s in sents]
    bins = [sum(lo <= n <= hi for n in lens) / len(lens) for lo, hi in ((0, 9), (10, 17), (18, 25), (26, 40), (41, 10**9))]
    commas = sum(t.count(",") for t in texts)
    return {"words": len(words), "sentence": bins, "commas": commas / len(words) * 1000, "the": words.count("the") / len(words) * 1000, "mean": statistics.mean(lens), "stdev": statistics.pstdev(lens)}


def test_measurement_vectors(docs):
    texts = ["The fox, the dog. It may rain, however. We ran because it rained, and the sun, too.", "Another text. The end of the road, perhaps, is near for them all today."]
    row, want = one(P.measurements(docs(*texts))), brute(texts)
    assert row.words == want["words"] and all(abs(a - b) < 1e-9 for a, b in zip(row.sentence, want["sentence"], strict=True))
    assert abs(row.punctuation[0] - want["commas"]) < 1e-9 and abs(row.function_words[0] - want["the"]) < 1e-9
    assert abs(row.sentence_mean - want["mean"]) < 1e-9 and abs(row.sentence_stdev - want["stdev"]) < 1e-9
    separate = one(M.syntax_texture(docs(*texts)))
    assert [round(x, 6) for x in row.syntax_texture] == [separate.subordinate_rate, separate.parenthetical_rate, separate.appositive_rate]


def test_compliance_and_similarity(spark, docs):
    a = docs(*["The cat sat on the mat, and the dog, too, may perhaps have slept. It was warm."] * 3, profile="a")
    b = docs(*["Stop! Why? No, never; clearly you must run: go, go, go! (Now.) " * 4] * 3, profile="b")
    m = P.measurements(a.unionByName(b))
    own = m.withColumn("id", F.col("profile"))
    same = {r.id: r for r in P.compliance(own, m).collect()}
    assert all(abs(r.score - 1) < 1e-9 and not r.deltas for r in same.values())
    crossed = P.compliance(own.withColumn("profile", F.when(F.col("id") == "a", "b").otherwise("a")), m).collect()
    assert all(r.score < 0.9 and r.deltas for r in crossed)
    pair = one(P.similarity(m))
    self_pair = one(P.similarity(m.where("profile = 'a'").unionByName(m.where("profile = 'a'").withColumn("profile", F.lit("z")))))
    assert self_pair.similarity >= 0.99 and pair.similarity < self_pair.similarity
    scored = spark.createDataFrame([("x", "a", 1000, 0.9), ("y", "a", 5, 0.9)], "id string, profile string, words long, score double")
    p = {r.id: r for r in P.match_probability(scored).collect()}
    assert p["x"].probability > p["y"].probability and p["y"].high - p["y"].low > 0.9


def test_windows_by_hand(docs):
    paras = [" ".join(f"w{i}x{k}" for k in range(30)) + "." for i in range(12)]
    rows = windows.membership(docs(*paras), window=100, stride=50, least=60, most=50).collect()
    got = {}
    for r in rows:
        got.setdefault(r.window_no, []).append(r.doc_id)
    n, want, start = [30] * 12, {}, 0
    while start < 12:
        end, total = start, 0
        while end < 12 and total < 100:
            total += n[end]
            end += 1
        if total < 60:
            break
        want[len(want)] = list(range(start, end))
        moved = 0
        while start < 12 and moved < 50:
            moved += n[start]
            start += 1
    assert {k: sorted(v) for k, v in got.items()} == want
    q = {r.metric: r for r in windows.baseline_quantiles(docs(*paras), window=100, stride=50, least=60, most=50).collect()}
    assert q["token_count"].max == 120 and q["type_token_ratio"].p50 == 1 and len(q) == 22


def test_quantile_read_back_and_bands(spark):
    base = spark.createDataFrame([("a", "m", 1.0, 2.0, 3.0, 4.0, 5.0)], "profile string, metric string, p10 double, p25 double, p50 double, p75 double, p90 double")
    assert [round(one(base.select(windows.at_quantile(F.lit(q))))[0], 6) for q in (0.0, 0.1, 0.375, 0.9, 1.0)] == [1, 1, 2.5, 5, 5]
    chunks = spark.createDataFrame([("a", i) for i in range(5)], "profile string, chunk_no int")
    rows = windows.overlay(base, chunks).collect()
    assert all(r.low <= r.target <= r.high for r in rows)
    assert sorted(rows) == sorted(windows.overlay(base, chunks.repartition(3)).collect())
    seen = spark.createDataFrame([(0, "m", 99.0)], "chunk_no int, metric string, value double")
    assert one(windows.out_of_band(seen, windows.overlay(base, chunks))).advice == "lower"


def test_excerpts_fit_the_budget(docs):
    clean = "The river ran past the old mill and on to the sea without a sound that night. " * 5
    cited = "See ibid and supra and cf the op. cit pages [1, 2] for more of the same here today. " * 5
    rows = select.excerpts(docs(cited, clean), budget=500).collect()
    assert rows[0].doc_id == 1 and sum(len(r.excerpt) for r in rows) == 500


def test_all_pairs_of_blocks_of_profiles(spark):
    names = [f"p{i:03d}" for i in range(90)]
    pairs = P.all_pairs(spark.createDataFrame([(n,) for n in names], "profile string"), block=8).collect()
    assert len(pairs) == len({(r.a, r.b) for r in pairs}) == 90 * 89 // 2 and all(r.a < r.b for r in pairs)


def test_whole_is_the_sum_of_its_profiles(docs):
    d = docs("The cat may sleep, and it does; we must go.", "Now what? The end of it.").withColumn("profile", F.col("doc_id").cast("string"))
    one = P.measurements(d.withColumn("profile", F.lit("all")), repetition=False).drop("fw").first()
    assert P.vectors(P.whole(P.totals(d)), "fw").select(*one.__fields__).first() == one
