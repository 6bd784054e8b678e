"""Steps that stay in a text's row, against plain loops, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from stylemill.functions import lexicons as L
from stylemill.operators import entities, lines, profile, repeats, select
from stylemill.operators import measure as M


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    parts = ["\n", "\n\n", " \n", "\t\n \n", "  \r\n", " ", "```\n", "```", "~~~\n", "a b.\n", "  Two words.", "\x1c", "x\n", "long line of ten words or so, here it ends.\n"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(300)] + [(300, None), (301, ""), (302, "\x1c")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_lines(rows):
    """The blocks of a text, line by line."""
    out, last = [], None
    for line, fence in rows:
        blank = fence is None and not line.strip(" \t ")
        if not blank:
            if last is None or last[0] != fence:
                out.append((fence is not None, []))
            out[-1][1].append(line)
        last = None if blank else (fence,)
    return [(code, "\n".join(x)) for code, x in out]


def test_blocks_in_the_row(texts):
    want = {}
    for r in lines.lines(texts).where("line is not null").orderBy("doc_id", "line_no").collect():
        want.setdefault(r.doc_id, []).append((r.line, r.fence))
    got = {}
    for r in lines.blocks(texts).orderBy("doc_id", "block_no").collect():
        got.setdefault(r.doc_id, []).append((r.code, r.text))
    assert got == {k: b for k, v in want.items() if (b := by_lines(v))}
    assert exchanges(lines.blocks(texts)) == 0


def test_chunk_bounds_in_the_row(texts):
    sizes = {}
    for r in lines.blocks(texts).orderBy("doc_id", "block_no").collect():
        sizes.setdefault(r.doc_id, []).append(len(r.text) + 2)
    want = []
    for doc, own in sizes.items():
        chunks = []
        for i, n in enumerate(own):
            if chunks and chunks[-1][2] + n <= 4 * 8 + 2:
                chunks[-1][1:] = [i, chunks[-1][2] + n]
            else:
                chunks.append([i, i, n])
        want += [(doc, k, a, b, n - 2) for k, (a, b, n) in enumerate(chunks)]
    got = select.chunk_bounds(texts, tokens=8)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert exchanges(got) == 0


def test_repeats_in_the_row(texts):
    got = repeats.drop_repeated_blocks(texts, least=3)
    assert got.count() == texts.count() and got.where(F.col("doc_id") == 302).first().text == "\x1c"
    assert exchanges(got) == 0


def test_alike_needs_a_piece(spark):
    """The piece that is looked for is there in every pair that edits allow."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a = "".join(rng.choices("abc ", k=rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        rows.append((i, a, "".join(b)))
    x = spark.createDataFrame(rows, "i long, a string, b string")
    e = repeats.edits_allowed(F.col("a"), F.col("b"), 0.8)
    x = x.withColumn("near", F.call_function("levenshtein", "a", "b", e) >= 0).withColumn("got", repeats.alike(F.col("a"), F.col("b"), 0.8))
    assert x.where("near <> got").count() == 0 and 0 < x.where("near").count() < 400
    pair = spark.createDataFrame([("the mill stood by the river", "far fields had every autumn")], "a string, b string")
    assert not pair.select(repeats.shares_piece(F.col("a"), F.col("b"), F.lit(3))).first()[0]


def test_openings_hold_three_words(docs):
    x = docs("One two three four. \"It's\" a''b'c d. ... !? 5 x. İs Kelvin K one. Ka b.", "", None, "?")
    whole, first = ([list(r.w) for r in M._openings(x, f).collect()] for f in (False, True))
    assert first == [w[:3] for w in whole] and len(first) == 3
    assert "regexp_extract_all" not in str(M._openings(x, True).where(F.size("w") > 1)._jdf.queryExecution().optimizedPlan()).split("Generate")[0]


def test_summary_deals_texts_once(docs):
    x = docs("The mill ran. A mill is by the river mill. River and mill and river.", "", None)
    df = select.extractive_summary(x)
    assert [(r.doc_id, r.sent_no, r.score) for r in df.orderBy("doc_id", "rank").collect()] == [(0, 1, 11), (0, 2, 10)]
    assert exchanges(df) == 1


def test_word_use_counts_words_alone(spark, docs):
    x = docs("The mill of the town. And the river!", "of a")
    plan = profile.word_use(x, sentences=True)
    assert set(plan.columns) == {"profile", "words", "fw", *[f"sh{i}" for i in range(5)]}
    r = plan.first()
    assert r.words == 10 and sum(r[f"sh{i}"] for i in range(5)) == 3 and r.fw[L.FUNCTION_WORDS.index("the")] == 3


def test_tokens_are_cut_once_for_each_size(spark):
    """A phrase of one token, its last token and a run at its end are found; no filter cuts tokens again."""
    phrases = spark.createDataFrame([("mill",), ("by the mill",), ("old town hall",), ("town",), ("",), ("!",)], "phrase string")
    names = spark.createDataFrame([("mill",), ("town hall",)], "name string")
    x = entities.holding(phrases, names)
    assert {r.phrase for r in x.collect()} == {"mill", "by the mill", "old town hall"}
    assert str(x._jdf.queryExecution().optimizedPlan()).count("regexp_extract_all") == 3
