"""Scores, diagnostics and the entry points."""

from stylemill.operators import scores
from stylemill.plans import api

PROSE = ["The cat sat on the mat, and the dog slept. It was warm; nobody knew why! Then the rain came down on the old mill for a week.", "A short one. And a somewhat longer sentence follows here, with commas, to vary the pace."]


def test_naturalness(docs):
    row = scores.naturalness(docs(*PROSE)).first()
    values = [row[c] for c in row.__fields__ if c.startswith("score_")]
    assert len(values) == 16 and all(0 <= v <= 1 for v in values) and abs(row.aggregate_100 - sum(values) / 16 * 100) < 0.01
    assert row.score_function_word_kl_inverse > 0.999 and row.score_sentence_length_js_inverse > 0.999
    only = scores.naturalness(docs(*PROSE), {c[6:]: 0 for c in row.__fields__ if c.startswith("score_") and c != "score_herdan_c"}).first()
    assert abs(only.aggregate_100 - only.score_herdan_c * 100) < 0.01


def test_markdown_style(docs):
    d = docs("# A Title Here\n## not in title case\ntext with **bold** words\n- **Label:** item\n- plain\n```\n# code\n```")
    row = scores.markdown_style(d).first()
    assert (row.title_case_rate, row.label_rate) == (0.5, 0.5) and row.bold_per_1000w > 0
    assert scores.markdown_style(d, corrected=False).first().label_rate == 0


def test_changes_and_diagnostics(docs, spark):
    before, after = docs("one two three four\n\nfive"), docs("one two three")
    row = scores.changes(before, after).first()
    assert row.words_pct == -40 and set(row.warnings) == {"lines", "words", "paragraphs"}
    rows = scores.diagnostics(docs("red fox " * 4 + "ran. " + "word " * 25 + ".")).collect()
    assert [(r.kind, r.text) for r in rows if r.kind == "bigram"][:2] == [("bigram", "word word"), ("bigram", "red fox")]
    lex = spark.createDataFrame([(["a"], ["b", "c"])], "avoid_words array<string>, avoid_words_soft array<string>")
    assert list(scores.merge_avoid_list(lex, ["b", "a"]).first()) == [["a", "b"], ["c"]]


def test_entry_points(docs, spark, tmp_path):
    made = api.make(docs(*PROSE), str(tmp_path / "store"))
    guid = made.first().id
    assert api.get(spark, str(tmp_path / "store"), guid).count() == 1
    texts = spark.createDataFrame([("x", "a", PROSE[0]), ("y", "a", "No! Stop? Why: because; never (ever) - go.")], "id string, profile string, text string")
    got = {r.id: r for r in api.rate(texts, made).collect()}
    assert got["x"].score > got["y"].score and got["y"].deltas and 0 <= got["x"].probability <= 1
    out, changed = api.apply(docs("# big Title\n\nThe color — “so” `color`."), api.Rules(locale="british", heading_styles={1: "title"}))
    assert out.first().text == '# Big Title\n\nThe colour - "so" `color`.' and changed.count() == 1
