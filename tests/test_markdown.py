"""Markdown structure, masks, chunks, rewriting, sections, sources and streams."""

import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from stylemill.operators import markdown as md
from stylemill.operators import rewrite as rw
from stylemill.operators import sections
from stylemill.sources import completions, files
from stylemill.streaming import drift

PAGE = """# Title

Prose with `code` and <b>bold</b> &amp; more (Smith, 2001), as "two words" say.

> a quotation
> goes on

```
x = 1

y = 2
```

[^1]: a note
    and more of it

## References

Jones 1999

## After

Last words \\(x+1\\).
"""


def test_voice_filter(spark):
    d = spark.createDataFrame([(PAGE,), (None,)], "t string")
    text, null = [r[0] for r in d.select(md.voice_filter("t")).collect()]
    assert null is None and "Prose with" in text and "Last words" in text
    assert not any(x in text for x in ("code", "quotation", "x = 1", "note", "Jones", "Smith", "two words", "&amp;", "x+1"))
    assert "two words" in d.select(md.voice_filter("t", quotes=False)).first()[0]
    assert "Prose" in d.select(md.chunk_filter("t")).first()[0]


def test_fences():
    assert md.without_fences("a\n```\nb\n~~~\nc\n```\nd") == "a\nd"
    assert md.without_fences("a\n~~~\nb") == "a"
    assert md.without_boilerplate("Copyright 2020\n\nText") == "Text"


def test_blocks_and_headings():
    blocks = md.split_blocks(PAGE)
    assert any(b.startswith("```") and "y = 2" in b for b in blocks) and "# Title" in blocks
    heads = md.heading_blocks(PAGE)
    assert [(h["level"], h["key"]) for h in heads] == [(1, "title"), (2, "references"), (2, "after")]
    assert md.heading_at(["A", "==="], 0) == (1, "A", 2) and md.heading_at(["plain", "text"], 0) is None


@pytest.mark.parametrize("tokens", [8, 20, 60, 1000])
def test_chunks_keep_the_words_and_the_bound(tokens):
    text = PAGE + "\n\n" + "Many words here. " * 100 + "\n\n- item one\n- item two\n"
    parts = md.chunks(text, tokens)
    words = lambda t: [w for w in t.split() if w != "```"]
    assert words(" ".join(parts)) == words(text) and all(p.strip() for p in parts)
    assert all(len(p) <= 4 * tokens or " " not in p or p.startswith("```") for p in parts)
    assert all(p.count("```") % 2 == 0 for p in parts)
    assert len(md.at_least(parts, len(parts) + 2)) >= len(parts)


def test_paragraph_chunks_and_recovery():
    assert md.paragraph_chunks("a b\n\nc d\n\ne", 3) == ["a b", "c d\n\ne"]
    two = md.recovery_split("line of text\n" * 100)
    assert len(two) == 2 and md.recovery_split("short") == ["short"]


def test_masks_round_trip(spark):
    d = spark.createDataFrame([(PAGE,), ("a <10 b",), ("",)], "t string").select("t", md.mask("t").alias("m"))
    rows = d.select("t", "m.text", "m.originals", md.restore("m.text", "m.originals").alias("back")).collect()
    assert all(r.back == r.t for r in rows) and rows[1].originals == {}
    assert {k[2:].rsplit("_", 1)[0] for k in rows[0].originals} >= {"FROZEN_BLOCK", "HTML", "MATH", "ENTITY", "INLINE_CODE", "QUOTE", "CITATION"}
    lost = d.limit(1).select(md.missing(F.lit("nothing"), "m.originals").alias("x"), md.repair(F.lit("nothing"), "m.originals").alias("y")).first()
    assert lost.x and not any("QUOTE" in k for k in lost.x) and all(k in lost.y for k in lost.x)


def test_marks(spark):
    row = spark.sql("SELECT 'a — b—c' d, '“x” ‘y’' q, 'hi 😀 there' e").select(rw.plain_dashes("d"), rw.dash_count("d"), rw.straight_quotes("q"), rw.replace_emoji("e"), rw.replace_emoji("e", {"😀": "smile"}, "replace")).first()
    assert list(row) == ["a - b - c", 2, "\"x\" 'y'", "hi there", "hi smile there"]


def test_heading_rewrites():
    assert rw.plain_heading("## Data model (why it matters)") == "## Data model"
    assert rw.plain_heading("## Data, how we got 3 of it") == "## Data, how we got 3 of it"
    assert rw.cased("the rise of NASA and men", "title", ("NASA",)) == "The Rise of NASA and Men"
    assert rw.cased("The Rise Of Men", "sentence") == "The rise of men" and rw.cased("a b", "caps") == "A B"
    assert rw.headings("# big TITLE\n```\n# code\n```", {1: "lower"}) == "# big title\n```\n# code\n```"


def test_spelling():
    assert rw.local_spelling("The Color of traveled TIRES", "british") == "The Colour of travelled TIRES"
    assert rw.local_spelling("We practice; the practice colors", "british") == "We practise; the practice colours"
    assert rw.local_spelling("colours organised", "us") == "colors organized"
    assert rw.local_spelling("see http://color.org/center and my_color", "british") == "see http://color.org/center and my_color"
    assert rw.guarded_spelling('`color` "big color" color', "british") == '`color` "big color" colour'


def test_near_duplicate_prose():
    p = "Every morning the same long grey train went by the house on the hill and " * 3
    text, n = rw.drop_near_duplicates(f"{p}one.\n\n{p}one!\n\n- {p}\n\n- {p}")
    assert n == 1 and text.count("one") == 1
    assert rw.drop_near_duplicates("- a\n\n- a\n\nshort\n\nshort")[1] == 0


def test_list_density():
    items = "\n".join(f"- item {i}." for i in range(8))
    out = rw.group_lists(f"x\n{items}\ny")
    assert out.count("\n- ") == 4 and "item 0; item 1." in out and rw.group_lists("- a\n- b") == "- a\n- b"


def test_pronouns_json_summaries():
    assert json.loads(rw.first_json('```json\nSure: {"a": "}", "b": [1]} ok\n```')) == {"a": "}", "b": [1]}
    assert rw.first_json("none") is None and rw.past_summary("This section shows a b", 5) == "the previous passage shows a"
    assert rw.case_like("Word", "term") == "Term" and rw.case_like("WORD", "term") == "TERM"


def test_sections(spark):
    before = spark.createDataFrame([(1, "# One\nalpha beta gamma delta\n# Two\nlost section here\n# Three\nlast")], "doc_id long, text string")
    after = spark.createDataFrame([(1, "# One\nnew\n# Threes\nlast")], "doc_id long, text string")
    got = {r.start_line: (r.out_line, r.how) for r in sections.match(before, after).collect()}
    assert got == {0: (0, "key"), 2: (None, None), 4: (2, "title")}
    text = sections.restore(before, after).first().text
    assert text.index("# One") < text.index("lost section here") < text.index("# Threes")


def test_sources(spark, tmp_path):
    long = "A sentence of prose that goes on. " * 10
    (tmp_path / "a.txt").write_bytes(("café " + long).encode("cp1252"))
    (tmp_path / "b.bin").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x/d.md", long)
        z.writestr("e.md", "short")
        z.writestr("f.docx", "broken")
    (tmp_path / "g.md").write_text(long)
    with tarfile.open(tmp_path / "h.tar.gz", "w:gz") as t:
        t.add(tmp_path / "g.md", "g.md")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    rows = files.read_corpus(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[-1] for r in rows] == ["a.txt", "d.md", "g.md", "h.tar.gz!g.md"] and rows[0].text.startswith("café")
    with pytest.raises(ValueError):
        list(files.members("x.rar", b""))
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "l.txt").write_text("# c\nword 3.5\nword 2\nÉlan Vital # x\n\nab\n")
    assert {(r.word, r.zipf) for r in files.read_common_words(spark, str(tmp_path / "list")).collect()} == {("word", 3.5), ("élan", None), ("ab", None)}
    assert {r.name for r in files.read_entities(spark, str(tmp_path / "list")).collect()} == {"word 3 5", "word 2", "elan vital"}


def test_store(spark, tmp_path):
    guid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    files.save_profiles(spark.createDataFrame([(guid, 1.5)], "id string, x double"), str(tmp_path / "s"))
    assert files.load_profile(spark, str(tmp_path / "s"), guid).first().x == 1.5
    with pytest.raises(ValueError):
        files.load_profile(spark, str(tmp_path / "s"), "../x")
    files.write_results(spark.createDataFrame([(1, "t")], "doc_id long, text string"), spark.createDataFrame([(1, "r")], "doc_id long, rule string"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o/deviations")).count() == 1


def test_completions(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    assert {r.reply for r in completions.complete(prompts, lambda: str.upper).collect()} == {"A", "B"}
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return p

    assert completions.with_retries(flaky, "x", base=0.0) == "x" and len(calls) == 3


def test_drift(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", "One, two. Three four."), ("a", "2024-01-01 00:50:00", "Five."), ("a", "2024-01-01 02:00:00", "Late one.")], "profile string, ts string, text string")
    rows.select("profile", F.to_timestamp("ts").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("profile string, ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = drift.drift(stream).writeStream.format("memory").queryName("drift_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.start): (r.texts, r.words, r.sentences, r.comma_rate) for r in spark.table("drift_test").collect()}
    assert got == {"2024-01-01 00:00:00": (2, 5, 3, 0.2), "2024-01-01 02:00:00": (1, 2, 1, 0)}


def test_masks_leave_placeholders_of_the_text_alone(spark):
    text = "see [[HTML_1]] and <b>bold</b>, [[HTML_7]] or `x` and [[INLINE_CODE_2]]"
    x = spark.createDataFrame([(text,)], "t string").select("t", md.mask("t").alias("m"))
    r = x.select("m", md.restore("m.text", "m.originals").alias("back")).first()
    assert r.back == text and r.m.originals == {"[[HTML_8]]": "<b>", "[[HTML_9]]": "</b>", "[[INLINE_CODE_3]]": "`x`"}
