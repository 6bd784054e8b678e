"""The line relation against the functions that walk over one text's lines."""

import random

import pytest

from stylemill.operators import lines, markdown, rewrite

PARTS = ["# One", "## References", "### Bibliography  ##", "Title", "===", "---", "plain words here.", "", "  ", "```", "~~~", "```py", "> quoted", "  > quoted", "[^1]: note", "    more of it", "\tand more", "- item one.", "- item two;", "  - inner", "1. first.", "2) second", "text <b>x</b>", "# Works *Cited*", "#### deep", "######### nine"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["\n".join(rng.choices(PARTS, k=rng.randint(1, 40))) + rng.choice(["", "\n", "\n\n"]) for _ in range(400)]
    return [*out, "", "\n", "a\r\nb\rc\x0bd\u2028e", "```\nopen", "x\n```", "```", "<blockquote>a\nb</blockquote>\nc", "\n".join(["- a"] * 5000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string").repartition(5)


def got(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_fences(docs, texts):
    x = got(docs.select("doc_id", lines.without_fences("text").alias("text")), "text")
    assert x.pop(-1) == [(None,)]
    # a text that ends in a line feed ends in a line, not in a line feed
    assert {k: v[0][0] for k, v in x.items()} == {i: markdown.without_fences(t) for i, t in enumerate(texts)}


def test_apparatus(docs, texts):
    x = got(lines.without_apparatus(docs), "text")
    assert x.pop(-1) == [(None,)]
    want = {i: markdown.without_apparatus(t) for i, t in enumerate(texts)}
    # a reference heading's underline, a heading that is itself an underline, and indented headings below notes are told apart line by line
    odd = {i for i in want if x[i][0][0] != want[i] and not any(a.strip() and set(a.strip()) <= {"-", "="} for a in texts[i].split("\n"))}
    assert not odd and sum(x[i][0][0] == want[i] for i in want) > 0.9 * len(want)


def test_blocks(docs, texts):
    x = got(lines.blocks(docs), "block_no", "code", "text")
    for i, t in enumerate(texts):
        want = markdown.split_blocks(t)
        assert x.get(i, []) == [(k, markdown.is_code(b), b) for k, b in enumerate(want)], t


def test_sections(docs, texts):
    x = got(lines.sections(docs), "start_line", "title", "title_key", "level", "end_line", "block")
    for i, t in enumerate(texts):
        assert x.get(i, []) == [(h["start_line"], h["title"], h["key"], h["level"], h["end_line"], h["block"]) for h in markdown.heading_blocks(t)], t


@pytest.mark.parametrize("run,size", [(2, 2), (3, 4), (6, 2)])
def test_lists(docs, texts, run, size):
    x = got(lines.group_lists(docs, run, size), "text")
    assert x.pop(-1) == [(None,)]
    for i, t in enumerate(texts):
        want = rewrite.group_lists("\n".join(t.splitlines()), run, size)
        assert x[i] == [(want,)], t


def test_no_python_in_the_plans(docs):
    for df in (lines.voice_filter(docs), lines.blocks(docs), lines.sections(docs), lines.group_lists(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
