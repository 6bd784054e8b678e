"""JSON sources, whole DOCX files, and lengths after the voice filter."""

import json
import zipfile

from stylemill.operators import spelling
from stylemill.sources import files


def test_spelling_rules_from_json(spark, tmp_path):
    rules = {
        "direct_variants": [{"variants": {"us": "gray", "british": "grey"}}],
        "suffix_variants": [{"variants": {"us": "color", "british": "colour"}, "suffixes": ["", "s"]}],
        "context_variants": [{"variants": {"us": "tire", "british": "tyre"}, "apply_if": {"any": ["wheel"]}, "window": 2}, {"variants": {"us": "meter", "british": "metre"}, "block_if": {"any": ["gas"]}}],
        "double_l_inflection": {"bases": ["travel"], "suffixes": ["ed"]},
    }
    (tmp_path / "rules.json").write_text(json.dumps({"rules": rules}, indent=1))
    got = files.read_spelling_rules(spark, str(tmp_path / "rules.json"))
    assert [(r.kind, r.near) for r in got.orderBy("kind", "rank").collect()] == [("context", 2), ("context", 6), ("direct", 6), ("double", 6), ("suffix", 6)]
    docs = spark.createDataFrame([(1, "gray colors, a wheel tire; one far off tire. gas meter traveled")], "doc_id long, text string")
    assert spelling.localise(docs, got, "british").first().text == "grey colours, a wheel tyre; one far off tire. gas meter travelled"
    assert set(got.columns) == set(spelling.rule_rows(spark, []).columns)


def test_emoji_from_json(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"🙂": {"replacement": ":)", "description": "smile"}, "❗": {"replacement": "!"}}, ensure_ascii=False, indent=1))
    assert {tuple(r) for r in files.read_emoji(spark, str(tmp_path / "e.json")).collect()} == {("🙂", ":)", "smile"), ("❗", "!", None)}


def test_long_docx_and_voiced_lengths(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{i * 7919 % 100003} is a number.</w:t></w:r></w:p>" for i in range(400)) + "</w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.md").write_text("My own words.\n" + "> quoted by me\n" * 40)
    kept = lambda **more: sorted(r.path.rsplit("/", 1)[1] for r in files.read_corpus(spark, str(tmp_path), most_bytes=900, **more).collect())
    assert kept() == ["a.docx", "b.md"] and kept(voiced=True) == ["a.docx"]
