"""op5 deals out windows by part; texts and places wait for the answers."""

from stylemill.llm import substring_dedup


def test_texts_are_not_dealt_out_by_part(spark, monkeypatch):
    own, seen = substring_dedup.by_key, []
    monkeypatch.setattr(substring_dedup, "by_key", lambda df, key, *rest: (seen.append((key, df)), own(df, key, *rest))[1])
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"a{i} {words} z{i}" if i % 2 else f"b{i}") for i in range(8)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in substring_dedup.op5(docs).collect()}
    assert got == {i: 20 if i % 2 and i > 1 else 0 for i in range(8)}
    kinds = [{r.kind for r in df.select("kind").distinct().collect()} for key, df in seen if key == "p"]
    assert kinds[-1] <= {"window"}
