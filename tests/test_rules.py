"""Rule screening and the choice among attempts."""

from stylemill.operators import rules


def test_screen(spark):
    listed = spark.createDataFrame([("Avoid em dash", []), ("Use contractions", []), ("Vary words", ["indeed/truly"]), ("Cut filler", ["very"]), ("Add voice", []), ("Plain rule", None)], "title string, words_to_watch array<string>")
    profiles = spark.createDataFrame([("a", 0.6, 0.0, 1.0, 0.01, ["truly"], ["very"], True, 0.0, 0.0, 0.0), ("b", 0.0, 0.0, 1.0, 3.0, [], [], False, 0.0, 0.0, 0.0)], "profile string, em_dash_rate double, hedge_rate double, first_person_rate double, contraction_rate double, preferred array<string>, avoided array<string>, formal boolean, title_case_rate double, bold_per_1000w double, label_rate double")
    got = {(r.profile, r.title): r.reason for r in rules.screen(listed, profiles).collect()}
    assert len(got) == 12 and got["a", "Plain rule"] is None and all(got["b", t] is None for t in ("Avoid em dash", "Use contractions", "Vary words", "Cut filler", "Add voice"))
    assert all(got["a", t] for t in ("Avoid em dash", "Use contractions", "Vary words", "Cut filler", "Add voice"))
    forbidden = {(r.profile, r.title): r.reason for r in rules.screen(listed, profiles, forbidden_dashes=True).collect()}
    assert forbidden["b", "Avoid em dash"] == "em dashes are forbidden"


def test_attempts(spark):
    rows = [(1, 0, 0, 2, 0.9, "x"), (1, 0, 1, 0, 0.5, "y"), (1, 0, 2, 0, 0.5, "z"), (1, 1, 0, 0, 0.1, "w")]
    best = rules.best_attempts(spark.createDataFrame(rows, "doc_id long, chunk_no int, attempt int, violations int, score double, text string"))
    assert rules.stitched(best).first().text == "y\n\nw"
