"""Pronouns against a walk over one text's words, rule by rule, and repairs."""

import random
import re

import pytest

from stylemill.operators import voice as V

PERSON = {w: p for p, ws in V.PERSONS.items() for w in ws}


def plain(text, mode, marks):
    """(allowed, violations, other) of one text."""
    seen = [0, 0, 0]
    for part in re.split("[.!?;:]", text) if marks else [text]:
        words = [(m[0], part[: m.start()]) for m in re.finditer(V.WORD, part)]
        norm = [w.lower().split("'")[0] if w.lower().split("'")[0] in V.SUBJECTS else w.lower() for w, _ in words]

        def verb(i, norm=norm):
            if i >= len(norm):
                return False
            w = norm[i]
            ends = w.endswith(("ed", "ing", "en")) or w.endswith("s") and len(w) > 3
            return w in V.VERBS or w not in V.NO_VERBS and w not in PERSON and ends

        for i, (_, before) in enumerate(words):
            who = PERSON.get(norm[i])
            if not who:
                continue
            between = re.split(V.WORD, before)[-1]
            starts = i == 0 or words[i - 1][0].lower() in V.OPENING_WORDS or bool(marks and re.search(V.OPENERS, between))
            subject = norm[i] in V.SUBJECTS and (starts or verb(i + 1)) or norm[i] in V.OBJECTS and starts and (verb(i + 1) or norm[i + 1 : i + 2] in (["and"], ["or"]))
            seen[0 if who == mode else 1 if subject else 2] += 1
    return tuple(seen)


@pytest.mark.parametrize("marks", [False, True])
def test_each_word_and_its_neighbours(spark, marks):
    rng = random.Random(8)
    words = [*PERSON, "I'm", "You'll", "it's", "don't", "He", "Them", "and", "or", "that", "the", "walked", "goes", "see", "river", "is", "his"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", " (", ") ", '"', "; ", " - "]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", "'", "I"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string").repartition(4)
    for mode in V.PERSONS:
        got = {r.doc_id: (r.allowed, r.violations, r.other) for r in V.voice(docs, mode, marks=marks).collect()}
        assert got.pop(-1) == (0, 0, 0)
        assert got == {i: plain(t, mode, marks) for i, t in enumerate(texts)}
        assert sum(v[1] for v in got.values()) > 100


def test_sentences_with_violations(spark):
    text = "They went home. You saw the river and I walked. The river saw you. Him and me are here."
    rows = V.violations(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "third").collect()
    assert [(r.doc_id, r.sent_no, r.first, r.second, r.third, r.tokens) for r in rows] == [(1, 1, 1, 1, 0, ["You", "I"]), (1, 3, 1, 0, 0, ["me"])]


def test_repairs(spark):
    texts = [
        "You can see the mill. A river, and you can see it. you can see you can see.", "I argue that it stands.  We should note it.", "You walk.", "It stands; nothing else.", None, "",
        "I think  that it stands.", "I think that you walk.", "You have to go. You have to go.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.repairs) for r in V.repaired(docs, "third").collect()}
    assert got == {
        0: ("It is possible to see the mill. A river, and it is possible to see it. you can see you can see.", 2), 1: ("This analysis argues that it stands.  It is worth noting it.", 2),
        2: ("You walk.", 0), 3: ("It stands; nothing else.", 0), 4: (None, 0), 5: ("", 0), 6: ("I think  that it stands.", 0), 7: ("This analysis suggests that you walk.", 1),
        8: ("It is necessary to go. It is necessary to go.", 2),
    }
    got = V.repaired(spark.createDataFrame([(0, "One can see the mill, and we walked.")], "doc_id long, text string"), "second").first()
    assert (got.text, got.repairs) == ("You can see the mill, and we walked.", 1)
