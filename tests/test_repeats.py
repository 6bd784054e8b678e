"""Repeated blocks against a loop over one text's blocks."""

import difflib
import random
import re

from stylemill.operators import markdown, repeats

WORDS = "the mill stood by a river and its wheel turned slowly while people came with grain from far fields every autumn".split()


def key(block):
    for p in (r"`[^`]*`", r"\[[^\]]+\]\([^)]+\)", r"https?://\S+", r"[^a-zA-Z0-9\s]"):
        block = re.sub(p, " ", block)
    return " ".join(block.lower().split())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_edits(a, b):
    return (len(a) + len(b) - 2 * edits(a, b) + abs(len(a) - len(b))) / max(1, len(a) + len(b))


def plain(blocks, ratio, lookback, share, least, like):
    """The numbers of the blocks that go."""
    recent, gone, most = [], [], max(1, int(len(blocks) * share + 1e-9))
    for i, b in enumerate(blocks):
        k = key(b)
        prose = not b.startswith("```") and not re.match(r"\s*#{1,8}\s", b) and not re.search(r"(?m)^\s*(?:[-*+]\s|\d+[.)]\s|\|)", b) and len(re.findall(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?", b)) >= least and re.search("[.!?]", b)
        if prose and k and len(gone) < most and any(k == r or like(k, r) >= ratio - 1e-12 for r in recent):
            gone.append(i)
        elif k:
            recent = [*recent, k][-lookback:]
    return gone


def make(rng):
    out = []
    for _ in range(rng.randint(1, 30)):
        kind = rng.random()
        if out and kind < 0.5:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[w[at] + "s"], [w[at], "so"], [w[at].upper()], ["x"]])
            out.append(" ".join(w))
        else:
            out.append(rng.choice(["", "", "", "# ", "- ", "| ", "```\n"]) + " ".join(rng.choices(WORDS, k=rng.randint(4, 14))) + rng.choice([".", ".", "!", ""]))
            if out[-1].startswith("```"):
                out[-1] += "\n```"
    return out


def run(spark, texts, **rule):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r for r in repeats.repeated_blocks(docs, **rule).collect()}


def test_fold_is_the_loop(spark):
    rng = random.Random(3)
    texts = ["\n\n".join(make(rng)) for _ in range(250)]
    dropped = 0
    for rule in ({"ratio": 0.9, "lookback": 3, "share": 0.5, "least": 5}, {"ratio": 0.985, "lookback": 20, "share": 0.15, "least": 5}, {"ratio": 1.0, "lookback": 1, "share": 1.0, "least": 1}):
        got = run(spark, texts, **rule)
        for i, t in enumerate(texts):
            blocks = markdown.split_blocks(t)
            assert [b.text for b in got[i].blocks] == blocks
            want = plain(blocks, **rule, like=by_edits)
            assert got[i].dropped == want, (i, rule)
            dropped += len(want)
    assert dropped > 300


def test_one_sided_changes_have_the_ratio_of_matching_blocks(spark):
    a = "the mill stood by a river and its wheel turned slowly while people came with grain."
    changed = {"inserted": a.replace("wheel", "old wheel"), "removed": a.replace("slowly ", ""), "exchanged": a.replace("mill", "Xill")}
    for b in changed.values():
        ratio = difflib.SequenceMatcher(None, key(a), key(b), autojunk=False).ratio()
        assert abs(ratio - by_edits(key(a), key(b))) < 1e-12
        for r, n in ((ratio - 1e-6, 1), (ratio + 1e-6, 0)):
            assert len(run(spark, [a + "\n\n" + b], ratio=r, least=5, share=1.0)[0].dropped) == n


def test_only_kept_blocks_count_and_only_a_share_goes(spark):
    p, q = " ".join(WORDS[:6]) + ".", " ".join(WORDS[6:12]) + "."
    got = run(spark, ["\n\n".join([p] * 5), "\n\n".join([p, q, p]), "\n\n".join([p, p, q, p])], least=5, share=1.0, lookback=1)
    assert [got[i].dropped for i in range(3)] == [[1, 2, 3, 4], [], [1]]
    assert run(spark, ["\n\n".join([p] * 20)], least=5)[0].dropped == [1, 2, 3]
    assert run(spark, ["\n\n".join([p] * 3000)], least=5, share=1.0)[0].dropped == list(range(1, 3000))


def test_text_without_what_repeats(spark):
    p = " ".join(WORDS[:6]) + "."
    rows = [(0, f"{p}\n\n\n{p.upper()}\n\n# {p}\n"), (1, None), (2, ""), (3, " \n "), (4, "```\nx")]
    got = {r.doc_id: (r.text, r.dropped) for r in repeats.drop_repeated_blocks(spark.createDataFrame(rows, "doc_id long, text string"), least=5).collect()}
    assert got == {0: (f"{p}\n\n# {p}", 1), 1: (None, 0), 2: ("", 0), 3: (" \n ", 0), 4: ("```\nx", 0)}
    assert repeats.drop_repeated_blocks(spark.createDataFrame([], "doc_id long, text string")).count() == 0
