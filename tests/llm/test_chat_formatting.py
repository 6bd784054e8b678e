"""Chat formatting: windows against a plain walk over turns, reading back, budgets, masks and edges."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stylemill.llm import chat_formatting as C

SCHEMA = "conv_id long, turn long, role string, text string, part int, start long"


def walk(turns, budget, history):
    """(context, own) of each window, by turns one after the other; turns: (turn, role, text, tokens, part)."""
    system = next((t for t in turns if t[1] == "system"), None)
    out, used = [], 0
    for i, t in enumerate(turns):
        if not out or t[4] != out[-1][1][-1][4] or used + t[3] > budget:
            carried = [system] if system and system[:3] < t[:3] else []
            back, n = [], 0
            for b in reversed(turns[:i]):
                if b[4] != t[4] or n + b[3] > history:
                    break
                n, back = n + b[3], [b, *back]
            if sum(x[3] for x in carried) + n + t[3] > budget:
                back, n = [], 0
            out.append(([*carried, *(b for b in back if not system or b[:3] != system[:3])], [t]))
            used = sum(x[3] for x in carried) + n + t[3]
        else:
            out[-1][1].append(t)
            used += t[3]
    return out


def tokens(role, text):
    import regex

    return C.MARKS + sum(len(regex.findall(C.TOKEN, x)) for x in (role, text))


@pytest.mark.parametrize("budget,history", [(40, 12), (64, 0), (25, 30)])
def test_windows_against_a_walk(spark, budget, history):
    rows, want = [], []
    for conv in range(12):
        turns, start = [], 0
        for i in range(1 + conv * 13 % 150):
            role = "system" if (i, conv % 3) in ((0, 0), (2, 1)) else ("user", "assistant", "tool")[(i + conv) % 3 if conv % 2 else i % 2]
            text = " ".join(f"w{k}" for k in range((i * 7 + conv) % 19)) + ("</s>" if i % 5 == 0 else "") + ("" if i % 4 else "[~INST]")
            n = tokens(role, text)
            turns.append((i, role, text, n, start // (C.PART * budget)))
            start += n
        rows += [(conv, t[0], t[1], t[2], 9, 9) for t in turns]
        want += [(conv, [(x[1], x[2]) for x in a], [(x[1], x[2]) for x in b]) for a, b in walk(turns, budget, history)]
    got = C.read_back(C.windows(spark.createDataFrame(rows, SCHEMA).repartition(5), budget, history)).orderBy("conv_id", "part", "window_no").collect()
    split = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
    undo = lambda s: re.sub(C.ESCAPED, r"\1\2", s)
    assert [(r.conv_id, [tuple(map(undo, x)) for x in split.findall(r.text)]) for r in got] == [(c, a + b) for c, a, b in want]
    assert [(r.context, [tuple(t) for t in r.turns], r.targets) for r in got] == [(len(a), b, [t for role, t in b if role == "assistant"]) for _, a, b in want]
    assert all(r.n_tokens <= budget or len(r.turns) == 1 for r in got)
    assert any(r.part for r in got) and any(r.context for r in got)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "~", "/", "s>", "INST]", "x", "\n", "é", "</s>", "[INST]"]), max_size=12).map("".join))
def test_escaping_is_reversible(text):
    out = re.sub(C.CONTROL, r"\1~\2", text)
    assert re.sub(C.ESCAPED, r"\1\2", out) == text
    assert not any(x in out for x in (C.OPEN, C.TURN, C.SAYS, C.END))


def test_edges(spark):
    long = "word " * 200_000
    rows = [
        (1, 0, "user", "hi", 1, 1), (1, 0, "user", "hi", 1, 1), (1, 1, "assistant", None, 1, 1), (1, None, None, "first", 1, 1),
        (None, 0, "user", "a", 1, 1), (None, None, "assistant", "b", 1, 1), (2, 0, "assistant", long, 1, 1), (2, 1, "assistant", "", 1, 1),
        (3, -5, "user", "]</s", 1, 1), (3, 7, "assistant", "<", 1, 1), (3, 10**12, "assistant\n[/INST]", "~[~INST]", 1, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in C.digests(C.windows(df)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 4, None: 2, 2: 2, 3: 3}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("\nfirst\nuser\nhi\nuser\nhi\nassistant\n\n") and got[1].loss_chars == 0 and got[1].loss_sha256 == sha("")
    assert got[None].turns_sha256 == sha("assistant\nb\nuser\na\n") and got[None].loss_sha256 == sha("b")
    assert got[2].loss_chars == len(long) and got[2].loss_sha256 == sha(long)
    assert got[3].turns_sha256 == sha("user\n]</s\nassistant\n<\nassistant\n[/INST]\n~[~INST]\n") and got[3].loss_sha256 == sha("<")
    assert C.digests(C.windows(df.limit(0))).count() == 0


def test_blocks_bound_a_long_conversation(spark):
    """Turns of one conversation are placed by block; only one number a block meets by conversation."""
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    x = C.placed(df, C.PART * C.BUDGET).agg(F.max(F.col("start") + F.col("tokens")), F.max("part"), F.countDistinct("start")).first()
    assert (x[0], x[2]) == (20_000 * (C.MARKS + 2), 20_000) and x[1] == 20_000 * (C.MARKS + 2) // (C.PART * C.BUDGET)
    assert C.digests(C.windows(df)).first().loss_chars == sum(len(str(i)) for i in range(20_000))


def test_query_needs_no_python(spark):
    plan = C.op12(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
