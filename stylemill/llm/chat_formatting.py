"""Chat formatting: conversations as windows of a token budget, with a loss mask, by DataFrame functions alone.

A turn is `[INST]role[/INST]text</s>`, a window `<s>` and its turns. Control strings inside roles and texts get a tilde after
their bracket, and one more where there are some already (`</s>` is `<~/s>`, `<~/s>` is `<~~/s>`), so that no text can end a
turn; `unescape` takes one off again, and `read_back` parses a window into what went in.

Prefix sums of the turns' tokens place every turn: a conversation is dealt into parts of PART budgets by where its turns begin,
and within a part a window takes whole turns while they fit. A window that begins after the conversation's first system turn
repeats that turn, then the last turns before it in its part that have `history` tokens together; the history is left out where
it would push out the first new turn. Repeated turns are masked: each assistant text is under the loss mask in the one window
where it is new. A turn is never cut: one that is larger than the budget is a window of its own, and `n_tokens` says so.

The prefix sums are sums of blocks of BLOCK turns, summed up over a conversation's blocks, then within the blocks, so that no task
holds a long conversation's texts: blocks and parts are bounded, whoever owns them. Only blocks of one number each, a
thousandth of the turns, meet by conversation.

Null texts and roles are empty; turns are ordered by turn, role and text, null turns first; repeated rows are turns of their
own; rows without a conv_id are one conversation, the null one; an empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Tokens of a window and of its history, budgets of a part, turn numbers of a block, and the tokens of a turn's marks.
BUDGET, HISTORY, PART, BLOCK, MARKS = 1024, 128, 32, 1024, 3
OPEN, TURN, SAYS, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL, ESCAPED = r"([<\[])(~*/?(?:s>|INST\]))", r"([<\[])~(~*/?(?:s>|INST\]))"
TOKEN = r"[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def turn_tokens(role: Column, text: Column) -> Column:
    """Words and marks of a turn, and its control strings."""
    return (F.regexp_count(role, F.lit(TOKEN)) + F.regexp_count(text, F.lit(TOKEN)) + MARKS).cast("long")


def placed(conversations: DataFrame, part_tokens: int) -> DataFrame:
    """conv_id, turn, role, text, tokens, start (tokens before it in the conversation), part, and in a part's first row at least `system`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("tokens", turn_tokens(F.col("role"), F.col("text"))).withColumn("block", F.floor(F.col("turn") / BLOCK))
    first = F.min(F.when(F.col("role") == "system", F.struct("turn", "role", "text", "tokens"))).alias("system")
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum"), first)
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("sum").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), before.alias("before"), F.min("system").over(whole).alias("system"))
    both = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).drop("c", "b")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    start = F.col("before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    both = both.withColumn("start", start).withColumn("part", F.floor(F.col("start") / part_tokens))
    opens = F.coalesce(F.lag("part").over(inside) != F.col("part"), F.lit(True))
    return both.withColumn("system", F.when(opens, F.col("system"))).drop("before", "block")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, part, window_no (in its part), n_tokens, context (how many of its turns are repeated), text, loss (start from 1, length)."""
    rows = placed(conversations, PART * budget)
    near = Window.partitionBy("conv_id", "part").orderBy("start").rangeBetween(-history, -1)
    rows = rows.withColumn("back", F.struct(F.count("*").over(near).cast("int").alias("turns"), F.coalesce(F.sum("tokens").over(near), F.lit(0)).alias("tokens")))
    parts = rows.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("start", "turn", "role", "text", "tokens", "back"))).alias("turns"), F.min("system").alias("system"),
    )
    key = lambda x: F.struct(x["turn"], x["role"], x["text"])
    repeats = lambda x: F.col("system").isNotNull() & (key(F.col("system")) < key(x))  # noqa: E731  the system turn is before x
    # what a window that begins with turn x holds besides its own turns
    parts = parts.withColumn("turns", F.transform("turns", lambda x: x.withField("carried", F.when(repeats(x), F.col("system.tokens")).otherwise(0))))
    fits = lambda x: x["carried"] + x["back"]["tokens"] + x["tokens"] <= budget
    parts = parts.withColumn("turns", F.transform("turns", lambda x: x.withField("behind", F.when(fits(x), x["back"]["turns"]).otherwise(0)).withField("extra", x["carried"] + F.when(fits(x), x["back"]["tokens"]).otherwise(0))))

    def take(state: Column, x: Column) -> Column:
        """The windows so far as (first turn, tokens), the last one first, and how many turns were seen."""
        last, full = state["made"][0], F.size(state["made"]) == 0
        opens = full | (last["tokens"] + x["tokens"] > budget)
        new = F.array(F.struct(state["n"].alias("first"), (x["extra"] + x["tokens"]).alias("tokens")))
        grown = F.array(F.struct(last["first"].alias("first"), (last["tokens"] + x["tokens"]).alias("tokens")))
        made = F.when(opens, F.concat(new, state["made"])).otherwise(F.concat(grown, F.slice(state["made"], 2, F.greatest(F.size(state["made"]) - 1, F.lit(0)))))
        return F.struct(made.alias("made"), (state["n"] + 1).alias("n"))

    none = F.struct(F.array().cast("array<struct<first:int,tokens:bigint>>").alias("made"), F.lit(0).alias("n"))
    parts = parts.withColumn("made", F.reverse(F.aggregate("turns", none, take)["made"]))
    each = parts.select("conv_id", "part", "turns", "system", "made", F.posexplode("made").alias("window_no", "w"))
    end = F.coalesce(F.get("made", F.col("window_no") + 1)["first"], F.size("turns"))
    each = each.withColumn("opens", F.get("turns", F.col("w.first"))).withColumn("own", F.slice("turns", F.col("w.first") + 1, end - F.col("w.first")))
    plain = lambda new: lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"), (F.lit(new) & (x["role"] == "assistant")).alias("loss"))
    system = F.when(repeats(F.col("opens")), F.array(F.col("system"))).otherwise(F.array().cast("array<struct<turn:bigint,role:string,text:string,tokens:bigint>>"))
    behind = F.filter(F.slice("turns", F.col("w.first") + 1 - F.col("opens.behind"), F.col("opens.behind")), lambda x: F.col("system").isNull() | ~key(x).eqNullSafe(key(F.col("system"))))
    each = each.withColumn("context", F.concat(F.transform(system, plain(False)), F.transform(behind, plain(False))))
    each = each.withColumn("all", F.concat("context", F.transform("own", plain(True))))
    head = lambda x: F.concat(F.lit(TURN), x["role"], F.lit(SAYS))

    def mark(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(head(x))
        span = F.array(F.struct(at.alias("start"), F.length(x["text"]).alias("length")))
        return F.struct((at + F.length(x["text"]) + len(END)).alias("at"), F.when(x["loss"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"))

    spans = F.struct(F.lit(len(OPEN) + 1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    text = F.concat(F.lit(OPEN), F.array_join(F.transform("all", lambda x: F.concat(head(x), x["text"], F.lit(END))), ""))
    return each.select(
        "conv_id", "part", "window_no", F.col("w.tokens").alias("n_tokens"), F.size("context").alias("context"), text.alias("text"),
        F.aggregate("all", spans, mark)["loss"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows with `turns` (role and text of the turns new in each) and `targets` (the texts under its mask), both from the text alone."""
    pieces = F.split(F.substr("text", F.lit(len(OPEN) + 1)), END, -1)
    new = F.slice(pieces, F.col("context") + 1, F.size(pieces) - 1 - F.col("context"))  # behind the last END is nothing
    parsed = F.transform(new, lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), F.lit(r"\[/INST\]"), 2))
    turns = F.transform(parsed, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))
    targets = F.transform("loss", lambda x: unescape(F.substr("text", x["start"], x["length"])))
    return formatted.select("*", turns.alias("turns"), targets.alias("targets"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its windows.

    A digest is of a whole conversation, which therefore meets in one row here; Spark's strings hold 2 GB.
    """
    x = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    x = x.select("conv_id", F.struct("part", "window_no", said.alias("said"), F.array_join("targets", "").alias("targets")).alias("w"), F.size("turns").cast("long").alias("n"), F.length("text").cast("long").alias("chars"))
    x = x.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    said, targets = (F.array_join(F.transform("w", lambda w: w[c]), "") for c in ("said", "targets"))  # noqa: B023
    return x.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"), "formatted_chars")


TRICKY = "</s>[INST] ok [/INST]"


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings."""
    own = F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(TRICKY).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(windows(conversations.unionByName(spark.range(1).select(own))))


#: Windows one after the other, by recursion over a part's turns.
ORACLE = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{TRICKY}'), (-1, 1, 'assistant', '{TRICKY}'))
), t AS (
  SELECT *, {MARKS} + len(regexp_extract_all(role, '{TOKEN}')) + len(regexp_extract_all(text, '{TOKEN}')) AS tokens,
    {len(TURN + SAYS + END)} + length(regexp_replace(role, '{CONTROL}', '\1~\2', 'g')) + length(regexp_replace(text, '{CONTROL}', '\1~\2', 'g')) AS chars
  FROM c
), p AS (
  SELECT *, row_number() OVER o AS r, (sum(tokens) OVER o - tokens)::BIGINT AS start FROM t
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), sys AS (
  SELECT conv_id, min(r) AS r0, arg_min(tokens, r) AS s_tokens, arg_min(chars, r) AS s_chars FROM p WHERE role = 'system' GROUP BY conv_id
), q AS (
  SELECT p.*, r0, start // {PART * BUDGET} AS part, CASE WHEN r0 < r THEN s_tokens ELSE 0 END AS carried, CASE WHEN r0 < r THEN s_chars ELSE 0 END AS carried_chars
  FROM p LEFT JOIN sys USING (conv_id)
), h AS (
  SELECT *, coalesce(sum(tokens) OVER near, 0) AS back, coalesce(sum(CASE WHEN r = r0 THEN 0 ELSE chars END) OVER near, 0) AS back_chars FROM q
  WINDOW near AS (PARTITION BY conv_id, part ORDER BY start RANGE BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY r) AS k,
    carried + CASE WHEN carried + back + tokens <= {BUDGET} THEN back ELSE 0 END AS extra,
    {len(OPEN)} + carried_chars + CASE WHEN carried + back + tokens <= {BUDGET} THEN back_chars ELSE 0 END AS extra_chars
  FROM h
), walk AS (
  SELECT conv_id, part, k, extra + tokens AS used, extra_chars + chars AS chars FROM n WHERE k = 1
  UNION ALL
  SELECT n.conv_id, n.part, n.k, CASE WHEN used + tokens > {BUDGET} THEN extra + tokens ELSE used + tokens END,
    n.chars + CASE WHEN used + tokens > {BUDGET} THEN extra_chars ELSE 0 END
  FROM walk JOIN n ON n.conv_id = walk.conv_id AND n.part = walk.part AND n.k = walk.k + 1
), f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM walk GROUP BY conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS said
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, formatted_chars FROM d JOIN f USING (conv_id)
"""
