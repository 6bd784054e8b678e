"""Markdown as a relation of lines, and the filters that need to know what came before a line.

`lines` is one row a line, with the number of the fence it lies in; it is made within the row of a text. What depends on earlier
lines is a scan over a text's rows: running maxima of heading lines by level say which section a line is in, changes are summed
up to number blocks and runs. Texts are put together again by one ordered aggregate. All of it is window and
aggregate expressions without a join; a text's lines meet in one task, as they did in its row.

`key` must be unique: it is a text's identity. Null texts come back null, empty ones empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicons as L

#: Fixed patterns: line breaks, headings, list items, footnotes, and a fence with its lines, which ends at one of its own kind or with the text.
BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
ATX = r"(?U)^\s*(#{1,8})\s+(.*?)\s*#*\s*$"
ITEM = r"(?U)^\s*(?:[-*+]|\d+[.)])\s+"
FOOTNOTE = r"(?U)^\s*\[\^[^\]]+\]:"
FENCE = r"(?md)^[^\S\n]*(```|~~~)[^\n]*(?:\n(?s:.*?)^[^\S\n]*\1[^\n]*(?:\n|\z)|(?s:.*)\z)"
LEVELS = range(1, 9)


def _cut(text: Column) -> Column:
    """The lines of a text with line feeds; a last line feed opens no line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, there (whether there is a text), line_no, line, fence: which fenced block a line belongs to, from 0, or null."""
    t = F.regexp_replace(text, BREAK, "\n")
    x = docs.select(key, F.col(text).isNotNull().alias("there"), F.split(t, FENCE, -1).alias("prose"), F.regexp_extract_all(t, F.lit(FENCE), F.lit(0)).alias("code"))
    kind = lambda fence: lambda p, i: F.transform(_cut(p), lambda s: F.struct(s.alias("line"), (i if fence else F.lit(None).cast("int")).alias("fence")))
    both = F.zip_with(F.transform("prose", kind(False)), F.transform("code", kind(True)), lambda p, c: F.concat(p, F.coalesce(c, F.slice(p, 1, 0))))
    return x.select(key, "there", F.posexplode_outer(F.flatten(both)).alias("line_no", "x")).select(key, "there", "line_no", "x.line", "x.fence")


def _all_of(key: str) -> W:
    return W.partitionBy(key).orderBy("line_no")


def joined(rows: DataFrame, key: str = "doc_id", kept: Column | None = None, sep: str = "\n") -> DataFrame:
    """key, text: the lines put together in order, those alone for which `kept` holds."""
    there = F.col("line").isNotNull() if kept is None else F.col("line").isNotNull() & kept
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(there, F.struct("line_no", "line")))), lambda x: x["line"]), sep)
    return rows.groupBy(key).agg(F.max("there").alias("there"), text.alias("text")).select(key, F.when(F.col("there"), F.col("text")).alias("text"))


def without_fences(text: str | Column) -> Column:
    """P3, within the row: a fence goes with its lines; an open one takes the rest."""
    t = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), FENCE, "")
    return F.regexp_replace(t, r"\n\z", "")


def heading_key(title: Column) -> Column:
    """A title's letters and digits in lower case, without links and marks."""
    t = F.regexp_replace(F.lower(F.regexp_replace(title, r"\[([^\]]*)\]\([^)]*\)", "$1")), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def with_headings(rows: DataFrame, key: str = "doc_id", underlined: bool = True) -> DataFrame:
    """Rows with the level and title of the heading that begins on a line, if one does; not in fences."""
    line, under = F.col("line"), F.trim(F.lead("line").over(_all_of(key)))
    marks = F.regexp_extract(line, ATX, 1)
    level, title = F.when(marks != "", F.length(marks)), F.when(marks != "", F.trim(F.regexp_extract(line, ATX, 2)))
    if underlined:
        plain = F.trim(line) != ""
        level = level.when(plain & under.rlike("^=+$"), 1).when(plain & under.rlike("^-+$"), 2)
        title = title.when(plain & under.rlike("^(?:=+|-+)$"), F.trim(line))
    code = F.col("fence").isNotNull()
    return rows.withColumns({"level": F.when(~code, level), "title": F.when(~code, title)})


def in_references(key: str = "doc_id", named: tuple[str, ...] | None = None) -> Column:
    """Whether a line of `with_headings` is in a section of references: the last heading of its level or above opened one.

    For each level, the last line with a heading up to that level, and the last that opens references there, are running maxima.
    """
    w = _all_of(key)
    opens = heading_key(F.col("title")).isin(list(named or L.REFERENCE_HEADINGS))
    last = lambda test: F.max(F.when(test, F.col("line_no"))).over(w)
    return reduce(lambda a, b: a | b, [F.coalesce(last(F.col("level") <= n) == last((F.col("level") == n) & opens), F.lit(False)) for n in LEVELS])


def without_apparatus(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, text without block quotes, footnotes with their indented lines, and sections of references."""
    x = docs.select(key, F.regexp_replace("text", r"(?is)<blockquote[^>]*>.*?</blockquote>", "\n").alias("text"))
    x = with_headings(lines(x, key).withColumn("fence", F.lit(None).cast("int")), key)
    note, indented = F.col("line").rlike(FOOTNOTE), F.col("line").rlike(r"^(?: {4}|\t)")
    # an indented line goes with the last line that is not, if that one is a footnote
    anchor = F.last(F.when(~indented | note, F.struct(note.alias("note"))), True).over(_all_of(key))["note"]
    x = x.withColumns({"skip": in_references(key), "noted": note | indented & F.coalesce(anchor, F.lit(False))})
    kept = ~F.col("skip") & ~F.col("line").rlike(r"(?U)^\s*>") & ~F.col("noted")
    return joined(x, key, kept).select(key, _trimmed(F.regexp_replace("text", r"\n{3,}", "\n\n")).alias("text"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def with_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `blocks`, an array of code and text of each block, made within the row: no line leaves it.

    Prose between two fences has no line in common with them, and white space from one line feed to the last of a run parts its blocks.
    """
    x = docs.withColumn("_t", F.regexp_replace(text, BREAK, "\n"))
    x = x.withColumns({"_p": F.split("_t", FENCE, -1), "_c": F.regexp_extract_all("_t", F.lit(FENCE), F.lit(0))}).drop("_t")
    block = lambda code: lambda b: F.struct(F.lit(code).alias("code"), b.alias("text"))
    # without the blank lines that open and close it, prose has no blank block
    inner = F.transform("_p", lambda p: F.regexp_replace(p, r"(?U)\A\s*\n|\n\s*\z", ""))
    prose = F.transform(inner, lambda p: F.transform(F.filter(F.split(p, r"(?U)\n\s*\n", -1), lambda b: b.rlike(r"(?U)\S")), block(False)))
    code = F.transform("_c", lambda c: F.array(block(True)(F.regexp_replace(c, r"\n\z", ""))))
    both = F.zip_with(prose, code, lambda p, c: F.concat(p, F.coalesce(c, F.slice(p, 1, 0))))
    return x.withColumn("blocks", F.flatten(both)).drop("_p", "_c")


def blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, block_no, code, text of each block: lines between blank lines, or a fence with all its lines."""
    x = with_blocks(docs.select(key, "text")).select(key, F.posexplode("blocks").alias("block_no", "b"))
    return x.select(key, F.col("block_no").cast("long").alias("block_no"), "b.code", "b.text")


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, title, key of the title, level, start_line, end_line, block of each # heading with what follows up to the next."""
    x = with_headings(lines(docs, key).where("line is not null"), key, underlined=False)
    x = x.withColumn("start_line", F.max(F.when(F.col("level").isNotNull(), F.col("line_no"))).over(_all_of(key))).where("start_line is not null")
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    x = x.groupBy(key, "start_line").agg(F.max("title").alias("title"), F.max("level").alias("level"), (F.max("line_no") + 1).alias("end_line"), block.alias("block"))
    return x.select(key, "title", heading_key(F.col("title")).alias("title_key"), "level", "start_line", "end_line", "block")


def list_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of lines with `indent` (of a list item, else null), `run` (which run of items of one indent) and `items` (its length)."""
    w = _all_of(key)
    x = lines(docs, key)
    x = x.withColumn("indent", F.when(F.col("line").rlike(ITEM), F.length(F.regexp_extract("line", r"(?U)^(\s*)", 1))))
    opens = F.col("indent").isNotNull() & ~F.coalesce(F.lag("indent").over(w) == F.col("indent"), F.lit(False))
    x = x.withColumn("run", F.when(F.col("indent").isNotNull(), F.sum(opens.cast("int")).over(w)))
    of_run = W.partitionBy(key, "run")
    return x.withColumn("items", F.when(F.col("run").isNotNull(), F.count("*").over(of_run))).withColumn("place", F.when(F.col("run").isNotNull(), F.row_number().over(of_run.orderBy("line_no")) - 1))


def group_lists(docs: DataFrame, run: int = 6, size: int = 2, key: str = "doc_id") -> DataFrame:
    """Key, text with the items of runs of `run` or more joined `size` at a time, and merged: how many lines that saved."""
    x = list_runs(docs, key).withColumn("long", F.coalesce(F.col("items") >= run, F.lit(False)))
    own = F.when(F.col("long"), F.col("line_no") - F.col("place") % size).otherwise(F.col("line_no"))  # the line it is joined to
    plain = F.regexp_replace("line", r"[ .;]+$", "")
    item = F.when(F.col("place") % size == 0, plain).otherwise(F.regexp_replace(plain, ITEM, ""))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line", item.alias("item"), "long")))
    x = x.groupBy(key, own.alias("line_no")).agg(F.max("there").alias("there"), parts.alias("parts"))
    ends = F.regexp_replace(F.col("parts")[0]["line"], r"(?U)\s+$", "").endswith(".")
    line = F.array_join(F.transform("parts", lambda p: p["item"]), "; ")
    line = F.when(F.col("parts")[0]["long"], F.concat(line, F.when(ends, ".").otherwise(""))).otherwise(F.col("parts")[0]["line"])
    x = x.select(key, "there", "line_no", F.when(F.size("parts") > 0, line).alias("line"), (F.size("parts") - 1).alias("saved"))
    saved = x.groupBy(key).agg(F.sum(F.greatest("saved", F.lit(0))).alias("merged"))
    return joined(x, key).join(saved, key)


def voice_filter(docs: DataFrame, key: str = "doc_id", quotes: bool = True) -> DataFrame:
    """Key, text: what the author wrote in their own voice; the filters that need no earlier line are expressions of the row."""
    from ..functions import text as T

    x = without_apparatus(docs.select(key, without_fences("text").alias("text")), key)
    t = T.strip_quotes(F.col("text")) if quotes else F.col("text")
    t = T.strip_entities(T.strip_html(T.strip_latex(T.strip_inline_code(t))))
    t = T.strip_citations(F.regexp_replace(t, r"\[\[BASE64_IMAGE(?:_\d+)?\]\]", ""))
    return x.select(key, F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n")).alias("text"))
