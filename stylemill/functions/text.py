"""Tokenisers and text filters as column expressions. All return null, or an empty array, for null text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import LIGATURES

WORD = r"[A-Za-z0-9]++(?:'[A-Za-z0-9]++)?+"
#: Runs of white space that are not one plain space, and where a squeezed text has the end of a sentence.
SPACES = r"(?U) \s+|[\s&&[^ ]]\s*"
SENTENCE_BREAK = r" (?<=[.!?] )(?=[A-Z0-9\"'(\[])"


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def words(text: str | Column) -> Column:
    """Runs of ASCII letters and digits, with an inner apostrophe."""
    return F.coalesce(F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lower_words(text: str | Column) -> Column:
    return words(F.lower(_col(text)))


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(WORD)), F.lit(0))


def squeeze(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(text), SPACES, " "))


def sentences(text: str | Column) -> Column:
    """Split after a terminator where a capital, a digit, a quote or a bracket follows."""
    return F.coalesce(F.filter(F.split(squeeze(text), SENTENCE_BREAK), lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def paragraphs(text: str | Column) -> Column:
    """Split at blank lines."""
    parts = F.transform(F.split(_col(text), r"(?U)\n\s*\n+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def occurrences(text: str | Column, part: str) -> Column:
    """How often a string occurs without overlaps."""
    t = _col(text)
    return F.coalesce((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part), F.lit(0)).cast("long")


def token_estimate(text: str | Column) -> Column:
    """Four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor((F.coalesce(F.length(_col(text)), F.lit(0)) + 3) / 4)).cast("long")


def normalize(text: str | Column) -> Column:
    """No front matter, LF line ends, no ligatures, no hyphenation at line ends, at most two blank lines."""
    t = F.regexp_replace(_col(text), r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, r"\n{4,}", "\n\n\n"), r"(?U)\A\s+|\s+\z", "")


def strip_base64_images(text: str | Column) -> Column:
    """Embedded images become a placeholder. A line break ends an image."""
    return F.regexp_replace(_col(text), r"(?i)data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=\\s]+", "[[BASE64_IMAGE]]")


def strip_inline_code(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), r"``[^`\n]+``|`[^`\n]+`", "")


def strip_latex(text: str | Column) -> Column:
    """Display and inline mathematics, then bare commands."""
    t = F.regexp_replace(_col(text), r"(?s)\\\[.*?\\\]", "\n")
    t = F.regexp_replace(t, r"(?s)\\\(.*?\\\)", "")
    t = F.regexp_replace(t, r"(?s)\$\$.*?\$\$", "\n")
    t = F.regexp_replace(t, r"\$[^$]*\$", "")
    return F.regexp_replace(t, r"\\[A-Za-z]+(?:\{[^}]*\})?", "")


def strip_html(text: str | Column) -> Column:
    """An element goes with its contents up to the first closing tag; then comments and single tags."""
    t = F.regexp_replace(_col(text), r"(?is)<[A-Za-z][^>]*>.*?</[A-Za-z][^>]*>", "\n")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->", "")
    return F.regexp_replace(t, r"<[A-Za-z/][^>]*>", "")


def strip_entities(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), r"&[A-Za-z0-9#]+;", "")


#: P13 as one pattern: a year, and et al., a pointer, a comma or semicolon, or a name (no month) before the year.
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_CITATION = (
    r"\((?=[^()]{1,80}\))(?=[^()]*\b(?:19|20)\d{2}[a-z]?\b)"
    r"(?=[^()]*(?:\b(?i:et\s+al)\b|\b(?i:cf\.|see)(?:\b|(?<=\.))|[,;]|\b(?!(?i:" + _MONTHS + r")\s)[A-Z][A-Za-z'’.-]+\s+(?:19|20)\d{2}[a-z]?\b))[^()]*\)"
)


def is_citation(inner: str | Column) -> Column:
    """Whether the inside of a pair of parentheses is a citation."""
    return F.concat(F.lit("("), _col(inner), F.lit(")")).rlike("^" + _CITATION + "$")


def strip_citations(text: str | Column) -> Column:
    """Footnote marks, numeric and parenthetical citations; then double spaces and spaces around line ends."""
    t = F.regexp_replace(_col(text), r"\[\^[^\]]+\]", "")
    t = F.regexp_replace(t, r"\[(?:\d+|[IVX]+)(?:\s*[-–,;]\s*(?:\d+|[IVX]+))*\]", "")
    t = F.regexp_replace(t, _CITATION, "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r" *\n *", "\n")
    return F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")


def strip_quotes(text: str | Column) -> Column:
    """Quoted passages of two words or more, straight or curly."""
    two = r"[^A-Za-z0-9{q}]*[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?[^A-Za-z0-9{q}]+[A-Za-z0-9][^{q}]*"
    return F.regexp_replace(_col(text), '"' + two.replace("{q}", '"') + '"|“' + two.replace("{q}", "”") + "”", "")


def quoted(text: str | Column) -> Column:
    """The insides of quotations of two words or more."""
    return F.filter(F.coalesce(F.transform(F.regexp_extract_all(_col(text), F.lit('"[^"]+"|“[^”]+”'), F.lit(0)), lambda x: F.substring(x, 2, F.length(x) - 2)), F.array().cast("array<string>")), lambda x: F.regexp_count(x, F.lit(WORD)) >= 2)


def title(text: str | Column) -> Column:
    """P20: the first of <title>, <h1>, a # heading that opens the text, an underlined line that opens it; else null."""
    t = _col(text)

    def found(pattern: str, group: int = 1, tags: bool = False) -> Column:
        x = F.regexp_extract(t, pattern, group)
        return F.nullif(squeeze(F.regexp_replace(x, "<[^>]+>", "") if tags else x), F.lit(""))

    atx = found(r"\A\s*#+[ \t]*([^\n]*)")
    setext = found(r"\A\s*([^\n]*[^\s][^\n]*)\n[ \t]*(?:=+|-+)[ \t]*(?:\n|\z)")
    return F.coalesce(found(r"(?is)<title[^>]*>(.*?)</title>"), found(r"(?is)<h1[^>]*>(.*?)</h1>", tags=True), atx, setext)


def prose_key(text: str | Column) -> Column:
    """Prose without code, links, addresses and punctuation, in lower case."""
    t = F.regexp_replace(strip_inline_code(text), r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"https?://\S+", " ")
    return squeeze(F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", " "))
