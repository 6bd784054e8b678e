"""Deterministic rewriting of text, as column expressions where they can say it."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markdown import fence_of, is_code, mask_text, split_blocks


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def plain_dashes(text: str | Column) -> Column:
    """M3: em dashes, with the spaces around them, become spaced hyphens."""
    return F.regexp_replace(_col(text), r"\s*—\s*", " - ")


def dash_count(text: str | Column) -> Column:
    return F.regexp_count(_col(text), F.lit("—"))


def straight_quotes(text: str | Column) -> Column:
    """M4: curly, low and angle quotes become straight."""
    return F.translate(_col(text), "“”„‟«»‘’‚‛‹›", "\"\"\"\"\"\"''''''")


def replace_emoji(text: str | Column, table: dict[str, str] | None = None, policy: str = "remove") -> Column:
    """M5: policy none leaves emoji, remove drops them, replace uses the table and drops the rest."""
    t = _col(text)
    if policy == "none":
        return t
    for emoji, words in (table or {}).items() if policy == "replace" else ():
        t = F.replace(t, F.lit(emoji), F.lit(words))
    return F.regexp_replace(F.regexp_replace(t, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]+", ""), r"[ \t]{2,}", " ")


_QUALIFIERS = "why|how|what|when|where|defined"


def plain_heading(line: str) -> str:
    """M6: a heading without a trailing `(why ...)` or `, how ...` of up to ten words without digits, if two words stay."""
    m = re.match(r"^(\s*#{1,8}\s+)(.*?)(\s*#*\s*)$", line)
    if not m:
        return line
    q = re.match(rf"(?i)^(.+?)\s*(?:\(((?:{_QUALIFIERS})\b[^()]*)\)|,\s*((?:{_QUALIFIERS})\b.*))$", m[2])
    if not q:
        return line
    tail = q[2] or q[3]
    return line if len(tail.split()) > 10 or re.search(r"\d", tail) or len(q[1].split()) < 2 else m[1] + q[1].rstrip(" ,") + m[3]


_MINOR = set("a an and as at but by for in nor of on or so the to up yet with from".split())


def cased(title: str, style: str, names: tuple[str, ...] = ()) -> str:
    """M7: a title in title, sentence, caps or lower case; listed names keep their own."""
    known = {n.lower(): n for n in names}
    words = title.split(" ")
    big = lambda w: w[:1].upper() + w[1:].lower()

    def one(i: int, w: str) -> str:
        if w.lower() in known and style != "caps":
            return known[w.lower()]
        if style == "caps":
            return w.upper()
        if style == "lower":
            return w.lower()
        if style == "title":
            return w.lower() if 0 < i < len(words) - 1 and w.lower() in _MINOR else big(w)
        return big(w) if i == 0 else w.lower()

    return title if style in ("identical", "automatic") else " ".join(one(i, w) for i, w in enumerate(words))


def headings(text: str, styles: dict[int, str] | None = None, names: tuple[str, ...] = (), qualifiers: bool = True) -> str:
    out, fence = [], ""
    for line in text.split("\n"):
        mark = fence_of(line)
        if mark:
            fence = mark if not fence else "" if mark == fence else fence
        elif not fence and (m := re.match(r"^(\s*)(#{1,8})(\s+)(.*)$", line)):
            line = plain_heading(line) if qualifiers else line
            m = re.match(r"^(\s*)(#{1,8})(\s+)(.*)$", line)
            line = m[1] + m[2] + m[3] + cased(m[4], (styles or {}).get(len(m[2]), "identical"), names)
        out.append(line)
    return "\n".join(out)


def case_like(template: str, word: str) -> str:
    """P24"""
    return word.upper() if template.isupper() and len(template) > 1 else word[:1].upper() + word[1:] if template[:1].isupper() else word


#: Our own small rule table: (US, other) pairs by kind. Contexts choose between noun and verb where a locale has both.
SPELLINGS = [("color", "colour"), ("center", "centre"), ("theater", "theatre"), ("tire", "tyre"), ("organize", "organise"), ("analyze", "analyse"), ("defense", "defence"), ("honor", "honour"), ("favorite", "favourite"), ("catalog", "catalogue")]
LOCALES = {"us": {b: a for a, b in SPELLINGS}, "british": dict(SPELLINGS), "australian": dict(SPELLINGS), "canadian": {a: b for a, b in SPELLINGS if not a.endswith("ize") and a not in ("tire", "analyze")} | {"organise": "organize", "tyre": "tire", "analyse": "analyze"}}
_SPELL = re.compile(r"(?<![\w/.@#-])[A-Za-z]+(?![\w/@-]|\.\w)")


def local_spelling(text: str, locale: str) -> str:
    """M8: direct and inflected variants; double l; practise as a verb. Acronyms, mixed case, paths and addresses stay."""
    table = LOCALES[locale]

    def target(w: str) -> str | None:
        if w in table:
            return table[w]
        for end in ("s", "ed", "d", "ing", "er", "ers"):
            stem = w[: -len(end)]
            for base in (stem, stem + "e"):
                if w.endswith(end) and base in table:
                    new = table[base]
                    return (new[:-1] if new.endswith("e") and end[0] in "ei" else new) + end
        if locale == "us" and re.fullmatch(r"(travel|cancel|label|model|signal)l(ed|ing|er)", w):
            return re.sub("ll", "l", w)
        if locale != "us" and (m := re.fullmatch(r"(travel|cancel|label|model|signal)(ed|ing|er)", w)):
            return m[1] + "l" + m[2]
        return None

    def swap(m: re.Match) -> str:
        w, low = m[0], m[0].lower()
        if w not in (low, low.capitalize(), low.upper()) or (w.isupper() and len(w) > 1):
            return w
        if low in ("practice", "practise") and locale != "us":
            verb = re.search(r"\b(?:to|will|must|should|can|could|would|may|might|i|we|you|they)\s+$", text[: m.start()].lower())
            return case_like(w, "practise" if verb else "practice")
        new = target(low)
        return case_like(w, new) if new else w

    return _SPELL.sub(swap, text)


def guarded_spelling(text: str, locale: str) -> str:
    """M9: code, quotations, links and entities keep their spelling."""
    masked, found = mask_text(text, ("FROZEN_BLOCK", "HTML", "ENTITY", "INLINE_CODE", "QUOTE"))
    out = local_spelling(masked, locale)
    for key, value in reversed(found.items()):
        out = out.replace(key, value)
    return out


def _key(block: str) -> str:
    t = re.sub(r"https?://\S+", " ", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"`[^`\n]*`", "", block)))
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", t.lower()).split())


def drop_near_duplicates(text: str, ratio: float = 0.985, lookback: int = 20, most: float = 0.15, least: int = 30) -> tuple[str, int]:
    """Prose blocks of `least` words or more that equal, or nearly, one of the last kept; at most a share of all blocks."""
    blocks, kept, recent, dropped = split_blocks(text), [], [], 0
    allowed = int(len(blocks) * most) if len(blocks) * most >= 1 else 1
    for b in blocks:
        k = _key(b)
        prose = not is_code(b) and not re.match(r"^\s*(?:#|[-*+]\s|\d+[.)]\s|>|\|)", b) and len(k.split()) >= least
        if prose and dropped < allowed and any(k == x or (min(len(k), len(x)) / max(len(k), len(x)) >= 2 * ratio - 1 and difflib.SequenceMatcher(None, k, x).ratio() >= ratio) for x in recent):
            dropped += 1
            continue
        kept.append(b)
        recent = (recent + [k])[-lookback:] if prose else recent
    return "\n\n".join(kept), dropped


def group_lists(text: str, run: int = 6, size: int = 2) -> str:
    """List items of one indent, in runs of `run` or more, are joined `size` at a time."""
    out, now, indent = [], [], None

    def flush() -> None:
        nonlocal now
        if len(now) >= run:
            for i in range(0, len(now), size):
                head, *rest = now[i : i + size]
                out.append("; ".join([head.rstrip(" .;"), *(re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", x).rstrip(" .;") for x in rest)]) + "." * head.rstrip().endswith("."))
        else:
            out.extend(now)
        now = []

    for line in text.split("\n"):
        m = re.match(r"^(\s*)(?:[-*+]|\d+[.)])\s+", line)
        if now and (not m or len(m[1]) != indent):
            flush()
        if m:
            indent = len(m[1])
            now.append(line)
        else:
            out.append(line)
    flush()
    return "\n".join(out)


def first_json(reply: str) -> str | None:
    """P25: the first balanced JSON object or array of a model's reply."""
    t = re.sub(r"^\s*```\w*\s*\n|\n\s*```\s*$", "", reply or "")
    for i, c in enumerate(t):
        if c in "{[":
            depth, quoted, skip = 0, False, False
            for j, d in enumerate(t[i:], i):
                if quoted:
                    quoted, skip = (skip or d != '"'), (not skip and d == "\\")
                elif d == '"':
                    quoted = True
                else:
                    depth += (d in "{[") - (d in "}]")
                    if depth == 0:
                        return t[i : j + 1]
            return None
    return None


def past_summary(text: str, words: int = 50) -> str:
    """A running summary speaks of the previous passage, in so many words."""
    t = re.sub(r"(?i)\bthis (?:section|passage|chunk|text)\b", "the previous passage", text)
    return " ".join(t.split()[:words])

