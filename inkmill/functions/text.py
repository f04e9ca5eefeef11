"""Text columns with Unicode semantics: strip, lines, and scalar projections. All stay in the JVM.

The patterns are written so that Java and RE2 read them alike: white space is one explicit class, and end of text is
``\\z``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, the separators U+001C to U+001F included.
WS = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
STRIP = rf"^{WS}+|{WS}+\z"
#: Line ends in the widest sense.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(text, STRIP, "")


def lines(text: Column) -> Column:
    """Split at line feeds; trailing empty lines are kept."""
    return F.split(text, "\n")


def normalize_lines(text: Column) -> Column:
    """Lines, at any line end, stripped, blank ones dropped, joined by line feeds."""
    kept = F.filter(F.transform(F.split(text, LINE_ENDS), strip), lambda x: x != "")
    return F.array_join(kept, "\n")


def hard_wrap_merge(text: Column, end: str = "。") -> Column:
    """Stripped non-blank lines run together until one ends in ``end``; such lines stay apart."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    joined = F.array_join(F.transform(kept, lambda x: F.when(F.endswith(x, F.lit(end)), F.concat(x, F.lit("\n"))).otherwise(x)), "")
    return F.regexp_replace(joined, r"\n\z", "")


def remove_terms(text: Column, terms: list[str], letters: bool = True) -> Column:
    """The terms taken out one after another, in their order, then (if asked) ASCII letters."""
    for t in terms:
        text = F.replace(text, F.lit(t), F.lit(""))
    return F.regexp_replace(text, "[a-zA-Z]", "") if letters else text


def curl_quotes(text: Column, mark: str, opening: str, closing: str) -> Column:
    """Straight quotes to curly ones, opening and closing in turn."""
    pieces = F.split(text, mark)
    turned = F.transform(pieces, lambda x, i: F.when(i == 0, x).when(i % 2 == 1, F.concat(F.lit(opening), x)).otherwise(F.concat(F.lit(closing), x)))
    return F.array_join(turned, "")


#: The entities that the native unescape knows, the ampersand last so that nothing is read twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"), ("&mdash;", "—"), ("&middot;", "·"), ("&amp;", "&")]


def unescape_common(text: Column) -> Column:
    """The frequent entities, natively; ``html_unescape`` knows them all."""
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_unescape(text: Column) -> Column:
    """All named and numeric entities, as HTML reads them; an Arrow batch at a time, and only where there is one."""
    import html

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return F.when(F.contains(text, F.lit("&")), unescape(text)).otherwise(text)


def drop_prefix(text: Column, prefix: str) -> Column:
    """If ``prefix`` occurs anywhere, the text without its first len(prefix) characters."""
    return F.when(F.contains(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def drop_prefixes(text: Column, prefixes: list[str]) -> Column:
    """``drop_prefix`` for the first of ``prefixes`` that occurs."""
    out = None
    for p in prefixes:
        cut = F.substring(text, len(p) + 1, 1 << 30)
        out = F.when(F.contains(text, F.lit(p)), cut) if out is None else out.when(F.contains(text, F.lit(p)), cut)
    return out.otherwise(text)


def fill_template(template: Column, text: Column, **slots: Column) -> Column:
    """``{name}`` slots, ``{text}`` last, so that braces within the text stay as they are."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{%s}" % name), value)
    return F.replace(template, F.lit("{text}"), text)


def lead_summary(text: Column, before: str = "本段讲的是", after: str = "等事。") -> Column:
    """The first sentence if it ends within 100 characters and is longer than 20: its first 50; else the first 30 of the text."""
    t = strip(text)
    out = None
    for d in "。！？":
        at = F.instr(t, d)
        hit = at.between(21, 100)
        value = F.left(F.left(t, at), F.lit(50))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.concat(F.lit(before), out.otherwise(F.left(t, F.lit(30))), F.lit(after))


def two_piece_summary(text: Column, least: int = 10, before: str = "本段讲的是") -> Column:
    """The first two pieces longer than ``least`` of the text split at 。, then at ！, then at ？; else its first 50 characters."""
    pieces = F.concat(*[F.split(text, d) for d in ("。", "！", "？")])
    kept = F.slice(F.filter(F.transform(pieces, strip), lambda x: F.length(x) > least), 1, 2)
    return F.concat(F.lit(before), F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "。"), F.lit("。"))).otherwise(F.concat(F.left(text, F.lit(50)), F.lit("。"))))


def every_third(text: Column, most: int = 300) -> Column:
    """Every third piece between 。！？, joined by 。, cut to ``most`` characters."""
    kept = F.filter(F.split(text, "[。！？]"), lambda x, i: i % 3 == 0)
    return F.left(F.array_join(kept, "。"), F.lit(most))


def stem(name: Column) -> Column:
    """The last path component without its last suffix."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


BOOK_NAME = r"^(.+?)_+([^_-]+)(?:[-_]+.*)?$"


def book_info(name: Column) -> tuple[Column, Column]:
    """(book, author) of ``book_author[-site]``; (stem, unknown) otherwise."""
    s = stem(name)
    hit = s.rlike(BOOK_NAME)
    return F.when(hit, F.regexp_extract(s, BOOK_NAME, 1)).otherwise(s), F.when(hit, F.regexp_extract(s, BOOK_NAME, 2)).otherwise("unknown")


def author_of(name: Column) -> Column:
    """What stands before the first underscore of a file name, else ``Unknown``."""
    return F.when(F.contains(name, F.lit("_")), F.split_part(name, F.lit("_"), F.lit(1))).otherwise("Unknown")


def mapped_name(name: Column, table: dict[str, str], default: str = "unknown") -> Column:
    """The value of the first key of ``table`` that occurs in ``name``."""
    out = None
    for k, v in table.items():
        out = F.when(F.contains(name, F.lit(k)), v) if out is None else out.when(F.contains(name, F.lit(k)), v)
    return out.otherwise(default)


def clean_reply(text: Column) -> Column:
    """A generated reply without chat tags, polite openings and code fences.

    The part after the last assistant marker; a trailing end tag, else everything from the last one, and everything from
    the first end-of-text tag is cut; blank and fence-only lines go.
    """
    marker, end, stop = "<|im_start|>assistant\n", "<|im_end|>", "<|endoftext|>"
    tail = F.substring_index(text, marker, -1)
    cut = F.regexp_replace(tail, r"(?s)^(.*)<\|im_end\|>.*\z", "$1")
    cut = F.substring_index(F.when(F.contains(tail, F.lit(end)), cut).otherwise(tail), stop, 1)
    out = strip(F.when(F.contains(text, F.lit(marker)), cut).otherwise(text))
    for p in POLITE:
        out = F.when(F.startswith(out, F.lit(p)), strip(F.substring(out, len(p) + 1, 1 << 30))).otherwise(out)
    return F.array_join(F.filter(lines(out), lambda x: ~strip(x).isin(*FENCES)), "\n")


#: Openings that a chat model puts before its answer, and lines of which nothing is kept.
POLITE = ["好的，请稍候片刻。", "好的，", "```python", "```", "Assistant:", "assistant:"]
FENCES = ["", "```", "```python", "Assistant:", "assistant:"]


def short_reply(text: Column) -> Column:
    """What stands before the first end tag, stripped."""
    return strip(F.substring_index(text, "<|im_end|>", 1))
