"""Sentence splitting and chunking; expressions on one row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import strip

SENTENCE_ENDS = "。！？…\\n"
#: Sentence ends and closing quotes of the fixed-target chunkers.
TARGET_ENDS_ZH, TARGET_ENDS = "。！？；…", "。！？；….!?"
TARGET_QUOTES = "」』》”’）】\"'"
LOSSY_ENDS = "。！？!?」』\"'>》}】\\]"
CLOSING = "。！？!?」』\"'>》}】]”’"
QUOTES = "」』\"”’"


def sentences(text: Column, ends: str = SENTENCE_ENDS) -> Column:
    """Sentences with their ends, lossless: joined they give the text. Without an ended sentence the text is one."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^{ends}]*[{ends}]+|[^{ends}]+"), F.lit(0))
    return F.when(text == "", F.array().cast("array<string>")).when(~text.rlike(f"[^{ends}][{ends}]"), F.array(text)).otherwise(pieces)


def lossy_sentences(text: Column, ends: str = LOSSY_ENDS) -> Column:
    """Sentences, each stripped and followed by its one end; blank ones vanish together with their end."""
    pattern = F.lit(f"([^{ends}]+)([{ends}]?)")
    body, end = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    pairs = F.zip_with(body, end, lambda a, b: F.when(strip(a) != "", F.concat(strip(a), b)).otherwise(""))
    return F.filter(pairs, lambda x: x != "")


def target_chunks(text: Column, target: int = 800, ends: str = TARGET_ENDS, quotes: str = TARGET_QUOTES) -> Column:
    """Chunks cut at the first sentence end from ``target`` characters on, closing quotes included; stripped, blank ones dropped."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{{target - 1},}}?[{ends}][{quotes}]*|.+"), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def forced_chunks(text: Column, size: int = 512) -> Column:
    """Slices of ``size`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def numbered(df: DataFrame, chunks: Column, keep: list[str], name: str = "chunk", base: int = 0) -> DataFrame:
    """One row per chunk: ``keep``, its number from ``base`` and its text. Null and empty texts give none."""
    out = df.select(*keep, F.posexplode(chunks).alias("_pos", name))
    return out.select(*keep, (F.col("_pos") + base).alias(f"{name}_no"), name)


def line_pipeline(text: Column, target: int = 800) -> Column:
    """A scanned book's text: blank, header and navigation lines dropped, openings taken off, lines joined, cut at ``target``."""
    from inkmill.functions.rules import drop_opening, is_header, is_navigation

    kept = F.filter(lines_of(text), lambda x: (strip(x) != "") & ~is_header(x) & ~is_navigation(x))
    return target_chunks(F.array_join(F.transform(kept, drop_opening), ""), target, TARGET_ENDS_ZH)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")
