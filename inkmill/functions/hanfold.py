"""Traditional to Simplified characters, and letter keys that look past script, case, width and punctuation.

The character map is taken from the ICU transliterator that Spark ships, once per driver process, over the whole
CJK range; it is a few thousand pairs whatever the data.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: CJK Extension A and the Unified Ideographs.
RANGES = ((0x3400, 0x4DC0), (0x4E00, 0xA000))
#: Variant characters that ICU leaves apart and that are one character in ordinary use.
VARIANTS = {"疎": "疏", "嶽": "岳", "祇": "只", "彷": "仿", "裏": "里"}

_maps: dict[str, dict[str, str]] = {}


def _transliterate(spark: SparkSession, name: str, chars: list[str]) -> dict[str, str]:
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(name)
    out = icu.transliterate("\n".join(chars)).split("\n")
    return {a: b for a, b in zip(chars, out) if a != b and len(b) == 1}


def simplify_map(spark: SparkSession) -> dict[str, str]:
    """Traditional to Simplified, character by character."""
    if "t2s" not in _maps:
        chars = [chr(c) for lo, hi in RANGES for c in range(lo, hi)]
        _maps["t2s"] = _transliterate(spark, "Traditional-Simplified", chars)
        _maps["s2t"] = _transliterate(spark, "Simplified-Traditional", chars)
    return _maps["t2s"]


def fold_map(spark: SparkSession) -> dict[str, str]:
    """One representative for all characters that either script writes for another (for keys, not for display)."""
    if "fold" not in _maps:
        t2s = simplify_map(spark)
        s2t, fold = _maps["s2t"], {}
        for c in [chr(c) for lo, hi in RANGES for c in range(lo, hi)]:
            x = t2s.get(c, c)
            x = s2t.get(x, x)
            x = t2s.get(x, x)
            x = VARIANTS.get(x, x)
            if x != c:
                fold[c] = x
        _maps["fold"] = fold
    return _maps["fold"]


#: Full-width ASCII and the ideographic space, and what they stand for.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def to_simplified(spark: SparkSession, text: Column) -> Column:
    """The text in Simplified script; JVM-side, one map lookup per character."""
    pairs = sorted(simplify_map(spark).items())
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def letters(text: Column) -> Column:
    """Only the letters, lower case, full width folded."""
    return F.regexp_replace(F.lower(half_width(text)), r"[^\p{L}]+", "")


def fold_key(spark: SparkSession, text: Column) -> Column:
    """Only the letters, lower case, in one script: equal for texts that differ in spacing, signs, width or script."""
    pairs = sorted(fold_map(spark).items())
    return F.translate(letters(text), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def fold_pairs(spark: SparkSession) -> tuple[str, str]:
    """The fold map as two strings of equal length, small enough (20 kB) to ride along with a task."""
    pairs = sorted(fold_map(spark).items())
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=4)
def letter_table(sources: str, targets: str) -> np.ndarray:
    """By code point: the folded lower-case letter, 0 for what is no letter."""
    import unicodedata

    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    full = np.arange(0xFF01, 0xFF5F)
    table[full] = table[full - 0xFEE0]
    table[[ord(c) for c in sources]] = [ord(c) for c in targets]
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
