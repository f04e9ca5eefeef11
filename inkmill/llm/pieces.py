"""Splitting oversized texts at natural boundaries into balanced, overlapping pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.sources.tables import spread

LIMIT, OVERLAP = 1000, 50
#: A boundary is looked for within this share of the piece length on either side of its target.
REACH = 0.2
CLOSERS = "”’」』）】》〉\"')\\]"
#: What ends just before a boundary, strongest first: lines, sentences, parts of sentences, clauses, words.
BOUNDARIES = [
    re.compile(r"\n\s*\n|\r?\n"),
    re.compile(f"[。！？!?…]+[{CLOSERS}]*|\\.(?=\\s)|\\.[{CLOSERS}]+"),
    re.compile(f"[；;：:][{CLOSERS}]*|——"),
    re.compile(f"[，,、][{CLOSERS}]*"),
    re.compile(r"\s+"),
]


def _whole(text: str, at: int) -> int:
    """The nearest place at or before ``at`` that parts no line break and no letter from its marks."""
    import unicodedata

    low = max(1, at - 8)
    while at > low and (text[at - 1 : at + 1] == "\r\n" or unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def snap(text: str, target: int, reach: int) -> int:
    """The strongest boundary within ``reach`` of ``target``, of equal ones the nearest; the target itself where there is none."""
    low, high = max(1, target - reach), min(len(text) - 1, target + reach)
    base = max(0, low - 4)
    part = text[base : high + 4]
    for pattern in BOUNDARIES:
        found = [base + m.end() for m in pattern.finditer(part) if low <= base + m.end() <= high]
        if found:
            return min(found, key=lambda at: (abs(at - target), at))
    return _whole(text, target)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece: at most ``limit`` long, each starting ``overlap`` before the end of the last."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    least = -(-(n - overlap) // (limit - overlap))
    for count in range(least, 2 * least + 3):
        length = (n + (count - 1) * overlap) / count
        reach = int(REACH * length)
        out, start = [], 0
        for k in range(1, count):
            end = snap(text, round(k * (length - overlap) + overlap), reach)
            out.append((start, end))
            start = end - overlap
        out.append((start, n))
        if all(overlap < b - a <= limit for a, b in out):
            return out
    # No room to snap (a limit close to the overlap): equal pieces.
    ends = [min(n, limit + k * (limit - overlap)) for k in range(least)]
    return [(max(0, k * (limit - overlap)), e) for k, e in enumerate(ends)]


def split_oversized(df: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = True) -> DataFrame:
    """(key, piece_no, pieces, start, text) of every text longer than ``limit`` code points.

    Pieces are numbered from 1, hold at most ``limit`` code points and overlap by exactly ``overlap``; joining each piece
    without its first ``overlap`` code points (but for the first) gives the text again. The minimum number of pieces is
    placed at equal lengths and each end is moved to the strongest boundary nearby; a piece over the limit adds one piece
    and the placing starts anew. Null and empty texts give nothing; with ``oversized_only`` unset, shorter ones come out
    as their single piece. Rows delivered twice with one text come out once. Lengths are filtered before Python.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text).where(F.length(text) > (limit if oversized_only else 0)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, many, start, out = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                got = cuts(t, limit, overlap)
                for k, (a, b) in enumerate(got):
                    at.append(i)
                    no.append(k + 1)
                    many.append(len(got))
                    start.append(a)
                    out.append(t[a:b])
            ints = lambda x: pa.array(np.array(x, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ints(no), ints(many), ints(start), pa.array(out, pa.string())], names=[key, "piece_no", "pieces", "start", text])

    return rows.mapInArrow(run, f"`{key}` {kind}, piece_no int, pieces int, start int, `{text}` string")


def oversized_keys(df: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Keys whose text came out in several pieces."""
    return split_oversized(spread(df.select(key, text)), key, text, limit, overlap).where("pieces > 1").select(key).distinct()
