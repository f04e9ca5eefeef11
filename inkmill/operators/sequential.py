"""Chunkers whose next cut depends on the last one, an Arrow batch at a time: over arrays of sentence lengths, with any tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkmill.operators import chunking

Encode = Callable[[str], list]
Decode = Callable[[list], str]


def split_sentences(text: str, ends: str = "。！？…\n") -> list[str]:
    """Sentences with their ends, lossless."""
    if not text:
        return []
    inner = re.escape(ends)
    if not re.search(f"[^{inner}][{inner}]", text):
        return [text]
    return re.findall(f"[^{inner}]*[{inner}]+|[^{inner}]+", text)


def gather(parts: list[str], most: int) -> list[str]:
    """Sentences gathered while they fit; each jump is one search in the summed lengths."""
    if not parts:
        return []
    upto = np.cumsum([len(p) for p in parts])
    out, at = [], 0
    while at < len(parts):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        out.append("".join(parts[at:end]))
        at = end
    return out


def lossy(text: str) -> list[str]:
    out = []
    for body, end in re.findall(f"([^{chunking.LOSSY_ENDS}]+)([{chunking.LOSSY_ENDS}]?)", text):
        body = body.strip()
        if body:
            out.append(body + end)
    return out


def budget_edges(sizes: np.ndarray, closed: np.ndarray, most: int) -> list[int]:
    """Where chunks of sentences that each fit end: as many as fit, and one more where the last of them is not closed."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    # From every sentence at once: the first that no longer fits, and the end of the chunk that begins there.
    fits = np.minimum(np.searchsorted(upto, upto[:-1] + most, "right") - 1, len(sizes))
    ends = np.minimum(fits + ~closed[fits - 1], len(sizes))
    edges, at = [], 0
    while at < len(sizes):
        at = int(ends[at])
        edges.append(at)
    return edges


def quotes_back(pieces: list[str]) -> list[str]:
    """Stripped pieces; closing quotes at the head of one stand at the end of the one before, blank ones vanish."""
    pieces = [p for p in map(str.strip, pieces) if p]
    mark = next(c for c in map(chr, range(1, 0x110000)) if not c.isspace() and not any(c in p for p in pieces))
    inner = re.escape(mark + chunking.QUOTES)
    head = re.compile(rf"{re.escape(mark)}(?:[{inner}]\s*)*")
    joined = head.sub(lambda m: "".join(c for c in m.group() if c != mark and not c.isspace()) + mark, mark.join(pieces))
    return [p for p in joined.split(mark) if p]


def under_budget(parts: list[str], most: int, encode: Encode | None = None, decode: Decode | None = None) -> list[str]:
    """Sentences gathered under a budget of tokens (characters without ``encode``), chunks ended at closing punctuation.

    Sentences over the budget are sliced and part the others into runs; within a run the ends of chunks come from sums.
    """
    ids = [encode(p) for p in parts] if encode else parts
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    closed = np.array([p[-1:] in chunking.CLOSING for p in parts], dtype=bool)
    pieces, start = [], 0
    for wall in [*np.flatnonzero(sizes > most).tolist(), len(parts)]:
        run = [start, *(start + e for e in budget_edges(sizes[start:wall], closed[start:wall], most))]
        pieces += ["".join(parts[a:b]) for a, b in zip(run, run[1:])]
        if wall < len(parts):
            slices = [ids[wall][i : i + most] for i in range(0, len(ids[wall]), most)]
            pieces += [decode(x) for x in slices] if encode else slices
        start = wall + 1
    return quotes_back(pieces)


def chunk_rows(df: DataFrame, key: str, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """(key, chunk_no from 0, chunk) of ``cut``; null and empty texts give none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, out = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                got = cut(t) if t else []
                at += [i] * len(got)
                no += range(len(got))
                out += got
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(out, pa.string())], names=[key, "chunk_no", "chunk"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_no int, chunk string")


def greedy_rows(df: DataFrame, key: str, text: str, most: int = 800) -> DataFrame:
    return chunk_rows(df, key, text, lambda t: gather(split_sentences(t), most))


def budget_rows(df: DataFrame, key: str, text: str, most: int = 512, encode: Encode | None = None, decode: Decode | None = None) -> DataFrame:
    return chunk_rows(df, key, text, lambda t: under_budget(lossy(t), most, encode, decode))


def library_tokenizer(path: str) -> tuple[Encode, Decode]:
    """(encode, decode) of a tokenizer file in the JSON format of the ``tokenizers`` library, loaded once per worker."""
    return (lambda t: _loaded(path).encode(t, add_special_tokens=False).ids), (lambda ids: _loaded(path).decode(ids, skip_special_tokens=False))


@lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return tool
