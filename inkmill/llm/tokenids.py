"""Encoding a whole corpus with a public byte-level BPE tokenizer.

Boundaries of the pre-tokens come from arrays, not from a regular expression: every code point has a class, every
class is a transition function over a few lexer states, and the functions of a whole batch are composed by an
associative scan (blocks first, then a prefix over the blocks). The slices between boundaries go through a cached
pair merger. ``offsets`` keep each token's bytes, so every document can be decoded exactly.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkmill.functions.hanfold import code_points

LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE2, QUOTE3, RESET = range(8)
#: Lexer states after a character: nothing read, inside a run of each class, one or two letters of a contraction due, a contraction just ended.
START, IN_L, IN_N, IN_O, IN_S, IN_W, DUE1, DUE2, ENDED = range(9)
#: White space in the sense of the Unicode property White_Space, beyond ASCII.
WHITE_SPACE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points handled at once; bounds the working memory of a task, not what is encoded.
BLOCK = 1 << 20
#: Cached slices per worker; when full, the cache starts anew.
CACHE = 200_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[32] = SPACE
    return table


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(generator of each class, composition table, function values) of the lexer's transition functions."""
    const = lambda s: (s,) * 9
    letter = tuple({DUE1: ENDED, DUE2: DUE1}.get(s, IN_L) for s in range(9))
    quote = lambda due: tuple(IN_O if s in (IN_O, IN_S) else due for s in range(9))
    made = [letter, const(IN_N), const(IN_O), const(IN_S), const(IN_W), quote(DUE1), quote(DUE2), const(START)]
    functions = [*dict.fromkeys(made)]
    grown = True
    while grown:
        grown = False
        for f in list(functions):
            for g in list(functions):
                h = tuple(g[f[s]] for s in range(9))
                if h not in functions:
                    functions.append(h)
                    grown = True
    index = {f: i for i, f in enumerate(functions)}
    compose = np.array([[index[tuple(g[f[s]] for s in range(9))] for g in functions] for f in functions], dtype=np.uint8)
    return np.array([index[f] for f in made], dtype=np.uint8), compose, np.array(functions, dtype=np.uint8)


def scan_states(classes: np.ndarray) -> np.ndarray:
    """The lexer state before each character: an exclusive associative scan of the transition functions."""
    generator, compose, values = monoid()
    n, width = len(classes), 256
    rows = -(-n // width)
    f = np.full(rows * width, generator[RESET], dtype=np.uint8)
    f[:n] = generator[classes]
    f = np.ascontiguousarray(f.reshape(rows, width).T)
    whole = f[0].copy()
    for k in range(1, width):
        whole = compose[whole, f[k]]
    step = 1
    while step < rows:  # prefix over the blocks by doubling
        whole[step:] = compose[whole[:-step], whole[step:]]
        step *= 2
    state = np.full(rows, START, dtype=np.uint8)
    state[1:] = values[whole[:-1], START]
    out = np.empty((width, rows), dtype=np.uint8)
    for k in range(width):
        out[k] = state
        state = values[f[k], state]
    return out.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Indices where a pre-token begins. ``firsts``: where each (non-empty) text begins; texts stand end to end."""
    n = len(points)
    kind = class_table()[points]
    last = np.zeros(n + 4, dtype=bool)  # the next character belongs to another text
    last[firsts[1:] - 1] = True
    last[n - 1] = True
    ahead = np.append(points, np.zeros(2, points.dtype))
    a, b = ahead[1 : n + 1], ahead[2 : n + 2]
    one = ~last[:n]
    two = one & ~last[1 : n + 1]
    is_quote = points == 39
    short = is_quote & one & np.isin(a, [ord(c) for c in "stmd"])
    long_ = is_quote & two & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    kind[short] = QUOTE2
    kind[long_] = QUOTE3
    # A reset function stands in front of every text, so that none reads on from the one before.
    at = np.arange(n) + np.searchsorted(firsts, np.arange(n), side="right")
    classes = np.full(n + len(firsts), RESET, dtype=np.uint8)
    classes[at] = kind
    before = scan_states(classes)[at]
    white = (kind == SPACE) | (kind == WHITE)
    was_white = (before == IN_S) | (before == IN_W)
    start = np.ones(n, dtype=bool)
    start[kind == LETTER] = ~np.isin(before[kind == LETTER], [IN_L, IN_S, DUE1, DUE2])
    start[kind == NUMBER] = ~np.isin(before[kind == NUMBER], [IN_N, IN_S])
    other = (kind == OTHER) | (kind == QUOTE2) | (kind == QUOTE3)
    start[other] = ~np.isin(before[other], [IN_O, IN_S])
    next_white = np.append(white[1:], False) | last[:n]
    start[white] = ~was_white[white] | ~next_white[white]
    start[firsts] = True
    return np.flatnonzero(start)


class Encoder:
    """Slices to ids through a bounded cache over the vocabulary's pair merger."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken._tiktoken.CoreBPE(ranks, {}, r"[\s\S]+").encode_single_piece
        self.cache: dict[bytes, list[int]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, number of ids of each text)."""
        sizes = np.zeros(len(texts), dtype=np.int64)
        chosen = [i for i, t in enumerate(texts) if t]
        if not chosen:
            return np.zeros(0, np.int32), sizes
        whole = "".join(texts[i] for i in chosen)
        points = code_points(whole)
        lengths = np.array([len(texts[i]) for i in chosen])
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        starts = boundaries(points, firsts)
        widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(widths)])
        data = whole.encode("utf-8", "surrogatepass")
        cuts = [*byte_at[starts].tolist(), len(data)]
        cache, merge, ids, counts = self.cache, self.merge, [], []
        for i in range(len(cuts) - 1):
            piece = data[cuts[i] : cuts[i + 1]]
            got = cache.get(piece)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = cache[piece] = merge(piece)
            ids += got
            counts.append(len(got))
        upto = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
        edge = np.append(np.searchsorted(starts, firsts), len(starts))
        sizes[chosen] = upto[edge[1:]] - upto[edge[:-1]]
        return np.array(ids, dtype=np.int32), sizes


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, offsets: bool = False) -> DataFrame:
    """(key, ids) of every row: the ids of ``text`` without special tokens; with ``offsets`` also the byte at which each token begins.

    Null and empty texts get the empty list. Rows are independent, so nothing is shuffled; other columns are not read.
    """
    path = vocabulary or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= BLOCK):
                    size += len(texts[end] or "")
                    end += 1
                ids, sizes = tool.encode([t or "" for t in texts[at:end]])
                edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns = [ids]
                if offsets:
                    begins = np.concatenate([[0], np.cumsum(widths(path)[ids])]) if len(ids) else np.zeros(1, np.int64)
                    columns.append((begins[:-1] - np.repeat(begins[edges[:-1]], sizes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), *(pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in columns)], names=[key, "ids", "offsets"][: 1 + len(columns)])
                at = end

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else ""))


@lru_cache(maxsize=2)
def _pieces_by_id(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def widths(path: str) -> np.ndarray:
    """Bytes of each token, by id."""
    pieces = _pieces_by_id(path)
    out = np.zeros(max(pieces) + 1, dtype=np.int64)
    out[list(pieces)] = [len(x) for x in pieces.values()]
    return out


def decode(ids: list[int], vocabulary: str | None = None) -> tuple[str, list[int]]:
    """(text, byte offset of each token) of a list of ids."""
    table = _pieces_by_id(vocabulary or default_vocabulary())
    parts = [table[i] for i in ids]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[: len(parts)]
    return b"".join(parts).decode("utf-8", "replace"), [int(x) for x in offsets]
