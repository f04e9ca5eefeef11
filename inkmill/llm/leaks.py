"""Evaluation texts inside a training corpus.

Each shard of the corpus (a batch of documents) gets a suffix array over its folded letters, in lexicographic order. It is
sparse: only suffixes whose first ``SEED`` letters begin some evaluation suffix are kept, since no other can share a match
that long. Every evaluation suffix is binary-searched in it; the suffixes it shares ``SEED`` letters with, followed along
their diagonals, give the longest verbatim matches and their places. Places where matches lie close together are verified
letter by letter, so that changed letters between verbatim stretches do not hide a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.hanfold import code_points, fold_pairs, letter_table
from inkmill.sources.tables import spread

#: Letters of a verbatim match that opens a candidate.
SEED = 8
#: Letters of an item that must stand in the document one after another, and the share of changed letters allowed.
LEAST, CHANGED = 40, 1 / 15
#: Letters of matches along one diagonal band before a place is verified.
BAND, WORTH = 8, 16
#: Letters a shard holds at most (a longer single document is a shard of its own) and pairs expanded at once.
SHARD, PAIRS = 1 << 20, 1 << 21
#: Bound of the evaluation letters that ride along with the tasks; more items go in blocks, each over the whole corpus.
MOST_LETTERS = 20_000_000
#: Letters compared at once when suffixes are put in order (21 bits each).
PACK = 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def seed_hashes(letters: np.ndarray, size: int = SEED) -> np.ndarray:
    """A rolling hash of every stretch of ``size`` (a power of two) letters."""
    h, step = letters.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), 1
    power = int(MULTIPLIER)
    while step < size:
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % (1 << 64)
        step *= 2
    return h ^ (h >> np.uint64(31))


def stretch_codes(letters: np.ndarray, size: int) -> np.ndarray:
    """A code of every stretch of ``size`` letters, for any size."""
    h = np.full(max(0, len(letters) - size + 1), size, np.uint64)
    for j in range(size):
        h = h * MULTIPLIER + letters[j : j + len(h)].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(31))


def suffix_order(letters: np.ndarray, at: np.ndarray, ends: np.ndarray, depth: int, known: np.ndarray | None = None) -> np.ndarray:
    """The order of the suffixes that begin ``at`` and stop at ``ends``, letter by letter, as far as ``depth`` letters.

    Equal ones are refined by the next ``PACK`` letters until they differ or end; ``known``: ranks of the first ones.
    """
    rank = np.zeros(len(at), dtype=np.int64) if known is None else known.astype(np.int64)
    order, done = np.argsort(rank, kind="stable"), 0 if known is None else SEED
    padded = np.append(letters, np.zeros(PACK, letters.dtype)).astype(np.int64)
    # Only the places of suffixes that are still tied are sorted again; a group of equals keeps its stretch of places.
    spots, group = np.arange(len(at)), rank[order]
    while done < depth:
        edge = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, dtype=bool)
        tied = ~(edge & np.append(edge[1:], True))
        spots, group = spots[tied], np.cumsum(edge)[tied]
        if not len(spots):
            break
        rows = order[spots]
        key = np.zeros(len(rows), dtype=np.int64)
        for j in range(PACK):
            place = np.minimum(at[rows] + done + j, len(letters))
            key = key << 21 | np.where(place < ends[rows], padded[place] + 1, 0)
        by = np.lexsort((key, group))
        order[spots] = rows[by]
        group, key = group[by], key[by]
        done += PACK
        # Equal ones that have ended stay equal: they go on as groups of one.
        over = key & 0x1FFFFF == 0
        change = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        group = np.where(over, -1 - np.arange(len(key)), np.cumsum(change))
    return order


class Items:
    """The evaluation side: letters, and its suffixes in lexicographic order of their first ``SEED`` letters."""

    def __init__(self, ids: list[int], texts: list[str], folds: tuple[str, str]):
        table = letter_table(*folds)
        parts = []
        for t in texts:
            x = table[code_points(t)] if t else np.zeros(0, np.uint32)
            parts.append(x[x > 0])
        self.ids = np.array(ids, dtype=np.int64)
        self.letters = parts
        self.sizes = np.array([len(x) for x in parts], dtype=np.int64)
        self.longest = int(self.sizes.max()) if len(parts) else 0
        hashes, owners, places = [], [], []
        for i, x in enumerate(parts):
            h = seed_hashes(x)
            hashes.append(h)
            owners.append(np.full(len(h), i))
            places.append(np.arange(len(h)))
        join = lambda x, kind: (np.concatenate(x) if x else np.zeros(0)).astype(kind)
        h, owner, place = join(hashes, np.uint64), join(owners, np.int64), join(places, np.int64)
        self.seeds, first, at = np.unique(h, return_index=True, return_inverse=True)
        # Seeds by hash, for looking up; their ranks in the order of letters, for the suffix array.
        letters, starts = join(parts, np.uint32), np.concatenate([[0], np.cumsum(self.sizes)])
        begin = starts[owner[first]] + place[first] if len(first) else np.zeros(0, np.int64)
        self.ranks = np.empty(len(self.seeds), dtype=np.int64)
        self.ranks[suffix_order(letters, begin, begin + SEED, SEED)] = np.arange(len(self.seeds))
        rank = self.ranks[at] if len(at) else np.zeros(0, np.int64)
        order = np.argsort(rank, kind="stable")
        self.rank, self.owner, self.place = rank[order], owner[order], place[order]
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[self.seeds >> np.uint64(44)] = True
        self.short = {n: [i for i in np.flatnonzero(self.sizes == n)] for n in range(1, SEED) if (self.sizes == n).any()}


def longest_stretch(doc: np.ndarray, item: np.ndarray, shift: int, slack: int = 5) -> int:
    """Letters of the longest part of ``item`` that stands in ``doc`` (item position + shift, give or take ``slack``) with few letters changed."""
    n = len(item)
    cover = np.zeros(n, dtype=bool)
    for d in range(shift - slack, shift + slack + 1):
        lo, hi = max(0, -d), min(n, len(doc) - d)
        if hi - lo < 3:
            continue
        same = item[lo:hi] == doc[lo + d : hi + d]
        three = same[:-2] & same[1:-1] & same[2:]  # lone letters agree by chance
        part = cover[lo:hi]
        part[:-2] |= three
        part[1:-1] |= three
        part[2:] |= three
    # A changed letter may also cost the one or two sound ones beside it that no run of three covers.
    gain = np.where(cover, 2 * CHANGED, 2 * CHANGED - 1)
    total = np.concatenate([[0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    high = np.maximum.accumulate(total[::-1])[::-1]
    i = j = best = 0
    while j <= n:
        if high[j] >= low[i] - 1e-9:
            best, j = max(best, j - i), j + 1
        else:
            i += 1
            j = max(j, i)
    return best


def shard_array(items: Items, letters: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks of their seeds): the sparse suffix array of a shard's documents, which stand end to end in ``letters``."""
    h = seed_hashes(letters)
    if not len(h) or not len(items.seeds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = owner[: len(h)] == owner[SEED - 1 : SEED - 1 + len(h)]
    at = np.flatnonzero(inside & items.known[h >> np.uint64(44)])
    spot = np.searchsorted(items.seeds, h[at])
    spot[spot == len(items.seeds)] = 0
    hit = items.seeds[spot] == h[at]
    at, rank = at[hit], items.ranks[spot[hit]]
    order = suffix_order(letters, at, bounds[owner[at] + 1], items.longest, rank)
    return at[order], rank[order]


def shard_matches(items: Items, letters: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, item, document place, item place) of all suffixes that share their first letters, in blocks."""
    array, ranks = shard_array(items, letters, owner, bounds)
    if not len(array):
        return
    left = np.searchsorted(ranks, items.rank, "left")
    many = np.searchsorted(ranks, items.rank, "right") - left
    upto = np.concatenate([[0], np.cumsum(many)])
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
        reps = many[i:j]
        total = int(reps.sum())
        if total:
            suffix = np.repeat(np.arange(i, j), reps)
            within = np.arange(total) - np.repeat(upto[i:j] - upto[i], reps)
            place = array[np.repeat(left[i:j], reps) + within]
            yield owner[place], items.owner[suffix], place, items.place[suffix]
        i = j


def verbatim_matches(pair: np.ndarray, place: np.ndarray, spot: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """pair -> (letters, document place, item place) of its longest verbatim match: the longest run of seeds along one diagonal."""
    order = np.lexsort((place, place - spot, pair))
    pair, place, spot = pair[order], place[order], spot[order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (place[1:] != place[:-1] + 1) | (spot[1:] != spot[:-1] + 1)))
    size = np.diff(np.append(first, len(pair))) + SEED - 1
    best = np.lexsort((place[first], -size, pair[first]))
    best = best[np.append(True, pair[first][best][1:] != pair[first][best][:-1])]
    return dict(zip(pair[first][best].tolist(), zip(size[best].tolist(), place[first][best].tolist(), spot[first][best].tolist())))


def short_matches(items: Items, letters: np.ndarray, owner: np.ndarray) -> list[tuple[int, ...]]:
    """Items shorter than a seed, wherever they stand as a whole."""
    out = []
    for n, some in items.short.items():
        codes = stretch_codes(letters, n)
        want = {int(stretch_codes(items.letters[i], n)[0]): i for i in some}
        at = np.flatnonzero(np.isin(codes, np.array(list(want), dtype=np.uint64)) & (owner[: len(codes)] == owner[n - 1 : n - 1 + len(codes)])) if len(codes) else []
        for p in at:
            for i in some:
                if (letters[p : p + n] == items.letters[i]).all():
                    out.append((int(owner[p]), int(i), n, n, int(p), 0))
    return list({x[:2]: x for x in reversed(out)}.values())


def shard_leaks(items: Items, letters: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> list[tuple[int, ...]]:
    """(document index, item index, letters, verbatim letters, their place in ``letters``, in the item) of the passages found in a shard."""
    width, count = np.int64(1) << np.int64(24), len(items.ids)
    found = [np.stack([doc * count + item, place, spot]) for doc, item, place, spot in shard_matches(items, letters, owner, bounds)]
    if not found:
        return []
    pair, place, spot = np.concatenate(found, axis=1)
    exact = verbatim_matches(pair, place, spot)
    need = {p: min(LEAST, int(items.sizes[p % count])) for p in exact}
    best = {p: n for p, (n, _, _) in exact.items() if n >= need[p]}
    # What is not there word for word: bands of diagonals with enough matches, in two overlapping sets, so that a slip by a letter or two stays in one of them.
    open_ = np.array([p for p in exact if p not in best], dtype=np.int64)
    rest = np.isin(pair, open_)
    pair, diagonal = pair[rest], place[rest] - spot[rest]
    own = diagonal - bounds[pair // count]
    keys = np.concatenate([((pair * width + (own + (1 << 22) + shift * BAND // 2) // BAND) * 2 + shift) for shift in (0, 1)])
    pair, own = np.tile(pair, 2), np.tile(own, 2)
    order = np.argsort(keys, kind="stable")
    keys, pair, own = keys[order], pair[order], own[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    seeds = np.diff(np.append(edge, len(keys)))
    sizes = items.sizes[pair[edge] % count]
    keep = (seeds + SEED - 1 >= WORTH) | ((sizes < LEAST) & (seeds >= np.minimum(3, sizes - SEED + 1)))
    middle = (edge + seeds // 2)[keep]
    tried = set()
    for p, d in zip(pair[middle].tolist(), own[middle].tolist()):
        if best.get(p, 0) >= need[p] or (p, d) in tried:
            continue
        tried.add((p, d))
        doc, item = divmod(p, count)
        best[p] = max(best.get(p, 0), longest_stretch(letters[bounds[doc] : bounds[doc + 1]], items.letters[item], d))
    return [(*divmod(p, count), n, *exact[p]) for p, n in best.items()]


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, item_key, letters, verbatim, start, end, item_start): documents that contain at least ``least`` letters of an item, or the whole of a shorter one.

    Spacing, punctuation, case and script are set aside; about one letter in fifteen may differ. ``verbatim`` are the
    letters of the longest match without a change, ``start`` and ``end`` its place in the text as stored, ``item_start``
    its first letter among the item's letters. Null and empty texts on either side match nothing; repeated rows repeat in
    the result. The items ride along with the tasks, ``MOST_LETTERS`` at a time; the corpus is not shuffled.
    """
    size = items.agg(F.sum(F.length(item_text))).head()[0] or 0
    blocks = 1 if size <= MOST_LETTERS else -(-4 * size // (3 * MOST_LETTERS))
    made = [_block_leaks(documents, items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == k), key, text, item_key, item_text, least) for k in range(blocks)]
    return reduce(DataFrame.unionByName, made)


def _block_leaks(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, least: int) -> DataFrame:
    spark = documents.sparkSession
    rows = [(r[0], r[1]) for r in items.select(item_key, item_text).where(F.col(item_text).isNotNull()).collect()]
    folds = fold_pairs(spark)
    shared = spark.sparkContext.broadcast((rows, folds))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, folds = shared.value
        held = Items([r[0] for r in rows], [r[1] for r in rows], folds)
        table = letter_table(*folds)
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and (end == at or total + len(texts[end] or "") <= SHARD):
                    total += len(texts[end] or "")
                    end += 1
                part = [t or "" for t in texts[at:end]]
                folded = table[code_points("".join(part))]
                starts = np.concatenate([[0], np.cumsum([len(t) for t in part])])
                owner = np.repeat(np.arange(len(part)), np.diff(starts))
                sound = np.flatnonzero(folded)
                letters, owner = folded[sound], owner[sound]
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                found = short_matches(held, letters, owner)
                for row in shard_leaks(held, letters, owner, bounds):
                    need = min(least, int(held.sizes[row[1]]))
                    # A letter changed beside either end of a passage cannot be told from its edge.
                    if row[2] >= need - 1 - need // 25:
                        found.append(row)
                if found:
                    doc, item, n, exact, place, spot = np.array(found, dtype=np.int64).T
                    docs = keys.slice(at, end - at).take(pa.array(doc))
                    first, last = sound[place] - starts[doc], sound[place + exact - 1] - starts[doc] + 1
                    yield pa.RecordBatch.from_arrays([docs, *(pa.array(x) for x in (held.ids[item], n, exact, first, last, spot))], names=[key, item_key, "letters", "verbatim", "start", "end", "item_start"])
                at = end

    return spread(documents.select(key, text).where(F.col(text).isNotNull())).mapInArrow(run, f"`{key}` {kind}, `{item_key}` bigint, letters bigint, verbatim bigint, start bigint, end bigint, item_start bigint")


def without_leaks(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that contain no evaluation passage; a row without a key cannot be named and stays."""
    return documents.join(found.select(key).distinct(), key, "left_anti")
