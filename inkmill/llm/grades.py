"""Reading level of documents from the acquisition grade of their words.

The words are learnt from a graded sample: single letters, and stretches of two to four that stand together far more
often than their parts would by chance. A word's acquisition grade comes from how its uses are distributed over the graded texts: its rates
per level, smoothed, give the mean level at which it is met. A document is described by quantiles of its known words'
grades. They are calibrated on the labelled documents: for each quantile, edges between levels stand midway between the
levels' medians, so each quantile names a level, and the level named most often is the one of most of the text. Words
outside the dictionary are unknown and say nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.hanfold import code_points, fold_pairs, letter_table
from inkmill.sources.tables import spread

LEVELS = (1, 2, 3, 4)
#: Letters looked up at once.
BLOCK = 1 << 18
#: Bound of the labelled documents that the model is fitted on, in the order of a hash; every document is then scored.
FIT_DOCUMENTS = 2000
#: A word stands in this many of the labelled documents, has so many letters, and stands together so many times as often as by chance.
LEAST_DOCUMENTS, SIZES, COHESION = 3, (1, 2, 3, 4), {1: 0.0, 2: 8.0, 3: 20.0, 4: 20.0}
#: Quantiles of the known words' grades that are calibrated.
QUANTILES = tuple(k / 20 for k in range(1, 20))
#: Pseudo-uses that every word has, spread over the levels as the letters are.
SMOOTHING = 1.0


def stretches(letters: np.ndarray, size: int) -> np.ndarray:
    """A code for the stretch of ``size`` letters that begins at each letter."""
    x = letters.astype(np.uint64)
    h = np.full(max(0, len(x) - size + 1), size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + len(h)] + np.uint64(1)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


class Table:
    """A sorted table of codes with a value each; the first bits of a code say where to look."""

    BITS = 20

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        # A last entry that no slot leads to ends every look-up.
        self.codes, self.values = np.append(codes, np.uint64(0)), np.append(values, np.nan)
        self.first = np.searchsorted(codes >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1).astype(np.uint64)).astype(np.int32)
        self.deep = int(np.diff(self.first).max())

    def __reduce__(self):
        # The slots are made anew where the table arrives.
        return Table, (self.codes[:-1], self.values[:-1])

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``codes`` of known ones, in order; their values)."""
        slot = (codes >> np.uint64(64 - self.BITS)).astype(np.int64)
        low, high = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(low < high)
        places, entries = [], []
        for j in range(self.deep):
            left = left[low[left] + j < high[left]]
            hit = self.codes[low[left] + j] == codes[left]
            places.append(left[hit])
            entries.append(low[left[hit]] + j)
            left = left[~hit]
        at, entry = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, entries))
        order = np.argsort(at, kind="stable")
        return at[order], self.values[entry[order]]


def found_at(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each code is in the sorted table, where)."""
    if not len(table):
        return np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=np.int64)
    at = np.searchsorted(table, codes)
    at[at == len(table)] = 0
    return table[at] == codes, at


def mainly_chinese(points: np.ndarray, table: np.ndarray) -> bool:
    """Whether most letters are Han characters and kana or other scripts do not run through the text."""
    letter = table[points] > 0
    han = ((points >= 0x3400) & (points < 0xA000)) | (points >= 0x20000)
    kana = (points >= 0x3041) & (points <= 0x30FF) & letter
    latin = letter & (points < 0x250)
    # A word of three letters weighs as much as one Han character.
    n = int(han.sum())
    rest = int((letter & ~han & ~latin).sum()) + int(latin.sum()) / 3
    return n > 0 and n > rest and int(kana.sum()) * 6 < n


class Grades:
    """The dictionary of words, their grades, and the calibrated quantiles."""

    def __init__(self, texts: list[str], levels: list[int], folds: tuple[str, str]):
        table = letter_table(*folds)
        kept = [(table[p][table[p] > 0], lv) for p, lv in ((code_points(t), lv) for t, lv in zip(texts, levels)) if mainly_chinese(p, table)]
        self.seen = sorted({lv for _, lv in kept})
        self.words = {q: Table(np.zeros(0, np.uint64), np.zeros(0)) for q in SIZES}
        self.edges = np.zeros((0, len(QUANTILES)))
        if not kept:
            self.seen = [LEVELS[1]]
            return
        letters = np.concatenate([x for x, _ in kept])
        doc = np.repeat(np.arange(len(kept)), [len(x) for x, _ in kept])
        level = np.array([lv for _, lv in kept])
        for size, words in self.dictionary(letters, doc, min(LEAST_DOCUMENTS, len(kept))).items():
            self.words[size] = Table(words, self.acquisition(words, stretches(letters, size), level[doc[: max(0, len(letters) - size + 1)]]))
        got = self.profiles(letters, np.array([len(x) for x, _ in kept]))
        some = [i for i, x in enumerate(got) if x is not None]
        labels, profiles = level[some], np.array([got[i] for i in some]).reshape(-1, len(QUANTILES))
        self.seen = sorted(set(labels.tolist())) or [LEVELS[1]]
        # The median over a level's documents is robust to a rater's slip.
        centres = np.array([np.median(profiles[labels == lv], axis=0) for lv in self.seen if (labels == lv).any()]).reshape(-1, len(QUANTILES))
        self.edges = (centres[1:] + centres[:-1]) / 2

    @staticmethod
    def dictionary(letters: np.ndarray, doc: np.ndarray, least: int) -> dict[int, np.ndarray]:
        """Sorted codes of the words of each size."""
        codes = {q: stretches(letters, q) for q in range(1, max(SIZES) + 1)}
        tables = {q: np.unique(c, return_counts=True) for q, c in codes.items()}

        def count(q: int, c: np.ndarray) -> np.ndarray:
            hit, at = found_at(tables[q][0], c)
            return np.where(hit, tables[q][1][at], 1)

        out = {}
        for q in SIZES:
            inside = np.flatnonzero(doc[: len(codes[q])] == doc[q - 1 : q - 1 + len(codes[q])])
            words, first, at = np.unique(codes[q][inside], return_index=True, return_inverse=True)
            pairs = np.unique(at.astype(np.int64) * (int(doc[-1]) + 1) + doc[inside]) // (int(doc[-1]) + 1)
            good = np.flatnonzero(np.bincount(pairs, minlength=len(words)) >= least)
            place = inside[first[good]]
            cohesion = np.full(len(good), np.inf)
            for s in range(1, q):
                parts = count(s, codes[s][place]) * count(q - s, codes[q - s][place + s]).astype(float)
                cohesion = np.minimum(cohesion, count(q, words[good]) * float(len(letters)) / parts)
            out[q] = words[good[cohesion >= COHESION[q]]]
        return out

    def acquisition(self, words: np.ndarray, codes: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The mean level at which each word is met, levels weighted alike."""
        hit, at = found_at(words, codes)
        counts = np.stack([np.bincount(at[hit & (level == lv)], minlength=len(words)) for lv in LEVELS], axis=1).astype(float)
        totals = np.maximum(1.0, np.bincount(level, minlength=max(LEVELS) + 1)[list(LEVELS)].astype(float))
        rates = (counts + SMOOTHING * totals / totals.sum()) / totals
        rates[:, [i for i, lv in enumerate(LEVELS) if lv not in self.seen]] = 0
        return rates @ np.array(LEVELS, dtype=float) / rates.sum(axis=1)

    def grades(self, letters: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(grade, text) of the known words of texts end to end: the longest one that begins at each letter, single letters only outside longer ones."""
        out, free, begins = np.full(len(letters), np.nan), np.ones(len(letters), dtype=bool), np.zeros(len(letters), dtype=bool)
        for size in SIZES:
            at, values = self.words[size].look_up(stretches(letters, size))
            inside = owner[at] == owner[at + size - 1]
            at, values = at[inside], values[inside]
            out[at] = values
            if size > 1:
                begins[at] = True
                for j in range(size):
                    free[at + j] = False
        known = np.flatnonzero(~np.isnan(out) & (begins | free))
        return out[known], owner[known]

    def profiles(self, letters: np.ndarray, sizes: np.ndarray) -> list[np.ndarray | None]:
        """Quantiles of the known words' grades of each text, ``sizes`` letters each; None without a known word."""
        grades, owner = self.grades(letters, np.repeat(np.arange(len(sizes)), sizes))
        edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
        share, out = np.array(QUANTILES), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            out.append(np.sort(grades[a:b])[(share * (b - a - 1)).round().astype(np.int64)] if b > a else None)
        return out

    def levels(self, letters: np.ndarray, sizes: np.ndarray) -> list[int]:
        """The level that most quantiles of each text name, the lower one between two; the middle of the levels without a known word."""
        out = []
        for got in self.profiles(letters, sizes):
            if got is None:
                out.append(int(self.seen[(len(self.seen) - 1) // 2]))
            else:
                votes = np.bincount((got > self.edges).sum(axis=0), minlength=len(self.seen))
                out.append(int(self.seen[int(votes.argmax())]))
        return out


def labelled(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = FIT_DOCUMENTS) -> list[tuple[str, int]]:
    """(text, level) of at most ``most`` labelled documents: the raters' median, the lower one between two."""
    rated = labels.where(F.col("level").isin(*LEVELS) & F.col(key).isNotNull()).groupBy(key).agg(F.expr("percentile_disc(0.5) within group (order by level)").cast("int").alias("level"))
    chosen = rated.orderBy(F.xxhash64(key), key).limit(most)
    rows = documents.select(key, text).where(F.length(text) > 0).join(chosen, key).select(text, "level").collect()
    return [(r[0], r[1]) for r in rows]


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = FIT_DOCUMENTS) -> DataFrame:
    """(key, level) of every document whose text is mainly Chinese, in either script.

    Null and blank texts and texts in other languages are left out. Without a usable label every document gets level 2.
    The fit is bounded by ``most`` documents; scoring is row by row and shuffles nothing; repeated rows repeat.
    """
    spark = documents.sparkSession
    folds = fold_pairs(spark)
    sample = labelled(documents, labels, key, text, most)
    model = Grades([t for t, _ in sample], [lv for _, lv in sample], folds)
    shared = spark.sparkContext.broadcast((model, folds))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, folds = shared.value
        table = letter_table(*folds)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                    size += len(texts[end])
                    end += 1
                chosen, parts = [], []
                for i in range(at, end):
                    points = code_points(texts[i])
                    if mainly_chinese(points, table):
                        letters = table[points]
                        chosen.append(i)
                        parts.append(letters[letters > 0])
                if chosen:
                    levels = model.levels(np.concatenate(parts), np.array([len(x) for x in parts]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chosen)), pa.array(levels, pa.int32())], names=[key, "level"])
                at = end

    return spread(documents.select(key, text).where(F.length(text) > 0)).mapInArrow(run, f"`{key}` {kind}, level int")
