"""Records of evaluation splits that also stand, exactly or almost, in the training split.

A record's passage and answer are folded to letters of one script; equal ones form classes, so copies are compared once.
The join is a prefix filter over short shingles ("blocks"): each evaluation class indexes, of its passage or its answer,
as many disjoint blocks as edits are allowed and a few more (``EXTRA``), the rarest that fit. Edits spoil at most one
block each, so a training text within the distance still holds ``EXTRA`` + 1 of them; every training stretch of a
block's length probes the index under length and position filters, and pairs with enough hits are verified on both texts
with a bit-parallel edit distance, then expanded to records. Passages with a line that may be a request's wording are
indexed and probed without it, too. No pair within the distance is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.hanfold import code_points, fold_pairs, letter_table
from inkmill.llm.sitelines import small_side
from inkmill.plans.lineage import cut, written
from inkmill.sources.tables import spread

#: Letters of a block; of texts of 6 and 7 letters, where two such do not fit, a shorter one.
BLOCK, SHORT_BLOCK = 4, 3
#: Blocks indexed beyond the edits allowed and one, as far as they fit; a pair needs so many hits and one.
EXTRA = 2
#: Blocks of long texts are chosen stretch by stretch of so many letters at most.
STRETCH = 400
#: Stretches whose blocks are chosen at once.
ROWS = 64
#: Bits of the table of counts that tells rare blocks from frequent ones; the choice of blocks costs time only, any is exact.
TABLE = 20
#: A block that stands as often as this share of the training records is spread over so many keys.
HOT, SALTS = 0.02, 16
#: Bits of the bitmap (8 MB, whatever the data) that spares training stretches outside every block the shuffle.
BITS = 26
#: Greatest edit distance as a share of the longer text, in passage and answer alike.
DISTANCE = 0.15
#: A request's wording is short and stands before or after passages that begin differently, as this share of all passages with such a line do.
REQUEST_LETTERS, REQUEST_SHARE, REQUEST_LEAST = 40, 0.002, 3
USER, ANSWER = ("user", "human"), ("assistant", "gpt", "bot", "model")


def turn(conversations: Column, roles: tuple[str, ...]) -> Column:
    """Content of the last turn of one of ``roles``; null if there is none."""
    own = F.filter(conversations, lambda m: F.lower(F.trim(m["role"])).isin(*roles))
    return F.try_element_at(own, F.lit(-1))["content"]


def folded_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the texts of ``columns`` reduced to letters of one script and line feeds; null becomes empty.

    A table lookup per character, an Arrow batch at a time: several times faster than a map lookup in an expression.
    """
    shared = df.sparkSession.sparkContext.broadcast(fold_pairs(df.sparkSession))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table(*shared.value).copy()
        table[[10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = 10

        def fold(texts: list) -> pa.Array:
            points = table[code_points("".join(t or "" for t in texts))]
            kept = points > 0
            upto = np.concatenate([[0], np.cumsum(kept)])
            edges = upto[np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])]
            whole = points[kept].tobytes().decode("utf-32-le", "surrogatepass")
            return pa.array([whole[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.string())

        for batch in batches:
            arrays = [fold(batch.column(k).to_pylist()) if n in columns else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, df.schema)


def passages(samples: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, source_file, split, passage, answer, head, tail), folded to letters; the request's wording is taken off the passage.

    Wordings are learnt from the whole table: first or last lines of up to ``REQUEST_LETTERS`` letters whose neighbouring
    line begins in many ways (``REQUEST_SHARE`` of all ways counted, at least ``REQUEST_LEAST``). Where no line is a known
    wording, ``head`` and ``tail`` are the letters of a short first or last line that may be one, else 0.
    """
    rows = samples.select(F.col(key).alias("record_id"), "source_file", "split", turn(F.col("conversations"), USER).alias("user"), turn(F.col("conversations"), ANSWER).alias("answer")).where(F.col("record_id").isNotNull())
    rows = folded_lines(spread(rows), ["user", "answer"])
    lines = F.filter(F.split("user", "\n"), lambda x: F.length(x) > 0)
    rows = rows.select("record_id", "source_file", "split", lines.alias("lines"), F.replace("answer", F.lit("\n"), F.lit("")).alias("answer"))
    ends = rows.where(F.size("lines") > 1).select(F.explode(F.array(F.struct(F.element_at("lines", 1).alias("line"), F.element_at("lines", 2).alias("next")), F.struct(F.element_at("lines", -1).alias("line"), F.element_at("lines", -2).alias("next")))).alias("e"))
    ends = ends.where(F.length("e.line") <= REQUEST_LETTERS).select("e.line", F.left("e.next", F.lit(6)).alias("next")).distinct()
    uses = cut(ends.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= REQUEST_LEAST))
    total = uses.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    wordings = uses.crossJoin(F.broadcast(total)).where(F.col("n") >= REQUEST_SHARE * F.col("total")).select("line")  # at most 1 / REQUEST_SHARE rows
    rows = rows.withColumn("_first", F.try_element_at("lines", F.lit(1))).withColumn("_last", F.when(F.size("lines") > 1, F.try_element_at("lines", F.lit(-1))))
    a, b = (F.broadcast(wordings.select(F.col("line").alias(c), F.lit(True).alias(f"_is{c}"))) for c in ("_first", "_last"))
    rows = rows.join(a, "_first", "left").join(b, "_last", "left")
    many = F.size("lines") > 1
    skip = F.when(F.col("_is_first") & many, 1).otherwise(0)
    keep = F.greatest(F.lit(1), F.size("lines") - skip - F.when(F.col("_is_last") & many, 1).otherwise(0))
    body = F.when(F.size("lines") > 0, F.array_join(F.slice("lines", skip + 1, keep), "")).otherwise("")
    maybe = lambda c: F.when(many & F.col("_is_first").isNull() & F.col("_is_last").isNull() & (F.length(c) <= REQUEST_LETTERS), F.length(c)).otherwise(0)
    return rows.select("record_id", "source_file", "split", F.coalesce(body, F.lit("")).alias("passage"), "answer", maybe("_first").alias("head"), maybe("_last").alias("tail"))


def block_hashes(text: str, size: int = BLOCK) -> np.ndarray:
    """Hash of the block at each position; a text shorter than a block is one block."""
    x = code_points(text).astype(np.uint64)
    if len(x) < size:
        x = np.concatenate([x, np.zeros(size - len(x), np.uint64)])
    h = np.full(len(x) - size + 1, size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + len(h)] + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def most_edits(n: int) -> int:
    """Edits that a passage of ``n`` letters and a longer one within ``DISTANCE`` of it may differ by at most."""
    return int(DISTANCE * int(n / (1 - DISTANCE) + 1e-6))


def cheapest(costs: list[np.ndarray], size: int, counts: list[int]) -> list[list[int]]:
    """For each row of costs, the starts of as many disjoint blocks as ``counts`` says, of least total cost; rows of like length together."""
    rows, width = len(costs), max(map(len, costs)) + size
    cost = np.full((rows, width - size), np.inf, dtype=np.float32)
    for i, c in enumerate(costs):
        cost[i, : len(c)] = c
    # best[j][i, x]: least cost of j blocks of row i that end at x at the latest.
    best = np.empty((max(counts) + 1, rows, width), dtype=np.float32)
    best[0] = 0
    for j in range(1, len(best)):
        best[j, :, :size] = np.inf
        np.add(best[j - 1, :, :-size], cost, out=best[j, :, size:])
        np.minimum.accumulate(best[j], axis=1, out=best[j])
    end, out, want = np.full(rows, width - 1), np.zeros((rows, max(counts)), dtype=np.int64), np.array(counts)
    for j in range(max(counts), 0, -1):
        open_ = np.flatnonzero(want >= j)
        level = best[j][open_]
        at = (level <= level[np.arange(len(open_)), end[open_]][:, None]).argmax(axis=1) - size
        out[open_, j - 1], end[open_] = at, at
    return [out[i, :n].tolist() for i, n in enumerate(counts)]


def blocks(texts: list[str], counts: np.ndarray, extra: int = EXTRA) -> list[tuple[np.ndarray, np.ndarray, int, float]]:
    """For each text (hash, start) of disjoint blocks, frequent ones avoided; how many survive all edits it may have; their cost."""
    plans, jobs = [], []
    for k, text in enumerate(texts):
        n = len(text)
        need = most_edits(n) + 1
        size = BLOCK if need * BLOCK <= max(n, BLOCK) else SHORT_BLOCK
        more = max(0, min(extra, n // size - need - n // STRETCH))
        need += more
        h = block_hashes(text, size)
        cost = counts[h >> np.uint64(64 - TABLE)].astype(np.float32)
        plans.append((h, cost, more + 1, []))
        parts = -(-n // STRETCH)
        for i in range(parts):
            lo, hi = n * i // parts, n * (i + 1) // parts
            jobs.append((size, cost[lo : max(lo + 1, hi - size + 1)], need * (i + 1) // parts - need * i // parts, k, lo))
    jobs.sort(key=lambda x: (x[0], len(x[1])))
    for a in range(0, len(jobs), ROWS):
        for size in {x[0] for x in jobs[a : a + ROWS]}:
            some = [x for x in jobs[a : a + ROWS] if x[0] == size and x[2]]
            for (_, _, _, k, lo), got in zip(some, cheapest([x[1] for x in some], size, [x[2] for x in some]) if some else []):
                plans[k][3].extend(lo + x for x in got)
    out = []
    for h, cost, least, at in plans:
        at = np.sort(np.array(at, dtype=np.int64))
        out.append((h[at], at, least, float(cost[at].sum())))
    return out


def bucketed(h: np.ndarray, bucket: np.ndarray | int, side: int) -> np.ndarray:
    """Hashes of blocks within passages (side 0) or answers (1) whose lengths fall into one bucket."""
    h = (h ^ (np.asarray(bucket).astype(np.uint64) * np.uint64(2) + np.uint64(side + 4))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def salted(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Hashes of frequent blocks, spread over ``SALTS`` keys."""
    h = (h ^ (np.asarray(salt).astype(np.uint64) + np.uint64(1))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def bucket_of(n):
    """The bucket of a length; lengths within ``DISTANCE`` of one length fall into two, seldom three."""
    return np.floor(np.log(np.maximum(n, 1)) / (-2 * math.log(1 - DISTANCE))).astype(np.int64)


def presence(index: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the hashes of ``index``: what it lacks is no block, what it has may be."""
    words = index.selectExpr(f"cast(shiftright(h & {(1 << BITS) - 1}, 6) as int) as word", "shiftleft(1L, cast(h & 63 as int)) as bits")
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


INDEX = "h bigint, class bigint, side byte, form byte, size int, at int, other int, least int"
PROBE = "h bigint, class bigint, form byte, size int, at int, other int"


def index_rows(classes: DataFrame, counts: tuple[np.ndarray, int]) -> DataFrame:
    """(h, class, side, form, size, at, other, least): the blocks of each evaluation class (class, passage, answer, head, tail).

    They are those of its passage, in each of its ``readings`` (``form``), or of its answer, whichever are rarer, in each
    bucket of length that may hold a partner; ``size`` and ``other`` are the letters of the side taken and of the other,
    ``least`` the hits that a partner has.
    """
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, counted = shared.value
        for batch in batches:
            out = []
            keys, passages, answers, heads, tails = (c.to_pylist() for c in batch.columns)
            sides = [[readings(*x) for x in zip(passages, heads, tails)], [[a] if a else [] for a in answers]]
            made = []
            for forms in sides:
                got = iter(blocks([t for texts in forms for t in texts], counts))
                made.append([[next(got) for _ in texts] for texts in forms])
            for i, key in enumerate(keys):
                side = min((x for x in (1, 0) if made[x][i]), key=lambda x: sum(m[3] for m in made[x][i]))
                other = len((answers, passages)[side][i] or "")
                for form, (text, (h, at, least, _)) in enumerate(zip(sides[side][i], made[side][i])):
                    n, hot = len(text), counts[h >> np.uint64(64 - TABLE)] > HOT * counted
                    hs = []
                    for bucket in range(int(bucket_of(int(n * (1 - DISTANCE)))), int(bucket_of(int(n / (1 - DISTANCE)) + 1)) + 1):
                        x = bucketed(h, bucket, side)
                        hs += [(x[~hot], at[~hot])] + [(salted(x[hot], salt), at[hot]) for salt in range(SALTS if hot.any() else 0)]
                    h, at = (np.concatenate(x) for x in zip(*hs))
                    out.append((h.view(np.int64), at, len(h), key, side, form, n, other, least))
            if out:
                h, at, many, *rest = zip(*out)
                rep = [np.repeat(np.array(x, t), many) for x, t in zip(rest, (np.int64, np.int8, np.int8, np.int32, np.int32, np.int32))]
                key, side, form, size, other, least = rep
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(h), key, side, form, size, np.concatenate(at).astype(np.int32), other, least)], names=["h", "class", "side", "form", "size", "at", "other", "least"])

    return classes.select("class", "passage", "answer", "head", "tail").mapInArrow(run, INDEX)


def probe_rows(classes: DataFrame, counts: tuple[np.ndarray, int], known: np.ndarray) -> DataFrame:
    """(h, class, form, size, at, other): every stretch of the passages, in each of their ``readings``, and answers of ``classes`` that the bitmap ``known`` has."""
    shared = classes.sparkSession.sparkContext.broadcast((*counts, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, counted, known = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            passages, answers, heads, tails = (c.to_pylist() for c in batch.columns[1:])
            sides = [[readings(*x) for x in zip(passages, heads, tails)], [[a or ""] for a in answers]]
            lengths = [np.array([len(t or "") for t in texts], np.int64) for texts in (passages, answers)]
            for side, forms in enumerate(sides):
                row = np.repeat(np.arange(len(forms)), [len(x) for x in forms])
                form = np.array([f for x in forms for f in range(len(x))], np.int8)
                texts = [t for x in forms for t in x]
                size = np.array([len(t) for t in texts], np.int64)
                whole = "".join(texts)
                found = []
                if len(whole) >= BLOCK:
                    owner = np.repeat(np.arange(len(texts)), size)
                    at = np.arange(len(whole)) - (np.cumsum(size) - size)[owner]
                    good = np.flatnonzero(at + BLOCK <= size[owner])
                    found.append((block_hashes(whole)[good], owner[good], at[good]))
                for i in np.flatnonzero((size > 0) & (size <= 2 * BLOCK)):
                    for q in (SHORT_BLOCK, BLOCK) if size[i] < BLOCK else (SHORT_BLOCK,):
                        h = block_hashes(texts[i], q)
                        found.append((h, np.full(len(h), i), np.arange(len(h))))
                if not found:
                    continue
                h, owner, at = (np.concatenate(x) for x in zip(*found))
                hot = counts[h >> np.uint64(64 - TABLE)] > HOT * counted
                h = bucketed(h, bucket_of(size)[owner], side)
                h[hot] = salted(h[hot], keys[row[owner[hot]]] % SALTS)
                kept = (known[(h & np.uint64((1 << BITS) - 1)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) > 0
                h, owner, at = h[kept], owner[kept], at[kept]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), keys[row[owner]], form[owner], size[owner].astype(np.int32), at.astype(np.int32), lengths[1 - side][row[owner]].astype(np.int32))], names=["h", "class", "form", "size", "at", "other"])

    return classes.select("class", "passage", "answer", "head", "tail").mapInArrow(run, PROBE)


def block_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How often blocks stand in all passages and answers of ``texts``, by the first ``TABLE`` bits of their hash, and of how many rows.

    Each task counts its part into a table of fixed size; the tables are added up slot by slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = np.zeros(1 << TABLE, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for column in batch.columns:
                some = [t for t in column.to_pylist() if t]
                size = np.array([len(t) for t in some], np.int64)
                whole = "".join(t for t in some if len(t) >= BLOCK)
                found = [block_hashes(t, SHORT_BLOCK if len(t) in (6, 7) else BLOCK) for t in some if len(t) < BLOCK or len(t) in (6, 7)]
                if whole:
                    size = size[size >= BLOCK]
                    left = np.repeat(np.cumsum(size), size) - np.arange(len(whole))
                    found.append(block_hashes(whole)[((left >= BLOCK) & ~np.isin(np.repeat(size, size), (6, 7)))[: len(whole) - BLOCK + 1]])
                if found:
                    out += np.bincount((np.concatenate(found) >> np.uint64(64 - TABLE)).astype(np.int64), minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(out[at], rows))], names=["slot", "n"])

    got = texts.select("passage", "answer").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(1 << TABLE, dtype=np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, bit-parallel; ``most`` + 1 once it exceeds ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) < len(b):
        a, b = b, a
    n = len(b)
    if not n:
        return len(a)
    peq: dict[str, int] = {}
    for i, c in enumerate(b):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score = mask, 0, n
    for i, c in enumerate(a):
        eq = peq.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & mask
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & mask | 1
        hn = hn << 1 & mask
        vp = hn | ~(xv | hp) & mask
        vn = hp & xv
        if score - (len(a) - 1 - i) > most:
            return most + 1
    return score


def within(x: str, y: str) -> bool:
    most = int(DISTANCE * max(len(x), len(y)))
    return edit_distance(x, y, most) <= most


def readings(passage: str, head: int, tail: int) -> list[str]:
    """A passage as it is, and without a short first or last line that may be a request's wording."""
    return [x for x in (passage, passage[head:] if head else "", passage[: len(passage) - tail] if tail else "") if x]


def almost_same(p1: pd.Series, a1: pd.Series, h1: pd.Series, t1: pd.Series, p2: pd.Series, a2: pd.Series, h2: pd.Series, t2: pd.Series) -> pd.Series:
    def same(p, a, h, t, q, b, i, u) -> bool:
        return within(a, b) and any(within(x, y) for x in readings(p, h, t) for y in readings(q, i, u))

    return pd.Series([same(*x) for x in zip(p1, a1, h1, t1, p2, a2, h2, t2)], dtype=bool)


def cross_split_pairs(samples: DataFrame, train: str = "train") -> DataFrame:
    """(record_id_a, record_id_b; a < b): a train record and one of another split with the same passage and answer.

    Same means apart from spacing, signs, script and ``DISTANCE`` of the letters, in the passage and in the answer alike;
    a short first or last line of a record in which no request's wording was recognised may be left out of its passage.
    Records whose passage is empty or null match nothing, nor does a null record_id; a record delivered twice counts
    once; a null split is an evaluation split. A pair of records of one id is no pair.
    """
    rows = passages(samples).where(F.length("passage") > 0)
    rows = rows.withColumn("train", F.coalesce(F.col("split") == train, F.lit(False))).withColumn("sign", F.md5(F.concat_ws("|", "passage", "answer", "head", "tail"))).withColumn("class", F.xxhash64("sign"))
    rows = written(rows.select("train", "class", "sign", "record_id", "passage", "answer", "head", "tail"))
    # Classes of equal texts; a clash of the short hash gives one class two texts, told apart by their sign.
    texts = rows.select("train", "class", "sign", "passage", "answer", "head", "tail")
    held, probes = (texts.where(side).dropDuplicates(["class", "sign"]) for side in ("not train", "train"))
    counts = block_counts(texts.where("train"))
    index = written(index_rows(held, counts))
    e = index.select("h", F.col("class").alias("e"), "side", F.col("form").alias("e_form"), F.col("size").alias("e_size"), F.col("at").alias("e_at"), F.col("other").alias("e_other"), "least")
    found = probe_rows(probes, counts, presence(index)).join(e, "h")
    most, most_other = F.floor(F.greatest("size", "e_size") * DISTANCE), F.floor(F.greatest("other", "e_other") * DISTANCE)
    # What stands before and behind the block differs by its difference in length at least; a wording left in a passage may be a difference, too.
    apart = F.abs(F.col("at") - F.col("e_at")) + F.abs(F.col("size") - F.col("at") - F.col("e_size") + F.col("e_at"))
    found = found.where((apart <= most) & (F.abs(F.col("other") - F.col("e_other")) <= most_other + F.when(F.col("side") == 1, REQUEST_LETTERS).otherwise(0)))
    found = found.groupBy(F.col("class").alias("t"), "form", "e", "e_form").agg(F.count("*").alias("n"), F.min("least").alias("least")).where("n >= least")
    found = written(found.select("t", "e").distinct())
    side = lambda which, c, p: texts.where(which).join(small_side(found.select(F.col(c).alias("class")).distinct()), "class", "left_semi").dropDuplicates(["class", "sign"]).select(F.col("class").alias(c), *[F.col(x).alias(f"{x}_{p}") for x in ("sign", "passage", "answer", "head", "tail")])
    near = found.join(side("train", "t", 1), "t").join(side("not train", "e", 2), "e")
    near = near.where(F.pandas_udf(almost_same, "boolean")(*[F.col(f"{x}_{p}") for p in (1, 2) for x in ("passage", "answer", "head", "tail")])).select("t", "sign_1", "e", "sign_2")
    ids = rows.select("train", "class", "sign", "record_id")
    t = ids.where("train").select(F.col("class").alias("t"), F.col("sign").alias("sign_1"), F.col("record_id").alias("x"))
    e = ids.where("not train").select(F.col("class").alias("e"), F.col("sign").alias("sign_2"), F.col("record_id").alias("y"))
    pairs = near.join(t, ["t", "sign_1"]).join(e, ["e", "sign_2"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")).distinct()


def overlap_report(samples: DataFrame, pairs: DataFrame, train: str = "train") -> DataFrame:
    """(split, source_file, pairs, records): pairs and distinct evaluation records per split and source of the evaluation record."""
    named = samples.select("record_id", "split", "source_file").distinct().where(F.coalesce(F.col("split") != train, F.lit(True)))
    sides = pairs.select(F.col("record_id_a").alias("record_id"), "record_id_a", "record_id_b").union(pairs.select("record_id_b", "record_id_a", "record_id_b"))
    return sides.join(named, "record_id").groupBy("split", "source_file").agg(F.count_distinct("record_id_a", "record_id_b").alias("pairs"), F.count_distinct("record_id").alias("records"))
