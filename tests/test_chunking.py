"""Sentence splitters and chunkers against row-by-row models."""

import random
import re

from pyspark.sql import functions as F

from inkmill.operators import chunking, sequential

RANDOM = random.Random(11)
ALPHABET = "甲乙丙丁戊己。！？…\n　 ”」\"'；.!?)"


def noise(n=300, longest=60):
    return ["".join(RANDOM.choice(ALPHABET) for _ in range(RANDOM.randint(0, longest))) for _ in range(n)]


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[1] for r in sorted(rows.select("i", f(F.col("t")).alias("r")).collect())]


def split_model(t, ends="。！？…\n"):
    if not t:
        return []
    if not re.search(f"[^{ends}][{ends}]", t):
        return [t]
    return re.findall(f"[^{ends}]*[{ends}]+|[^{ends}]+", t)


def greedy_model(parts, most):
    out, cur, n = [], [], 0
    for p in parts:
        if n + len(p) > most:
            if cur:
                out.append("".join(cur))
            cur, n = [p], len(p)
        else:
            cur.append(p)
            n += len(p)
    return out + (["".join(cur)] if cur else [])


def budget_model(parts, most):
    pieces, cur, n = [], [], 0
    for p in parts:
        if len(p) > most:
            if cur:
                pieces.append("".join(cur))
            cur, n = [], 0
            pieces += [p[i : i + most] for i in range(0, len(p), most)]
        elif cur and n + len(p) > most:
            if "".join(cur)[-1] in chunking.CLOSING:
                pieces.append("".join(cur))
                cur, n = [p], len(p)
            else:
                pieces.append("".join(cur) + p)
                cur, n = [], 0
        else:
            cur.append(p)
            n += len(p)
    if cur:
        pieces.append("".join(cur))
    out = []
    for x in (y.strip() for y in pieces):
        while x and x[0] in chunking.QUOTES and out:
            out[-1] += x[0]
            x = x[1:].lstrip()
        if x:
            out.append(x)
    return out


def test_sentences_are_lossless(spark):
    values = noise()
    got = apply(spark, values, chunking.sentences)
    assert got == [split_model(v) for v in values]
    assert ["".join(x) for x in got] == values


def test_target(spark):
    def model(t, target):
        out, cur, i = [], "", 0
        while i < len(t):
            cur += t[i]
            i += 1
            if len(cur) >= target and cur[-1] in chunking.TARGET_ENDS:
                while i < len(t) and t[i] in chunking.TARGET_QUOTES:
                    cur += t[i]
                    i += 1
                out.append(cur.strip())
                cur = ""
        return [x for x in [*out, cur.strip()] if x]

    values = noise()
    assert apply(spark, values, lambda c: chunking.target_chunks(c, 9)) == [model(v, 9) for v in values]


def test_lossy(spark):
    def model(t):
        parts = re.split(r"([。！？!?」』\"'>》}】\]])", t)
        return [parts[i].strip() + (parts[i + 1] if i + 1 < len(parts) else "") for i in range(0, len(parts), 2) if parts[i].strip()]

    values = noise()
    assert apply(spark, values, chunking.lossy_sentences) == [model(v) for v in values]


def test_budget():
    for v in noise(3000):
        for parts in ([x for x in split_model(v) if x.strip()], sequential.lossy(v)):
            assert sequential.under_budget(parts, 12) == budget_model(parts, 12), parts
    assert sequential.under_budget([], 12) == []


def test_forced(spark):
    assert apply(spark, ["甲乙丙丁戊", "", None], lambda c: chunking.forced_chunks(c, 2)) == [["甲乙", "丙丁", "戊"], [], None]


def test_numbered_keeps_nothing_of_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "甲。乙。")], "k int, t string")
    assert chunking.numbered(rows, chunking.sentences(F.col("t")), ["k"]).count() == 2


def test_walks_equal_models(spark):
    values = noise()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, t string")

    def gathered(df):
        out = {}
        for r in sorted(df.collect()):
            out.setdefault(r.i, []).append(r.chunk)
        return out

    greedy = gathered(sequential.greedy_rows(rows, "i", "t", 12))
    assert greedy == {i: x for i, x in enumerate(greedy_model(split_model(v), 12) for v in values) if x}
    budget = gathered(sequential.budget_rows(rows, "i", "t", 12))
    assert budget == {i: x for i, x in enumerate(budget_model(sequential.lossy(v), 12) for v in values) if x}
    pairs = sequential.under_budget(["甲乙丙丁。", "戊己"], 2, lambda t: [t[i : i + 2] for i in range(0, len(t), 2)], "".join)
    assert pairs == ["甲乙丙丁", "。", "戊己"]
    long = "句。" * 200_000
    assert len(sequential.gather(sequential.split_sentences(long), 800)) == 500
