"""Operators across records, sampling, chat and training rows."""

import hashlib
import random

from pyspark.sql import functions as F

from inkmill.operators import chat, enrich, metrics, ranking, records, training

RANDOM = random.Random(3)


def test_position_equals_a_sort(spark):
    rows = spark.createDataFrame([(f"g{RANDOM.randint(0, 1)}", f"k{i}") for i in range(500)] + [(None, "x")], "g string, k string")
    got = {(r.g, r.k): r.position for r in ranking.hash_position(rows, "k", 42, ["g"]).collect()}
    by = {}
    for g, k in got:
        by.setdefault(g, []).append(k)
    for g, ks in by.items():
        ks.sort(key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
        assert [got[g, k] for k in ks] == list(range(1, len(ks) + 1))


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 3, 3)] + [("b", 7), ("c", None)], "g string, v int")
    assert {r.g: r.median for r in ranking.upper_median(rows, "g", "v").collect()} == {"a": 3, "b": 7}
    assert ranking.upper_median(rows.where("false"), "g", "v").count() == 0


def test_quota(spark):
    rows = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("b", "x"), (None, "y")], "g string, k string")
    got = [r.g for r in ranking.quota_sample(rows, "g", "k", {"a": 7, "b": 3}).collect()]
    assert sorted(got) == ["a"] * 7 + ["b"]


def shift_model(items, least=5):
    quotes = records.REPAIR_QUOTES
    out, started = [], False
    for k, t in items:
        if not started:
            if len(t.strip()) >= least:
                out.append([k, t])
                started = True
            continue
        i = 0
        rest, moved = t, ""
        lead = t.lstrip()
        while lead and lead[0] in quotes:
            moved += lead[0]
            lead = lead[1:].lstrip()
            rest = lead
        out[-1][1] += moved
        if len(rest.strip()) >= least:
            out.append([k, rest])
        del i
    return {k: t for k, t in out}


def test_shift_quotes(spark):
    alphabet = "甲乙丙丁」』” 　"
    for size in (1, 40):
        items = [(i * 300, "".join(RANDOM.choice(alphabet) for _ in range(RANDOM.randint(0, 12)))) for i in range(size)]
        rows = spark.createDataFrame([("f", k, t) for k, t in items], "f string, seq bigint, text string")
        got = {r.seq: r.text for r in records.shift_quotes(rows, "f", "seq").collect()}
        assert got == shift_model(items)


def test_merge_every(spark):
    rows = spark.createDataFrame([("f", i, f"i{i:03d}", "a", "f", None if i == 1 else ("" if i == 2 else f"t{i}")) for i in range(8)], "g string, seq bigint, id string, author string, source_file string, text string")
    got = sorted(records.merge_every(rows, 3, "g", "seq", F.lit("m")).collect(), key=lambda r: r.part)
    assert [(r.id, r.text, r.merged_from, r.merged_count) for r in got] == [("m_pair_00000", "t0", ["i000", "i001", "i002"], 3), ("m_pair_00001", "t3\n\nt4\n\nt5", ["i003", "i004", "i005"], 3), ("m_pair_00002", "t6\n\nt7", ["i006", "i007"], 2)]


def test_uniform_and_remaining(spark):
    rows = spark.createDataFrame([("1", None, None, None), ("2", "a", ["x", "y"], None)], "id string, author string, merged_from array<string>, merged_count int")
    got = {r.id: (r.author, r.merged_from, r.merged_count) for r in records.uniform(rows).collect()}
    assert got == {"1": ("", [], 0), "2": ("a", ["x", "y"], 2)}
    assert [r.id for r in records.remaining(rows, rows.where("id = '1'")).collect()] == ["2"]


def test_tagged_union_and_clashing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, extra string"), spark.createDataFrame([(2,)], "id int")
    got = {(r.id, r.dataset, r.extra) for r in records.tagged_union({"a": a, "b": b}).collect()}
    assert got == {(1, "a", "x"), (2, "b", None)}


def test_dialects(spark):
    rows = spark.createDataFrame([([("GPT ", "一"), (None, None), ("sys", "s")],), ([],), (None,)], "c array<struct<role:string,content:string>>")
    got = [r[0] for r in rows.select(chat.unified(F.col("c"))).collect()]
    assert [[tuple(m) for m in x] if x is not None else None for x in got] == [[("assistant", "一"), ("user", ""), ("system", "s")], [], None]
    prompt = rows.limit(1).select(chat.chat_prompt(chat.unified(F.col("c"))), chat.chat_response(chat.unified(F.col("c")))).head()
    assert prompt[0] == "<|im_start|>user\n<|im_end|>\n<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\n" and prompt[1] == "一<|im_end|>"


def test_masks(spark):
    cases = [([1, 2], [3, 4]), ([1] * 6, [9]), ([1] * 7, [9]), ([], [5]), ([1, 2, 3], [4] * 9)]
    rows = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(cases)], "i int, p array<int>, a array<int>")
    got = sorted(training.masked(rows, F.col("p"), F.col("a"), 6).collect())
    for r, (p, a) in zip(got, cases):
        if len(p) > 6:
            assert (r.input_ids, r.attention_mask, r.labels) == ([], [], [])
            continue
        ids = (p + a)[:6]
        labels = ([-100] * len(p) + a)[:6]
        assert r.input_ids == ids + [0] * (6 - len(ids)) and r.labels == labels + [-100] * (6 - len(ids)) and sum(r.attention_mask) == len(ids)


def test_packing_keeps_every_token(spark):
    lists = [[RANDOM.randint(5, 99) for _ in range(RANDOM.randint(0, 40))] for _ in range(60)]
    rows = spark.createDataFrame([(i // 20, i, x) for i, x in enumerate(lists)], "b int, s int, ids array<int>")
    got = training.packed(rows, "b", "s", "ids", 16, 3, 0).collect()
    for b in range(3):
        want = [t for i, x in enumerate(lists) if i // 20 == b for t in [*x, 3]]
        have = [t for r in sorted((r for r in got if r.b == b), key=lambda r: r.block) for t in r.input_ids]
        assert have[: len(want)] == want and set(have[len(want) :]) <= {0} and len(have) % 16 == 0


def test_rouge(spark):
    def model(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(200):
        a, b = ([RANDOM.choice("甲乙丙") for _ in range(RANDOM.randint(0, 20))] for _ in range(2))
        assert metrics.common_length(a, b) == model(a, b)
    rows = spark.createDataFrame([("甲乙丙", "甲丙"), (None, "甲"), ("", ""), ("甲", "甲")], "e string, g string")
    assert [round(r[0], 3) for r in rows.select(metrics.rouge_l(F.col("e"), F.col("g"))).collect()] == [0.8, 0.0, 0.0, 1.0]
    empty = metrics.evaluation_summary(spark.createDataFrame([], "rouge_l double")).head()
    assert empty.total == 0 and empty.average is None and empty.band is None


def test_enrichment_retries_and_resumes(spark):
    rows = spark.createDataFrame([(str(i), "甲" * i) for i in range(10)], "id string, text string")

    def client():
        seen = set()

        def ask(t):
            if t not in seen:
                seen.add(t)
                raise OSError("once")
            return None if len(t) == 3 else f" {len(t)} "

        return ask

    got = enrich.enrich_rest(rows, rows.where("id = '5'"), "id", "text", client, policy=enrich.Policy(tries=2, pause=0, threads=1))
    assert sorted((r.id, r.generated) for r in got.collect()) == [(str(i), str(i)) for i in (1, 2, 4, 6, 7, 8, 9)]


def test_loss_and_shares(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0)], "step int, loss double")
    assert tuple(metrics.loss_summary(rows, "step", "loss").head()) == (3, 1.0, 2.0, 3.0, -1.0)
    assert {r.step: r.share for r in metrics.mix_shares(rows, "step").collect()} == {1: 0.333333, 2: 0.333333, 3: 0.333333}
