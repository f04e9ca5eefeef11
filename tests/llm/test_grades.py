import os
import random

import pytest
from pyspark.sql import functions as F

from inkmill.llm import grades
from inkmill.sources.tables import read_table

RANDOM = random.Random(6)
WORDS = {1: "小狗大牛妈妈爸爸花草", 2: "慢慢走上前去湖边树林", 3: "遂径自当下旋即霍然拂", 4: "饕餮葳蕤旖旎踽踽龃龉"}


def prose(level, n=200):
    return "".join(RANDOM.choice(WORDS[level]) + RANDOM.choice("，。的了") * (RANDOM.random() < 0.2) for _ in range(n))


def test_levels_and_left_out(spark):
    docs = [(i, prose(1 + i % 4)) for i in range(160)]
    docs += [(200, prose(4, 60) + prose(3, 200)), (201, None), (202, " \n"), (203, "Only English words stand here. " * 5), (204, "これは日本語の文章です。" * 5), (205, prose(2, 30_000)), (206, "1234。")]
    df = spark.createDataFrame([(*d, 9) for d in docs] + [(0, docs[0][1], 9)], "doc_id bigint, text string, level int")
    labels = [(i, r, 1 + i % 4 if RANDOM.random() > 0.1 else 1 + (i + 1) % 4) for i in range(80) for r in ("a", "b", "c")] + [(1, "d", None), (999, "a", 3), (5, "e", 7), (None, "a", 1)]
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, level int")
    got = {r.doc_id: r.level for r in grades.reading_levels(df, lab).collect()}
    assert set(got) == {*range(160), 200, 205} and got[200] == 3 and got[205] == 2
    assert sum(got[i] == 1 + i % 4 for i in range(160)) >= 156
    assert {r.level for r in grades.reading_levels(df, lab.where("false")).collect()} == {2}
    assert grades.reading_levels(df.where("false"), lab).count() == 0


def test_dictionary_grades_and_quantiles():
    np = grades.np
    words = {1: ["小狗", "妈妈", "花草"], 2: ["慢慢", "湖边", "树林"], 3: ["遂径", "当下", "霍然"], 4: ["饕餮", "葳蕤", "旖旎"]}
    text = lambda lv, n=150: "".join(RANDOM.choice(words[lv]) for _ in range(n))
    texts, levels = [text(1 + i % 4) for i in range(80)], [1 + i % 4 for i in range(80)]
    model = grades.Grades(texts, levels, ("", ""))
    points = lambda t: np.array([ord(c) for c in t], np.uint32)
    level = lambda m, t: m.levels(points(t), np.array([len(t)]))[0]
    grade = lambda t: model.grades(points(t), np.zeros(len(t), int))[0].tolist()
    assert len(model.words[2].codes) > 12 and model.edges.shape == (3, len(grades.QUANTILES)) and (np.diff(model.edges, axis=0) > 0).all()
    assert grade("小狗")[0] < 1.3 and grade("饕餮")[0] > 3.7 and grade("龘") == []
    assert level(model, text(1, 120) + text(4, 80)) == 1 and level(model, text(4, 120) + text(1, 80)) == 4 and level(model, "龘") == 2
    both = [text(1, 50), "龘", "", text(3, 50)]
    assert model.levels(points("".join(both)), np.array([len(x) for x in both])) == [1, 2, 2, 3]
    assert level(grades.Grades([], [], ("", "")), "狗牛") == 2 and level(grades.Grades(["狗"], [3], ("", "")), "狗牛") in (2, 3)


def test_table_against_a_dictionary():
    np = grades.np
    codes = np.unique(np.array([RANDOM.getrandbits(64) if RANDOM.random() < 0.5 else RANDOM.getrandbits(20) for _ in range(5000)], np.uint64))
    table, own = grades.Table(codes, np.arange(len(codes)).astype(float)), {int(c): i for i, c in enumerate(codes)}
    asked = np.array([*codes[::3], *(RANDOM.getrandbits(64) for _ in range(500)), 0, 1, 2**64 - 1], np.uint64)
    at, values = table.look_up(asked)
    assert dict(zip(at.tolist(), values.tolist())) == {i: own[int(c)] for i, c in enumerate(asked) if int(c) in own}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "level_labels")
    own = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    got = grades.reading_levels(docs.where(own), labels.where(own), "doc_id").limit(0)
    model_on = labels.where(~own)
    levels = grades.reading_levels(docs, model_on)
    agreed = labels.where(own & F.col("level").isNotNull()).groupBy("doc_id").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.count("*").alias("n")).where("low = high and n > 1")
    hits = levels.join(agreed, "doc_id").agg(F.avg((F.col("level") == F.col("low")).cast("double")), F.count("*")).head()
    assert hits[1] > 80 and hits[0] > 0.95
    assert got.count() == 0
