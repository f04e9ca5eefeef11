import random

from inkmill.llm import leaks

RANDOM = random.Random(4)
CHARS = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]


def prose(n):
    return "".join(RANDOM.choice(CHARS) for _ in range(n))


def edited(t, every):
    out = list(t)
    for i in range(every // 2, len(out), every):
        out[i] = RANDOM.choice(CHARS)
    return "".join(out)


def test_found_and_not_found(spark):
    items = [(i, prose(n)) for i, n in enumerate([120, 200, 36, 41, 300, 9, 5])]
    docs, want = [], set()
    text = dict(items)
    for k, (item, part) in enumerate([(0, text[0][20:70]), (0, text[0]), (1, edited(text[1][30:100], 15)), (2, text[2]), (3, text[3]), (4, edited(text[4], 16)), (1, "，".join(text[1][i : i + 7] for i in range(0, 70, 7))), (5, text[5])]):
        docs.append((k, prose(300) + part + prose(200)))
        want.add((k, item))
    docs += [(100, prose(600)), (101, prose(100) + text[0][:25] + prose(100)), (102, prose(50) + text[1][100:118] + prose(40) + text[1][40:58] + prose(50) + text[1][:18]), (103, None), (104, ""), (105, "…" * 500), (106, prose(400_000) + text[0] + prose(1000))]
    want.add((106, 0))
    df = spark.createDataFrame([(d, t, 0) for d, t in docs] + [(None, text[0], 0), (1, docs[1][1], 0)], "doc_id bigint, text string, letters int")
    its = spark.createDataFrame([(*x, "s") for x in [*items, (77, None), (78, "")]], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(df, its).collect()}
    assert got == want | {(None, 0)}
    clean = leaks.without_leaks(df, leaks.leaks(df, its))
    assert {r.doc_id for r in clean.collect()} == {None, 100, 101, 102, 103, 104, 105}  # what has no key cannot be named
    assert leaks.leaks(df.where("false"), its).count() == 0 and leaks.leaks(df, its.where("false")).count() == 0


def test_places_of_the_longest_verbatim_match(spark):
    item = prose(90)
    docs = [(1, prose(50) + item[10:60] + prose(40)), (2, "（" + "，".join(edited(item, 16)) + "）"), (3, item), (4, prose(30) + item[:45] + prose(3) + item[45:] + prose(9))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in leaks.leaks(df, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {1, 2, 3, 4}

    def longest(t):
        return max(n for i in range(len(item)) for n in range(1, len(item) - i + 1) if item[i : i + n] in t)

    for k, t in docs:
        r, letters = got[k], "".join(c for c in t if c.isalpha())
        assert "".join(c for c in t[r.start : r.end] if c.isalpha()) == item[r.item_start : r.item_start + r.verbatim]
        assert r.verbatim == longest(letters)


def test_suffix_order():
    np = leaks.np
    letters = np.array([RANDOM.randrange(1, 4) for _ in range(400)] + [2] * 60, dtype=np.uint32)
    at, end = np.arange(len(letters)), np.where(np.arange(len(letters)) < 200, 200, len(letters))
    got = leaks.suffix_order(letters, at, end, 500)
    assert got.tolist() == sorted(at.tolist(), key=lambda i: letters[i : end[i]].tolist())


def test_items_in_blocks(spark, monkeypatch):
    items = [(i, prose(60)) for i in range(12)]
    docs = spark.createDataFrame([(i, prose(20) + t + prose(20)) for i, t in items], "doc_id bigint, text string")
    its = spark.createDataFrame(items + [(50, "甲乙丙")], "item_id bigint, text string")
    monkeypatch.setattr(leaks, "MOST_LETTERS", 200)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, its).collect()} == {(i, i) for i in range(12)}


def test_short_items_are_matched_by_whole_letters(spark):
    df = spark.createDataFrame([(1, "Ā\u0101甲乙"), (2, "丙甲乙丁"), (3, "甲丁乙")], "doc_id bigint, text string")
    its = spark.createDataFrame([(1, "甲乙"), (2, "乙")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(df, its).collect()} == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 2)}


def test_other_script_and_signs(spark):
    t = "他記得那條龍與舊時的雲中歌聲從橋頭傳來驚動了兩岸的漁火與遠處的鐘樓眾人皆起身觀望良久方才散去各自歸家"
    df = spark.createDataFrame([(1, "  ".join(t).replace("龍", "龙").replace("聲", "声"))], "doc_id bigint, text string")
    its = spark.createDataFrame([(1, t)], "item_id bigint, text string")
    assert leaks.leaks(df, its).count() == 1
