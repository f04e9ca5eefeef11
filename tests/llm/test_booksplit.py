import random

from inkmill.llm import booksplit

SAME = ["夜渡之龙吟传_秋客.txt", "秋客_夜渡之龙吟传.txt", "《夜渡之龍吟傳》秋客_某站.txt", "夜渡之龙吟传__秋客-某站.txt", "夜渡之龙吟传 作者：秋客.txt", "[秋客]夜渡之龙吟传.txt", "new/秋客/夜渡之龙吟传.txt", "夜渡之龙吟传＿秋客．ｔｘｔ", "夜渡之 龙吟传_秋客_2.txt", "夜渡之龙吟传（上）_秋客.TXT", "夜渡之龙吟传第三卷_秋客.txt", "夜渡之龙吟传·秋客.txt", "夜渡之龙吟传_秋客（全本校对版）.txt", "夜渡之龙吟传_秋客"]
OTHER = ["夜渡之龙吟传续编_秋客.txt", "夜渡之龙吟传_冬客.txt", "夜渡之凤吟传_秋客.txt", "夜渡之龙吟传补遗_秋客.txt", "", "   ", None]


def test_names_of_one_book(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(SAME + OTHER + SAME[:2])], "source_file string, book int")
    got = {(r[0], r[1]) for r in booksplit.same_books(df).collect()}
    assert got == {(min(a, b), max(a, b)) for a in SAME for b in SAME if a != b}
    assert booksplit.same_books(df.where("false")).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}") for _ in range(220)] + [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("s", "s"), (None, "q")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in booksplit.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(booksplit, "HUB_EDGES", 3)
    edges = [("m", f"x{i}") for i in range(40)] + [(f"x{i}", f"y{i}") for i in range(0, 40, 2)] + [("z", f"y{i}") for i in range(0, 40, 4)] + [("p", "q")]
    got = {r.node: r.component for r in booksplit.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {got[x] for e in edges[:-1] for x in e} == {"m"} and got["p"] == got["q"] == "p"


def test_labels(spark):
    rows = [(f"r{i}", f"书{chr(0x4E00 + i % 150)}_人.txt") for i in range(3000)] + [(f"r{i}", f"书{chr(0x4E00 + i % 150)}·人.txt") for i in range(0, 3000, 5)] + [(f"h{i}", SAME[i % 5]) for i in range(1500)] + [("x1", None), ("x2", None), (None, SAME[0]), ("t", "书甲一_人.txt"), ("t", "书乙一_人.txt")]
    got = booksplit.grouped_split(spark.createDataFrame([(*r, "z") for r in rows], "record_id string, source_file string, label string"))
    label = {r.record_id: r.label for r in got.collect()}
    assert set(label) == {r[0] for r in rows if r[0]} and got.count() == len(label)
    assert len({label[f"h{i}"] for i in range(1500)}) == 1
    by = {}
    for i in range(3000):
        by.setdefault(i % 150, set()).add(label[f"r{i}"])
    assert all(len(v) == 1 for v in by.values())
    share = {r.label: r.share for r in booksplit.split_shares(got).collect()}
    assert abs(share["train"] - 0.8) < 0.06 and set(share) == {"train", "validation", "test"}
