import random

from inkmill.llm import crosssplit

RANDOM = random.Random(9)
CHARS = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
ASKS = ["请润色：\n", "改写下文。\n\n", "换个说法——\n"]


def prose(n):
    return "".join(RANDOM.choice(CHARS) for _ in range(n))


def edited(t, share):
    out = list(t)
    for _ in range(int(len(t) * share)):
        out[RANDOM.randrange(len(out))] = RANDOM.choice(CHARS)
    return "".join(out)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sample(i, p, a, split, ask=None):
    turns = [("system", None), ("user", (ask or RANDOM.choice(ASKS)) + p if p is not None else None)] + ([("gpt", a)] if a is not None else [])
    return (i, turns, split, "书")


def test_edit_distance():
    for _ in range(400):
        a, b = ("".join(RANDOM.choice("甲乙丙丁") for _ in range(RANDOM.randint(0, 30))) for _ in range(2))
        d, most = levenshtein(a, b), RANDOM.randint(0, 30)
        got = crosssplit.edit_distance(a, b, most)
        assert got == d if d <= most else got == most + 1


def test_pairs_against_brute_force(spark):
    texts = [(prose(RANDOM.randint(60, 300)), prose(RANDOM.randint(60, 200))) for _ in range(40)]
    rows, fields = [], {}
    for i in range(160):
        p, a = RANDOM.choice(texts)
        kind = RANDOM.random()
        if kind < 0.5:
            p, a = edited(p, RANDOM.choice([0, 0.03, 0.09])), edited(a, RANDOM.choice([0, 0.03, 0.09]))
        elif kind < 0.75:
            a = prose(100)
        split = RANDOM.choice(["train", "train", "valid", "test_stress"])
        rows.append(sample(f"r{i:03d}", p, a, split))
        fields[f"r{i:03d}"] = (p, a, split)
    rows += [rows[0], rows[1], sample("n1", None, None, "train"), sample("n2", "", "", "valid"), (None, [("user", "请润色：\n" + texts[0][0])], "train", None), ("n3", None, "valid", "书"), ("n4", [], None, "书")]
    df = spark.createDataFrame(rows, "record_id string, conversations array<struct<role:string,content:string>>, split string, source_file string")
    got = {(r.record_id_a, r.record_id_b) for r in crosssplit.cross_split_pairs(df).collect()}
    want = set()
    for x, (p, a, s) in fields.items():
        for y, (q, b, t) in fields.items():
            if s == "train" and t != "train" and levenshtein(p, q) <= 0.15 * max(len(p), len(q)) and levenshtein(a, b) <= 0.15 * max(len(a), len(b)):
                want.add((min(x, y), max(x, y)))
    assert want and got == want
    report = crosssplit.overlap_report(df, crosssplit.cross_split_pairs(df)).collect()
    assert sum(r.pairs for r in report) == len(want)


def test_spacing_script_and_turn_names(spark):
    p, a = "他記得那條龍，與舊時的事。" * 6 + "完", "龍在雲中。" * 8
    rows = [("a", [("human", "请改：\n" + p), ("gpt", a)], "train", None), ("b", [("system", "s"), ("user", p.replace("記", "记").replace("龍", "龙").replace("，", " , ")), ("assistant", a.replace("龍", "龙"))], "valid", None)]
    df = spark.createDataFrame(rows, "record_id string, conversations array<struct<role:string,content:string>>, split string, source_file string")
    assert [(r[0], r[1]) for r in crosssplit.cross_split_pairs(df).collect()] == [("a", "b")]
    assert crosssplit.cross_split_pairs(df.where("false")).count() == 0


def changed(t, share):
    out = list(t)
    for x in RANDOM.sample(range(len(out)), int(len(t) * share)):
        out[x] = RANDOM.choice(CHARS)
    return "".join(out)


def test_altered_copies_of_one_passage(spark):
    p, a = prose(110), prose(80)
    rows = [sample("t0", p, a, "train")] + [sample(f"v{i:02d}", changed(p, 0.13), a, "valid") for i in range(30)]
    rows += [sample(f"s{n}", prose(n), prose(9), "train") for n in range(1, 30)]
    rows += [(f"x{r[0]}", [("user", r[1][1][1][:-1] + "完"), r[1][2]], "valid", "书") for r in rows if r[0].startswith("s")]
    df = spark.createDataFrame(rows, "record_id string, conversations array<struct<role:string,content:string>>, split string, source_file string")
    got = {(r.record_id_a, r.record_id_b) for r in crosssplit.cross_split_pairs(df).collect()}
    assert got == {("t0", f"v{i:02d}") for i in range(30)} | {(f"s{n}", f"xs{n}") for n in range(7, 30)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id string, conversations array<struct<role:string,content:string>>, split string, source_file string")


def spaced(t, step):
    return "".join(RANDOM.choice(CHARS) if i % step == step - 1 else c for i, c in enumerate(t))


def test_evenly_spaced_changes(spark):
    """One letter in every 7, 8 and 11 changed, from 40 to 400 letters: no stretch of 12 letters is left, every pair is found."""
    rows, want = [], set()
    for i, (n, step) in enumerate((n, step) for n in (40, 60, 90, 140, 200, 260, 400) for step in (7, 8, 11)):
        p, a = prose(n), prose(n // 2)
        rows += [sample(f"t{i:02d}", p, a, "train"), sample(f"v{i:02d}", spaced(p, step), spaced(a, step), "valid")]
        want.add((f"t{i:02d}", f"v{i:02d}"))
    assert {tuple(r) for r in crosssplit.cross_split_pairs(frame(spark, rows)).collect()} == want


def test_random_changes_of_all_kinds(spark):
    """Letters replaced, put in and left out at random up to the distance, among copies that make every block frequent."""
    rows, fields = [], {}
    base = [(prose(RANDOM.randint(40, 400)), prose(RANDOM.randint(20, 200))) for _ in range(6)]
    for i in range(90):
        p, a = base[i % 6]
        share = RANDOM.choice([0, 0.05, 0.1, 0.15])

        def vary(t):
            out = list(t)
            for _ in range(int(len(t) * share)):
                k, at = RANDOM.random(), RANDOM.randrange(len(out))
                out[at : at + (k > 0.3)] = [] if k > 0.8 else [RANDOM.choice(CHARS)]
            return "".join(out)

        fields[f"r{i:02d}"] = vary(p), vary(a), RANDOM.choice(["valid", "train"])
    rows = [sample(k, *v) for k, v in fields.items()]
    near = lambda x, y: levenshtein(x, y) <= int(0.15 * max(len(x), len(y)))
    want = {(min(x, y), max(x, y)) for x, (p, a, s) in fields.items() for y, (q, b, t) in fields.items() if s == "train" and t == "valid" and near(p, q) and near(a, b)}
    assert {tuple(r) for r in crosssplit.cross_split_pairs(frame(spark, rows)).collect()} == want and len(want) > 50


def test_wording_used_once(spark):
    p, a = prose(90), prose(60)
    rows = [sample("t", p, a, "train", "劳驾把这一段话写得更像旧时的小说一些可好：\n"), sample("v", p, a, "valid", "请润色：\n"), ("w", [("user", p + "\n\n以上请换一种从没有人用过的说法写出来"), ("gpt", a)], "valid", None)]
    rows += [sample(f"x{i}", prose(80), prose(50), "train", "请润色：\n") for i in range(6)]
    assert {tuple(r) for r in crosssplit.cross_split_pairs(frame(spark, rows)).collect()} == {("t", "v"), ("t", "w")}


def test_cheapest_against_all_choices():
    import itertools

    np = crosssplit.np
    rows = [np.array([RANDOM.randrange(6) for _ in range(n)], np.float32) for n in (1, 3, 5, 8, 9)]
    counts = [1, 1, 2, 2, 3]
    for row, count, got in zip(rows, counts, crosssplit.cheapest(rows, 3, counts)):
        sound = [c for c in itertools.combinations(range(len(row)), count) if all(b - a >= 3 for a, b in zip(c, c[1:]))]
        assert tuple(got) in sound and row[got].sum() == min(row[list(c)].sum() for c in sound)


def test_blocks_are_disjoint_and_enough():
    np = crosssplit.np
    sizes = [*range(1, 120), 399, 400, 401, 1203]
    counts = np.array([RANDOM.randrange(9) for _ in range(1 << crosssplit.TABLE)])
    for n, (h, at, least, _) in zip(sizes, crosssplit.blocks([prose(n) for n in sizes], counts)):
        size = crosssplit.SHORT_BLOCK if n in (6, 7) else crosssplit.BLOCK
        assert len(at) == crosssplit.most_edits(n) + least and 1 <= least <= crosssplit.EXTRA + 1
        assert (np.diff(at) >= size).all() and (n < size or at[-1] + size <= n)


def test_blocks_are_counted_in_all_texts(spark):
    """More texts than any bounded part of them: every one counts, of whatever length."""
    rows = [(prose(RANDOM.choice([1, 3, 4, 5, 6, 7, 8, 20])), RANDOM.choice([None, "", prose(9)])) for _ in range(5000)]
    counts, n = crosssplit.block_counts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "class bigint, passage string, answer string"))
    np = crosssplit.np
    want = np.zeros(1 << crosssplit.TABLE, dtype=np.int64)
    for t in (t for r in rows for t in r if t):
        np.add.at(want, crosssplit.block_hashes(t, crosssplit.SHORT_BLOCK if len(t) in (6, 7) else crosssplit.BLOCK) >> np.uint64(64 - crosssplit.TABLE), 1)
    assert n == 5000 and (counts == want).all()


def test_wordings_whichever_side_is_rarer(spark):
    """A line left out on trial is left out of the index, too: answers of frequent blocks do not lose the pair."""
    p, a = prose(90), prose(60)
    odd = "劳驾把这一段话写得更像旧时的小说一些可好并且莫要太长"
    rows = [sample("t", p, a, "train", "请润色：\n"), sample("v", p, a, "valid", odd + "\n"), ("w", [("user", p + "\n\n" + odd[::-1]), ("gpt", a)], "valid", None)]
    rows += [sample(f"x{i}", prose(80), a, "train", "请润色：\n") for i in range(9)]
    q, b = prose(90), prose(60)
    rows += [sample("tq", q, b, "train", odd[3:] + "\n"), sample("vq", q, b, "valid", "请润色：\n")] + [sample(f"y{i}", prose(80), b, "train", "请润色：\n") for i in range(9)]
    assert {tuple(r) for r in crosssplit.cross_split_pairs(frame(spark, rows)).collect()} == {("t", "v"), ("t", "w"), ("tq", "vq")}
