from inkmill.llm import mixing


def records(spark):
    rows = [(f"a{i}", "Big-One" if i % 7 else "big one", "N " if i % 2 else "n", "甲" * (50 + i % 100)) for i in range(600)] + [(f"b{i}", "small", None, "乙" * 80) for i in range(40)]
    rows += [rows[0], ("x", None, "n", "丙" * 100), ("y", "other", "n", "丙" * 100), ("z", "small", "n", None), ("w", "small", "n", ""), (None, "small", "n", "丁")]
    return spark.createDataFrame([(*r, 9) for r in rows], "id string, dataset string, author string, text string, n_chars int")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("SMALL", 0.3, 3), ("absent", 0.2, 5)], "dataset string, target_share double, max_repeats int")
    mixture = mixing.mix(records(spark), targets)
    shares = {r.dataset: r for r in mixing.mixed_shares(mixture, targets).collect()}
    assert abs(shares["big_one"].actual_share - 0.625) < 0.01 and abs(shares["small"].actual_share - 0.375) < 0.01
    assert shares["absent"].records == 0 and shares["small"].most_copies <= 3 and shares["big_one"].most_copies <= 1
    copies = mixture.groupBy("id").agg({"copy_no": "max", "*": "count"}).collect()
    assert all(r["max(copy_no)"] == r["count(1)"] for r in copies) and not {"x", "y", "z", "w", None} & {r["id"] for r in copies}
    authors = {r.author: r.actual_share for r in mixing.author_shares(mixture).collect()}
    assert set(authors) == {"n", "unknown"} and abs(sum(authors.values()) - 1) < 1e-6
    again = mixing.mix(records(spark).repartition(7), targets)
    assert sorted(map(tuple, mixture.select("id", "copy_no").collect())) == sorted(map(tuple, again.select("id", "copy_no").collect()))


def test_total_beyond_the_caps(spark):
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.5, 2)], "dataset string, target_share double, max_repeats int")
    shares = {r.dataset: r for r in mixing.mixed_shares(mixing.mix(records(spark), targets, total=10**6), targets).collect()}
    assert shares["small"].records == 80 and shares["big_one"].records == 600


def test_empty(spark):
    targets = spark.createDataFrame([("small", 1.0, 2)], "dataset string, target_share double, max_repeats int")
    assert mixing.mix(records(spark).where("false"), targets).count() == 0
    assert mixing.mix(records(spark), targets.where("false")).count() == 0


def test_two_deliveries_of_one_key(spark):
    """Twenty keys delivered as dataset a and as dataset b: the same delivery is counted and emitted, in either order of rows."""
    rows = [(f"k{i}", d, None, "甲" * 100) for d in "ab" for i in range(20)] + [(f"o{i}", "b", None, "乙" * 100) for i in range(20)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "dataset string, target_share double, max_repeats int")
    made = []
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "id string, dataset string, author string, text string")
        mixture = mixing.mix(df, targets)
        made.append(sorted((r.id, r.dataset, r.copy_no) for r in mixture.collect()))
        assert {r.dataset: r.records for r in mixing.mixed_shares(mixture, targets).collect()} == {"a": 20, "b": 20}
    assert made[0] == made[1]


def test_length_steps_rise(spark):
    got = [r[0] for r in spark.range(1, 5000).select(mixing.length_step(mixing.F.col("id")).alias("s")).collect()]
    assert got == sorted(got) and got[0] == 0 and got[1023] == 40
