"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from inkmill.plans.lineage import cut
from inkmill.sources import files, sinks
from inkmill.streaming import jobs


def test_decoding():
    t = "夜渡寒江"
    assert files.first_decoding(t.encode()) == (t, "utf-8")
    assert files.first_decoding(t.encode("gb18030"))[0] == t
    assert files.first_decoding(None) == (None, None)
    assert files.first_decoding(b"") == ("", "utf-8")
    assert files.first_decoding(b"\xff\xff\xff", ("utf-8", "gb18030")) == (None, None)


def test_scan_and_readers(spark, tmp_path):
    (tmp_path / "某甲").mkdir()
    (tmp_path / "某甲" / "书.TXT").write_bytes("夜渡".encode("gb18030"))
    (tmp_path / "单.txt").write_text("一\n二")
    got = {r.author: (r.text, r.encoding) for r in files.scan_texts(spark, str(tmp_path)).collect()}
    assert got["某甲"] == ("夜渡", "gb18030") and got["单.txt"] == ("一\n二", "utf-8")
    assert sorted((r.seq, r.line) for r in files.numbered_lines(spark, str(tmp_path / "单.txt")).collect()) == [(0, "一"), (1, "二")]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "chunk_0001.jsonl"
    p.write_text('{"id": "1"}\n\n坏\n{"id": "2"}\n')
    assert files.json_lines(spark, str(p), "id string", strict=False).count() == 2
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), "id string").collect()
    rows = files.json_lines_with_rejects(spark, str(p), "id string").collect()
    assert [r._corrupt_record for r in rows if r._corrupt_record] == ["坏"]
    (tmp_path / "chunk_0000.jsonl").write_text('{"id": "0"}\n')
    assert [r.id for r in files.ordered_shards(spark, str(tmp_path / "chunk_*.jsonl"), "id string", 2).collect()] == ["0", "1"]
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x"}, {"id": "y"}]))
    assert files.json_array(spark, str(tmp_path / "a.json"), "id string").count() == 2


def test_whole_texts_in_order(spark, tmp_path):
    for name, codec in (("b", "gb18030"), ("a", "utf-8"), ("c", "big5")):
        (tmp_path / f"{name}.txt").write_bytes("夜渡寒江".encode(codec))
    rows = files.whole_texts(spark, str(tmp_path / "*.txt"), files.CODECS, ordered=True).collect()
    assert [r.path[-5:] for r in rows] == ["a.txt", "b.txt", "c.txt"] and [r.text for r in rows[:2]] == ["夜渡寒江"] * 2
    assert files.whole_texts(spark, str(tmp_path / "a.txt")).head().text == "夜渡寒江"


def test_checkpoints_are_cleared(spark):
    import gc
    import os
    import time

    from inkmill.plans.lineage import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    held = cut(spark.range(7))
    before = set(os.listdir(folder))
    assert before and held.count() == 7
    del held
    for _ in range(20):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if before - set(os.listdir(folder)):
            break
        time.sleep(0.5)
    else:
        raise AssertionError("no checkpoint was cleared")


def test_lines_of_split_files(spark, tmp_path):
    want = []
    for f in ("chunk_0.jsonl", "chunk_1.jsonl", "chunk_2.jsonl"):
        some = ["" if i % 97 == 5 else json.dumps({"id": f"{f}-{i}", "pad": "夜" * (i % 40)}) for i in range(3000)]
        (tmp_path / f).write_text("\n".join(some) + ("\n" if f != "chunk_1.jsonl" else ""))
        want += [(f, i, x) for i, x in enumerate(some) if x]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        glob = str(tmp_path / "chunk_*.jsonl")
        assert spark.read.text(glob).rdd.getNumPartitions() > 6
        got = sorted((r.path.rsplit("/", 1)[1], r.seq, r.line) for r in files.numbered_lines(spark, glob).collect() if r.line)
        assert got == want
        rows = files.ordered_shards(spark, glob, "id string", 4000).collect()
        assert [(r.path.rsplit("/", 1)[1], r.seq) for r in rows] == [x[:2] for x in want[:4000]]
        assert [r.id for r in rows] == [json.loads(x[2])["id"] for x in want[:4000]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_spread_runs_nothing(spark):
    from inkmill.sources.tables import spread

    asked = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    shuffled = spark.range(1000).repartition(3).distinct()
    assert spread(shuffled) is shuffled and not asked.getJobIdsForGroup("spread")
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_json_array_is_bounded(spark):
    with pytest.raises(ValueError):
        sinks.json_array_text(spark.range(11), ["id"], 10)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a/b", "夜", 0), ("2", None, None, 150)], "id string, author string, text string, i int")
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    lines = [x for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and any("夜" in x for x in lines) and any('"text":null' in x for x in lines)
    sinks.write_by_author(rows, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"_author=a_b", "_author=unknown"}
    sinks.write_buckets(rows, str(tmp_path / "b"), "i")
    assert {p.name for p in (tmp_path / "b").iterdir() if p.is_dir()} == {"bucket=0", "bucket=1"}
    sinks.write_texts(rows.where("id = '1'"), str(tmp_path / "t"), "id", "text")
    assert spark.read.text(str(tmp_path / "t")).head().value == "夜"
    assert [r["id"] for r in json.loads(sinks.json_array_text(rows, ["id"]).head().value)] == ["1", "2"]
    ids = sinks.chunk_records(spark.createDataFrame([("甲" * 12 + "|乙|" + "丙" * 10,)], "t string"), F.split("t", r"\|"), "p")
    assert [r.id for r in ids.collect()] == ["p_00000", "p_00002"]


def test_stream_resumes_without_repeats(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = lambda *ids: spark.createDataFrame([(i, "t" + i) for i in ids], "id string, text string")
    rows("1", "2", "2").coalesce(1).write.mode("append").json(source)
    run = lambda: jobs.append_once(jobs.stream_json(spark, source, "id string, text string"), out, mark, lambda d: d.withColumn("n", F.length("text"))).awaitTermination()
    run()
    rows("2", "3").coalesce(1).write.mode("append").json(source)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]
    assert {r.batch for r in spark.read.parquet(out).select("batch").distinct().collect()} == {0, 1}


def test_cut_reads_the_same(spark):
    assert cut(spark.range(5)).count() == 5
