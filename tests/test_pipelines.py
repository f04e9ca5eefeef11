"""Whole paths, the command line, and the streaming form of the quote repair."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from inkmill import __main__ as cli
from inkmill.operators import chat, enrich, records, training
from inkmill.plans import pipelines
from inkmill.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


def raw(spark):
    book = "第一回 夜渡\n却说那人\n缓步上前。\n“走罢。\n”众人皆散。"
    return spark.createDataFrame([("a/书_人.txt", book.encode("gb18030")), ("b/空.txt", b""), ("c/坏.txt", None)], "path string, content binary")


def test_paths(spark):
    got = pipelines.corpus_chunks(raw(spark), 12).orderBy("id").collect()
    assert {r.source_file for r in got} == {"书_人.txt"} and "".join(r.text for r in got) == "第一回 夜渡却说那人缓步上前。\n“走罢。\n”众人皆散。"
    books = pipelines.book_chunks(raw(spark), 9).collect()
    assert {(r.source, r.author) for r in books} == {("书", "人")} and books[0]._id == "书_1"
    assert pipelines.scanned_book_chunks(raw(spark), "z", 800).head().text == "那人缓步上前。“走罢。”众人皆散。"
    assert pipelines.budget_corpus(raw(spark), "p", 512, 1).count() >= 1
    assert pipelines.transcoded(raw(spark)).where("path like '%书%'").head().content.decode().startswith("第一回")
    assert pipelines.corpus_chunks(raw(spark).where("false")).count() == 0


def test_combined(spark):
    rows = spark.createDataFrame([(f"b_{i}", "甲", "b", f"」記{i}") for i in range(3)], "id string, author string, source_file string, text string")
    got = sorted(pipelines.combined(spark, {"m": rows, "s": rows}, {"m": 2}, {"s": ["乙"]}).collect())
    assert [(r.dataset, r.merged_count, r.text) for r in got] == [("m", 2, "记0\n\n」记1"), ("m", 1, "记2")]


def test_diversified(spark):
    pairs = spark.createDataFrame([(f"k{i:03d}", f"白话{i}。", f"旧体{i}。") for i in range(30)], "id string, plain string, styled string")
    got = pipelines.diversified(pairs, 8, 3, 2, 4, 2, 1, 0.25).collect()
    assert sorted(r.split for r in got) == ["test_adversarial"] * 1 + ["test_standard"] * 4 + ["test_stress"] * 2 + ["train"] * 13
    assert sum(r.conversations[0].content in chat.QUIET_SYSTEMS for r in got) == 2
    base = [r.record_id.split("_")[0] for r in got]
    assert len(set(base)) == len(base)


def test_packed_corpus_with_another_tokenizer(spark):
    rows = spark.createDataFrame([(1, "甲乙"), (2, ""), (3, None)], "doc bigint, text string")
    got = pipelines.packed_corpus(rows, 8, encode=lambda texts: [[7] * len(t) for t in texts]).collect()
    assert sum(r.input_ids.count(7) for r in got) == len("### 语料\n### 正文\n甲乙") and len(got) == 3


class Silent:
    """A generator that answers texts of an odd length."""

    def __call__(self, t):
        return f"<{t}>" if len(t) % 2 else None


class Batched:
    calls = []

    def many(self, texts):
        return [f"{len(texts)}:{t}" for t in texts]


def test_limit_counts_answers(spark):
    rows = spark.createDataFrame([(f"k{i:03d}", "甲" * (1 if i % 9 == 8 else 2)) for i in range(90)], "id string, text string")
    none = rows.limit(0)
    policy = enrich.Policy(tries=1, pause=0)
    ids = lambda n, done=none: [r.id for r in enrich.enrich_rest(rows, done, "id", "text", Silent, n, policy=policy).collect()]
    assert ids(3) == ["k008", "k017", "k026"] and len(ids(50)) == 10 and len(ids(0)) == 10
    assert ids(2, rows.where("id < 'k020'")) == ["k026", "k035"]
    assert enrich.enrich_rest(rows.where("false"), none, "id", "text", Silent, 4, policy=policy).count() == 0


def test_batched_generator_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", "甲" if i % 3 else None) for i in range(10)], "id string, text string").coalesce(1)
    got = {r.id: r.generated for r in enrich.enrich(rows, "text", Batched, policy=enrich.Policy(batch=4)).collect()}
    assert got == {f"k{i}": ("4:甲" if k < 4 else "2:甲") for k, i in enumerate(i for i in range(10) if i % 3)}
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "temperature": 0.7, "timeout": 5}))
    client = enrich.HttpClient.from_config(str(tmp_path / "c.json"), "s")
    assert client.body["temperature"] == 0.7 and client.system == "s" and client.timeout == 5


def test_generator_over_a_local_server(spark, monkeypatch):
    """A server that fails at first and then answers in the common dialect."""
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body["messages"][1]["content"])
            ok = seen.count(seen[-1]) > 1
            self.send_response(200 if ok else 503)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "答" + seen[-1]}}]}).encode() if ok else b"")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("TEXTGEN_URL", f"http://127.0.0.1:{server.server_port}/v1")
    assert enrich.call(enrich.HttpClient("m", "s"), "甲", enrich.Policy(pause=0, throttle=0.01)) == "答甲" and seen == ["甲", "甲"]
    assert enrich.call(enrich.HttpClient("m", "s"), "乙", enrich.Policy(tries=1)) is None
    server.shutdown()


def test_rewritten_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, t in (("甲.txt", "一"), ("乙.txt", " \n"), ("丙.txt", "两个"), ("丁.txt", "三个字")):
        (tmp_path / "in" / name).write_text(t)
    pipelines.rewritten_files(spark, str(tmp_path / "in" / "*.txt"), str(tmp_path / "out"), Silent, enrich.Policy(tries=1))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"name=甲.txt", "name=丁.txt"}


def test_both_dialects_in_one_row(spark):
    rows = [("a", [("human", None, None, "问"), (None, "gpt", "答", None)])]
    df = spark.createDataFrame([(i, [{"from": f, "role": r, "content": c, "value": v} for f, r, c, v in m]) for i, m in rows], "record_id string, conversations array<struct<from:string,role:string,content:string,value:string>>")
    got = df.select(chat.unified_column(df).alias("t")).head().t
    assert [(m.role, m.content) for m in got] == [("user", "问"), ("assistant", "答")]
    made = pipelines.masked_corpus(df, 64).head()
    assert made.labels.count(-100) < 64 and len(made.input_ids) == 64


def test_unique_names_of_a_hot_name(spark):
    paths = [f"root/a{i % 7}/{i:05d}/书.txt" for i in range(500)] + ["root/x/甲", "root/y/甲"]
    got = {r.path: r.name for r in records.unique_names(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    hot = sorted(paths[:500])
    assert [got[p] for p in hot] == ["书.txt"] + [f"书_{i}.txt" for i in range(1, 500)] and got["root/y/甲"] == "甲_1"
    assert records.unique_names(spark.createDataFrame([], "path string")).count() == 0


def test_fill_in_middle_loses_nothing(spark):
    rows = spark.createDataFrame([(i, "甲乙丙丁戊"[: i % 6]) for i in range(60)], "k int, t string")
    got = pipelines.fill_in_middle(rows, "k", "t", 1.0).collect()
    for r in got:
        if r.k % 6:
            head, rest = r.t.removeprefix("<prefix>").split("<suffix>")
            tail, middle = rest.split("<middle>")
            assert head + middle + tail == "甲乙丙丁戊"[: r.k % 6]


def test_label_check(spark):
    ids = lambda t: [ord(c) for c in t]
    rows = spark.createDataFrame([(1, ids("好")), (2, ids("<|im_start|>user")), (3, [-100, -100])], "k int, labels array<int>")
    assert [r.k for r in pipelines.stray_markers(rows, F.col("labels")).collect()] == [2]
    assert training.step_estimate(F.lit(100), 8, 2) is not None


def test_command_line(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text(json.dumps({"id": "1", "wuxia_text": "彼上前。", "vernacular_text": "他上前。"}, ensure_ascii=False) + "\n")
    cli.main(["sharegpt", "--input", str(source), "--output", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out")).head().conversations[1]["value"] == "他上前。"
    with pytest.raises(SystemExit):
        cli.main(["review", "--input", str(source), "--output", str(source)])


def test_more_commands(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "甲.txt").write_bytes("夜渡寒江".encode("gb18030"))
    cli.main(["transcode", "--input", str(tmp_path / "raw"), "--output", str(tmp_path / "t")])
    assert spark.read.json(str(tmp_path / "t")).head().text == "夜渡寒江"
    source = tmp_path / "s.jsonl"
    turns = [{"role": "user", "content": "问"}, {"role": "assistant", "content": "答"}]
    source.write_text("\n".join(json.dumps({"record_id": f"r{i}", "conversations": turns[: 1 + i % 2]}) for i in range(4)))
    cli.main(["mask", "--input", str(source), "--output", str(tmp_path / "m"), "--block-length", "64"])
    got = spark.read.json(str(tmp_path / "m")).collect()
    assert {r.record_id for r in got} == {"r1", "r3"} and all(len(r.labels) == 64 for r in got)
    docs = tmp_path / "d.jsonl"
    docs.write_text("\n".join(json.dumps({"doc": i, "text": "甲乙丙" * 9}) for i in range(3)))
    cli.main(["pack", "--input", str(docs), "--output", str(tmp_path / "p"), "--block-length", "16"])
    assert spark.read.json(str(tmp_path / "p")).count() > 1
    books = tmp_path / "b.jsonl"
    books.write_text("\n".join(json.dumps({"id": f"b{i}", "dataset": "wuxia" if i % 2 else "x", "text": "夜渡寒江，众人皆散。" * 20}) for i in range(6)))
    cli.main(["stage-two", "--input", str(books), "--output", str(tmp_path / "two"), "--style", "hall=wuxia", "--share", "1.0", "--count", "2"])
    assert spark.read.json(str(tmp_path / "two")).count() == 2


def test_streamed_quote_repair(spark, tmp_path):
    rows = [("f", 0, "他说：“走罢。"), ("f", 1, "”众人皆散去。"), ("f", 2, "」"), ("f", 3, "　”夜已经深了。"), ("g", 0, "另一本书在此。")]
    df = spark.createDataFrame(rows, "g string, seq bigint, t string")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = jobs.stream_json(spark, str(tmp_path / "in"), "g string, seq bigint, t string")
    got = {(r.g, r.seq): r.t for r in jobs.read_memory(jobs.shift_quotes_stream(stream, "g", "seq", "t"), "quotes", "append").collect()}
    want = {(r.g, r.seq): r.t for r in records.shift_quotes(df, "g", "seq", "t").collect()}
    newest = {g: max(s for h, s in want if h == g) for g in ("f", "g")}
    assert got == {k: v for k, v in want.items() if k[1] < newest[k[0]]}


def test_streamed_rows_stay_off_the_driver(spark, tmp_path):
    """The repair's rows come from files that tasks wrote, also those of a group that leaves its worker in slices."""
    from inkmill.plans import catalog

    assert catalog.queries()["stream_quotes"](spark, "/root/testdata/sf0.001").count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quotes_")]  # no table in memory
    n = jobs.SLICE + 5
    spark.range(n).selectExpr("'a' as g", "id as seq", "concat(id % 2 = 1, '，一二三四五') as t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, seq bigint, t string").parquet(str(tmp_path / "in"))
    got = jobs.read_written(jobs.shift_quotes_stream(stream, "g", "seq", "t"), str(tmp_path / "out"))
    assert sorted(r.seq for r in got.collect()) == list(range(n - 1))
