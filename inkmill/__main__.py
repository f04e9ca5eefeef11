"""Commands over folders: ``python -m inkmill COMMAND --input PATH --output PATH``. Outputs are new folders, never the input."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import rules, text
from inkmill.operators import chat, enrich, metrics, records, sequential
from inkmill.plans import pipelines
from inkmill.sources import files, sinks
from inkmill.sources.tables import ship_package

CHUNK = "id string, author string, source_file string, text string"
PAIR = "id string, author string, source_file string, wuxia_text string, vernacular_text string"
SAMPLE = "source_index int, record_id string, conversations array<struct<role:string,content:string>>"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").load(path).select("path", "content")


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = files.json_lines(spark, path, PAIR)
    return rows.select("id", F.col("vernacular_text").alias("plain"), F.col("wuxia_text").alias("styled"))


def clean(spark, a) -> DataFrame:
    rows = files.json_lines(spark, a.input, f"`{a.text_field}` string, id string")
    t = rules.drop_ad_lines(text.html_unescape(F.col(a.text_field)))
    return rows.withColumn(a.text_field, rules.drop_marks(t, rules.MARKS_GENERIC, r"\n{3,}") if a.remove_chapter_marks else t)


def extract(spark, a) -> DataFrame:
    rows = files.json_lines(spark, a.input, CHUNK + ", dataset string", strict=False)
    rows = pipelines.mentions(rows, ["source_file", "dataset"], a.term) if a.term else rows
    rows = rows.withColumn("original_length", F.length("text")).withColumn("text", rules.drop_marks(F.col("text"), rules.MARKS_AUTHOR)).withColumn("cleaned_length", F.length("text"))
    return rows.where(F.col("cleaned_length").between(a.min_length, a.max_length))


def evaluate(spark, a) -> DataFrame:
    rows = files.json_lines(spark, a.input, "record_id string, expected string, generated string")
    return metrics.evaluation_summary(rows.withColumn("rouge_l", metrics.rouge_l(F.col("expected"), text.short_reply(F.col("generated")))))


def enriched(spark, a) -> DataFrame:
    """Records with the answer of the generator that ``--config`` names; keys that ``--done`` has are skipped, ``--count`` bounds the answers."""
    rows = files.json_lines(spark, a.input, CHUNK, strict=False)
    rows = rows.where(~F.col("author").eqNullSafe(a.without_author)) if a.without_author else rows
    done = files.json_lines(spark, a.done, "id string", strict=False) if a.done else rows.select("id").limit(0)
    policy = enrich.Policy(threads=a.workers, throttle=a.throttle)
    made = enrich.enrich_rest(rows, done, "id", "text", lambda: enrich.HttpClient.from_config(a.config, a.system), a.count, "vernacular_text", policy)
    return made.withColumnRenamed("text", "wuxia_text")


def tokenizer(a):
    """Encode a list of texts, by the tokenizer file that ``--tokenizer`` names; None for characters."""
    if not a.tokenizer:
        return None
    one = sequential.library_tokenizer(a.tokenizer)[0]
    return lambda texts: [one(t) for t in texts]


def styles(a) -> dict[str, str]:
    return dict(x.split("=", 1) for x in a.style)


COMMANDS = {
    "transcode": lambda s, a: pipelines.transcoded(_raw(s, a.input)).select("path", "encoding", F.decode("content", "UTF-8").alias("text")),
    "stage-two": lambda s, a: pipelines.stage_two(files.json_lines(s, a.input, records.COMBINED, strict=False), styles(a), pipelines.style_quotas(a.count or 6000, {k: float(a.share[i]) if i < len(a.share) else 1 / len(a.style) for i, k in enumerate(styles(a))}), a.seed),
    "enrich": enriched,
    "mask": lambda s, a: pipelines.masked_corpus(files.json_lines(s, a.input, SAMPLE, strict=False), a.block_length, encode=tokenizer(a), soft=a.soft_share),
    "pack": lambda s, a: pipelines.packed_corpus(files.json_lines(s, a.input, "doc bigint, text string", strict=False), a.block_length, encode=tokenizer(a)),
    "decode": lambda s, a: pipelines.decoded_files(_raw(s, a.input)),
    "chunks": lambda s, a: pipelines.corpus_chunks(_raw(s, a.input), a.chunk_size),
    "budget-chunks": lambda s, a: pipelines.budget_corpus(_raw(s, a.input), a.prefix, a.chunk_size),
    "book-chunks": lambda s, a: pipelines.book_chunks(_raw(s, a.input), a.chunk_size),
    "scanned-chunks": lambda s, a: pipelines.scanned_book_chunks(_raw(s, a.input), a.prefix, a.chunk_size),
    "repair": lambda s, a: pipelines.repaired_chunks(files.json_lines(s, a.input, CHUNK, strict=False)),
    "clean": clean,
    "extract": extract,
    "uniform": lambda s, a: records.uniform(files.json_lines(s, a.input, records.COMBINED)),
    "merge": lambda s, a: files.ordered_shards(s, a.input, SAMPLE, a.count).drop("path", "seq"),
    "diversify": lambda s, a: pipelines.diversified(_pairs(s, a.input), a.train_polish, a.train_adversarial, a.train_summary, a.test_standard, a.test_stress, a.test_adversarial, a.system_annealing_ratio, a.seed),
    "negatives": lambda s, a: chat.lead_samples(_pairs(s, a.input).orderBy(F.md5(F.concat(F.lit(f"{a.seed}|"), "id"))).limit(a.count or 200), "id", "styled", a.seed),
    "sharegpt": lambda s, a: _pairs(s, a.input).where((text.strip(F.col("plain")) != "") & (text.strip(F.col("styled")) != "")).select(chat.to_from_value(F.lit(a.system), F.col("plain"), F.col("styled")).alias("conversations")),
    "review": lambda s, a: _pairs(s, a.input).select("id", F.col("styled").alias("input"), F.col("plain").alias("output")),
    "evaluate": evaluate,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkmill")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--chunk-size", type=int, default=800)
    p.add_argument("--prefix", default="doc")
    p.add_argument("--text-field", default="text")
    p.add_argument("--remove-chapter-marks", action="store_true")
    p.add_argument("--term", action="append", default=[])
    p.add_argument("--min-length", type=int, default=500)
    p.add_argument("--max-length", type=int, default=1500)
    p.add_argument("--count", type=int, default=0)
    p.add_argument("--system", default=chat.SYSTEMS[0])
    p.add_argument("--config", help="JSON file with the settings of the generator")
    p.add_argument("--done", default="")
    p.add_argument("--without-author", default="")
    p.add_argument("--workers", type=int, default=10)
    p.add_argument("--throttle", type=float, default=0.0)
    p.add_argument("--style", action="append", default=[], metavar="NAME=PATTERN")
    p.add_argument("--share", action="append", default=[])
    p.add_argument("--tokenizer", default="")
    p.add_argument("--block-length", type=int, default=1024)
    p.add_argument("--soft-share", type=float, default=0.0)
    for name, n in (("train-polish", 6500), ("train-adversarial", 800), ("train-summary", 700), ("test-standard", 600), ("test-stress", 200), ("test-adversarial", 200), ("seed", 42)):
        p.add_argument(f"--{name}", type=int, default=n)
    p.add_argument("--system-annealing-ratio", type=float, default=0.125)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.input.rstrip("/") == a.output.rstrip("/"):
        raise SystemExit("the output must not be the input")
    spark = SparkSession.builder.appName("inkmill").getOrCreate()
    ship_package(spark)
    sinks.write_json_lines(COMMANDS[a.command](spark, a), a.output)


if __name__ == "__main__":
    main()
