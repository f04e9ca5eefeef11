"""Writing files: JSON lines, JSON arrays, per-author and bucketed folders, plain texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import strip


def chunk_records(df: DataFrame, chunks: Column, prefix: Column | str, least: int = 10) -> DataFrame:
    """(id, chunk): stripped chunks of at least ``least`` characters; ids count before the short ones go, so they leave gaps."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    out = df.select(prefix.alias("_prefix"), F.posexplode(chunks).alias("_pos", "_c")).select(F.format_string("%s_%05d", "_prefix", "_pos").alias("id"), strip(F.col("_c")).alias("chunk"))
    return out.where(F.length("chunk") >= least)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True) -> None:
    """UTF-8 JSON lines; never escaped to ASCII."""
    df.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def json_array_text(df: DataFrame, order: list[str], most: int = 100_000) -> DataFrame:
    """(value): small results as one pretty JSON array, in order; an error for more than ``most`` rows, which belong into JSON lines."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for one JSON array")
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), row.alias("r")))), lambda x: x["r"]), {"pretty": "true"}).alias("value"))


def safe_name(name: Column) -> Column:
    """A folder name: slashes as underscores, ``unknown`` for blank."""
    out = F.regexp_replace(strip(name), r"[/\\]", "_")
    return F.when(F.length(out) > 0, out).otherwise("unknown")


def write_by_author(df: DataFrame, path: str, author: str = "author", parts: int = 8) -> None:
    """One folder per author. A hot author is spread over ``parts`` files, so that no task holds all of one."""
    out = df.withColumn("_author", safe_name(F.coalesce(F.col(author), F.lit(""))))
    salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(parts))
    out.withColumn("_salt", salt).repartition("_author", "_salt").drop("_salt").write.mode("overwrite").partitionBy("_author").json(path)


def write_buckets(df: DataFrame, path: str, index: str, size: int = 100) -> None:
    """Folders of ``size`` consecutive indices; a bucket written again replaces itself alone."""
    out = df.withColumn("bucket", F.floor(F.col(index) / size).cast("bigint"))
    out.repartition("bucket").sortWithinPartitions(index).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One folder per name holding its text; every row is written as it is."""
    df.select(F.col(text).alias("value"), safe_name(F.col(name)).alias("name")).repartition("name").write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(path)
