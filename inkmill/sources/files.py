"""Reading files: texts of unknown encoding, JSON lines strictly or leniently, shards and prompt files.

Every reader that promises an order gives (path, seq): Spark's rows have none of their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.functions.text import strip
from inkmill.operators.ranking import position

CODECS = ("utf-8", "gb18030", "gbk", "big5", "utf-16")
CODECS_WIDE = (*CODECS, "utf-16-le", "utf-16-be")


def first_decoding(data: bytes | None, codecs=CODECS) -> tuple[str | None, str | None]:
    """(text, codec) of the first codec that reads all bytes; nulls for null bytes or if none does."""
    if data is None:
        return None, None
    for codec in codecs:
        try:
            return bytes(data).decode(codec), codec
        except UnicodeDecodeError:
            continue
    return None, None


def decoded(content: Column, codecs=CODECS) -> Column:
    """struct<text, encoding> by ``first_decoding``; an Arrow batch at a time."""
    codecs = tuple(codecs)

    @F.pandas_udf("text string, encoding string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_decoding(x, codecs) for x in s], columns=["text", "encoding"])

    return run(content)


def scan_texts(spark: SparkSession, root: str, codecs=CODECS, pattern: str = "*.[tT][xX][tT]") -> DataFrame:
    """(path, author, text, encoding) of the text files under ``root``; the author is the first folder, or the file's own name in the root.

    Files that no codec reads keep a null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    inner = F.regexp_extract("path", r"^(?:file:/*)?/?" + _quoted(root.strip("/")) + r"/(.*)$", 1)
    return files.select("path", F.split_part(inner, F.lit("/"), F.lit(1)).alias("author"), decoded(F.col("content"), codecs).alias("d")).select("path", "author", "d.text", "d.encoding")


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def whole_texts(spark: SparkSession, glob: str, codecs=("utf-8",), ordered: bool = False) -> DataFrame:
    """(path, text): files, one row each, by the first of ``codecs`` that reads all of it (null if none does); in the order of paths if wanted."""
    if tuple(codecs) == ("utf-8",):
        rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    else:
        rows = spark.read.format("binaryFile").load(glob).select("path", decoded(F.col("content"), codecs)["text"].alias("text"))
    return rows.orderBy("path") if ordered else rows


def numbered_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(path, seq, line), ``seq`` from 0 within each file; a line feed at the end begins no line.

    Large files are read in splits: lines are counted within theirs, and the sizes of a file's splits summed up.
    """
    lines = spark.read.option("lineSep", "\n").text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    blocks = lines.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(blocks, ["path", "_block"]).select("path", (F.col("_start") + F.col("_at") - F.col("_first")).alias("seq"), "line")


def json_lines(spark: SparkSession, glob: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines under an explicit schema; blank lines are skipped. A bad line fails the read, or is dropped if not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(glob)


def json_lines_with_rejects(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Every line; those that are no JSON of ``schema`` carry their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(glob)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def ordered_shards(spark: SparkSession, glob: str, schema: str, most: int = 0) -> DataFrame:
    """Shards in the order of their names, rows in the order of their lines, the first ``most`` of all (0: all); blank lines do not count.

    The cap is a position in that order, found from counts per stretch of lines, so it may be as large as the table.
    """
    rows = numbered_lines(spark, glob).where(F.trim("line") != "")
    if most:
        rows = position(rows, [F.col("path"), F.col("seq")], F.struct("path", F.floor(F.col("seq") / 65536)), name="_row").where(F.col("_row") <= most)
    return rows.select("path", "seq", F.from_json("line", schema).alias("r")).orderBy("path", "seq").select("path", "seq", "r.*")


def prompts(lines: DataFrame, default_system: str, column: str = "value") -> DataFrame:
    """(system, user) of lines that hold JSON with these keys, or else are the user's text; blank lines are skipped."""
    j = F.from_json(F.col(column), "system string, user string")
    line = strip(F.col(column))
    is_object = line.startswith("{") & j["user"].isNotNull()
    return lines.where(line != "").select(
        F.coalesce(F.nullif(F.when(is_object, j["system"]), F.lit("")), F.lit(default_system)).alias("system"), F.when(is_object, j["user"]).otherwise(line).alias("user")
    )
