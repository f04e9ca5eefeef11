"""Operators across records: union, resume, merging, quote repair, unique names."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.functions.hanfold import to_simplified
from inkmill.functions.text import WS, strip
from inkmill.operators.ranking import position

COMBINED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("author", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("dataset", T.StringType()), T.StructField("merged_from", T.ArrayType(T.StringType())), T.StructField("merged_count", T.IntegerType()),
])
#: Signs taken off the head of a text, and a stray sign taken out of it.
LEADING = ")）】]}」』'\""
STRAY = ""
REPAIR_QUOTES = "」』”’》】〉\"'"


def tagged_union(sources: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """All rows of all sources, columns by name, each with its source's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in sources.items()])


def sanitized(spark, text: Column) -> Column:
    """Without the stray sign, in Simplified script, without closing signs at its head."""
    return F.ltrim(to_simplified(spark, F.replace(text, F.lit(STRAY), F.lit(""))), F.lit(LEADING))


def uniform(df: DataFrame) -> DataFrame:
    """The columns of ``COMBINED`` in one shape: no null author, list or count; a missing count is the list's length."""
    made = df
    for f in COMBINED.fields:
        if f.name not in df.columns:
            made = made.withColumn(f.name, F.lit(None).cast(f.dataType))
    ids = F.coalesce("merged_from", F.array().cast("array<string>"))
    return made.select("id", F.coalesce("author", F.lit("")).alias("author"), "source_file", "text", "dataset", ids.alias("merged_from"), F.coalesce("merged_count", F.size(ids)).cast("int").alias("merged_count"))


def remaining(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not done yet; null keys remain."""
    return df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def merge_every(df: DataFrame, size: int, group: str, seq: str, name: Column) -> DataFrame:
    """Every ``size`` consecutive records of a group as one: texts joined by a blank line, empty ones skipped, ids listed.

    (group, part, id, author, source_file, text, merged_from, merged_count); ``part`` counts from 0, the rest of a group is
    kept, and other fields come from the first record. ``seq`` is the place within the group; equal places go by id.
    """
    ranked = position(df, [F.col(seq), F.col("id")], F.floor(F.col(seq) / 1000), [group], "_at").withColumn("part", F.floor((F.col("_at") - 1) / size).cast("bigint"))
    rows = F.array_sort(F.collect_list(F.struct("_at", "id", "author", "source_file", "text")))
    out = ranked.groupBy(group, "part").agg(rows.alias("r"))
    texts = F.filter(F.transform("r", lambda x: x["text"]), lambda x: x.isNotNull() & (x != ""))
    first = F.col("r")[0]
    return out.select(group, "part", F.format_string("%s_pair_%05d", name, "part").alias("id"), first["author"].alias("author"), first["source_file"].alias("source_file"), F.array_join(texts, "\n\n").alias("text"), F.transform("r", lambda x: x["id"]).alias("merged_from"), F.size("r").alias("merged_count"))


def shift_quotes(df: DataFrame, group: str, seq: str, text: str = "text", least: int = 5) -> DataFrame:
    """Closing quotes at the head of a record move to the end of the record before it that is kept.

    Records shorter than ``least`` (stripped) after that are dropped, but still give their quotes; the first kept record of
    a group gives none. ``seq`` must be unique within the group. Closed form in three steps: the first record long enough,
    the last kept record before each (within buckets of 4,096 places, then a carry over the buckets), the quotes summed up.
    """
    keyed = df.where(F.col(text).isNotNull()).withColumn("_b", F.floor(F.col(seq) / 4096))
    first = keyed.where(F.length(strip(F.col(text))) >= least).groupBy(F.col(group).alias("_g")).agg(F.min(seq).alias("_first"))
    rows = keyed.join(first, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").where(F.col(seq) >= F.col("_first"))
    lead = F.regexp_extract(F.col(text), rf"^{WS}*(?:[{REPAIR_QUOTES}]{WS}*)+", 0)
    moved = F.when(F.col(seq) > F.col("_first"), lead).otherwise("")
    rows = rows.withColumn("_moved", moved).withColumn("_rest", F.substring(F.col(text), F.length("_moved") + 1, F.length(text)))
    rows = rows.withColumn("_keep", F.length(strip(F.col("_rest"))) >= least)
    kept_seq = F.when(F.col("_keep"), F.col(seq))
    within = Window.partitionBy(group, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(group, "_b").agg(F.max(kept_seq).alias("_end"))
    carry = ends.withColumn("_carry", F.max("_end").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    carry = carry.select(F.col(group).alias("_g"), F.col("_b").alias("_cb"), "_carry")
    rows = rows.withColumn("_near", F.max(kept_seq).over(within)).join(carry, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_cb"))).withColumn("_to", F.coalesce("_near", "_carry")).drop("_g", "_cb", "_carry", "_near", "_b")
    given = rows.where((F.col("_moved") != "") & F.col("_to").isNotNull()).groupBy(F.col(group).alias("_g"), F.col("_to").alias("_t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.regexp_replace("_moved", WS, "").alias("q")))), lambda x: x["q"]), "").alias("_given"))
    out = rows.where("_keep").join(given, F.col(group).eqNullSafe(F.col("_g")) & (F.col(seq) == F.col("_t")), "left")
    return out.withColumn(text, F.concat("_rest", F.coalesce("_given", F.lit("")))).select(*df.columns)


def unique_names(df: DataFrame, path: str = "path") -> DataFrame:
    """(path, name): file names made unique by ``_1``, ``_2`` … before the suffix, in the order of paths.

    A name that a third of all folders hold is counted in buckets by the first signs in which paths differ.
    """
    base = F.regexp_replace(path, r"^.*[/\\]", "")
    stem, suffix = F.regexp_replace("_base", r"\.[^.]*$", ""), F.regexp_extract("_base", r"\.[^.]*$", 0)
    ends = df.agg(F.min(path), F.max(path)).head()
    alike = len(os.path.commonprefix([x or "" for x in ends]))
    rows = position(df.select(path, base.alias("_base")), [F.col(path)], F.substring(path, 1, alike + 3), ["_base"], "_n")
    n = F.col("_n") - 1
    return rows.select(path, F.when(n == 0, F.col("_base")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix)).alias("name"))


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of an order; 0 for all of them."""
    return df.orderBy(*order).limit(n) if n else df.orderBy(*order)
