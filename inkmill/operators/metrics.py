"""Counts and scores of a corpus and of generated text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import lines
from inkmill.operators.ranking import upper_median


def length_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, shortest, longest, mean, median): the mean rounded down, the median the upper one of an even number."""
    stats = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("shortest"), F.max(value).alias("longest"), F.floor(F.sum(value) / F.count("*")).alias("mean"))
    medians = upper_median(df, group, value).withColumnRenamed(group, "_g")
    return stats.join(medians, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def clean_stats(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """(records, changed, removed_lines)."""
    gone = F.when(after == "", F.size(lines(before))).otherwise(F.size(lines(before)) - F.size(lines(after)))
    return df.agg(F.count("*").alias("records"), F.count_if(before != after).alias("changed"), F.sum(F.when(before != after, gone).otherwise(0)).alias("removed_lines"))


def mix_shares(df: DataFrame, group: str) -> DataFrame:
    """(group, n, share)."""
    total = df.agg(F.count("*").alias("_all"))
    return df.groupBy(group).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(group, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict = {}
    for i, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def rouge_l(expected: Column, generated: Column, mode: str = "char", beta: float = 1.0) -> Column:
    """F of the longest common subsequence, over characters without white space or over words; 0 for a null or blank side."""
    @F.pandas_udf("double")
    def score(e: pd.Series, g: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return 0.0
            a, b = ([c for c in x if not c.isspace()], [c for c in y if not c.isspace()]) if mode == "char" else (x.split(), y.split())
            if not a or not b:
                return 0.0
            n = common_length(a, b)
            p, r = n / len(b), n / len(a)
            return (1 + beta**2) * p * r / (r + beta**2 * p) if n else 0.0

        return pd.Series([one(x, y) for x, y in zip(e, g)], dtype=float)

    return score(expected, generated)


def verdict(score: Column) -> Column:
    """The band of an average score."""
    return F.when(score >= 0.95, "excellent").when(score >= 0.85, "good").when(score >= 0.70, "fair").otherwise("poor")


def rewrite_verdict(rate: Column) -> Column:
    return F.when(rate <= 0.05, "keeps").when(rate <= 0.15, "drifts").otherwise("rewrites")


def evaluation_summary(df: DataFrame, score: str = "rouge_l", least: float = 0.8) -> DataFrame:
    """(total, average, rewrites, rewrite_rate, band, rewrite_band); null averages for an empty table."""
    rewrites = F.count_if(F.col(score) < least)
    out = df.agg(F.count("*").alias("total"), F.round(F.avg(score), 6).alias("average"), rewrites.alias("rewrites"), F.round(F.try_divide(rewrites, F.count("*")), 6).alias("rewrite_rate"))
    return out.withColumn("band", F.when(F.col("average").isNotNull(), verdict(F.col("average")))).withColumn("rewrite_band", F.when(F.col("average").isNotNull(), rewrite_verdict(F.col("rewrite_rate"))))


def extremes(df: DataFrame, score: str, key: str, n: int = 3) -> DataFrame:
    """The ``n`` best and worst rows, ties by key; two bounded sorts instead of a total one."""
    top = df.orderBy(F.desc(score), key).limit(n).withColumn("side", F.lit("best"))
    return top.unionByName(df.orderBy(F.asc(score), key).limit(n).withColumn("side", F.lit("worst")))


def loss_summary(df: DataFrame, step: str, loss: str, groups: list[str] = ()) -> DataFrame:
    """(groups, steps, least, last, first, delta) of loss histories; nulls for an empty one."""
    last, first = F.max_by(loss, step), F.min_by(loss, step)
    return df.groupBy(*groups).agg(F.count("*").alias("steps"), F.min(loss).alias("least"), last.alias("last"), first.alias("first"), (last - first).alias("delta"))


def every_nth(df: DataFrame, step: str, n: int) -> DataFrame:
    """Rows of every ``n``-th step but step 0."""
    return df.where((F.pmod(F.col(step), F.lit(n)) == 0) & (F.col(step) > 0))


def at_least(df: DataFrame, score: str, least: float) -> DataFrame:
    """Rows whose score is ``least`` or more; null scores fall away."""
    return df.where(F.col(score) >= least)


def by_author(df: DataFrame, author: str = "author") -> DataFrame:
    return df.groupBy(author).agg(F.count("*").alias("records"))
