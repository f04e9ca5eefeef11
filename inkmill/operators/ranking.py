"""Positions in a total order without gathering it in one task.

A key is cut into buckets that follow the order; bucket sizes are summed up over a table of buckets alone, and positions
are counted within buckets in parallel. A group that holds a third of all rows is just more buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: object, key: Column) -> Column:
    """A shuffle order that any engine can repeat: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_number(seed: object, key: Column) -> Column:
    """A number from 0 to 2^32 - 1 by the same hash."""
    return F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("bigint")


def pick(options: list[str], seed: object, key: Column) -> Column:
    """One of ``options``, by hash."""
    return F.element_at(F.array(*map(F.lit, options)), (hash_number(seed, key) % len(options) + 1).cast("int"))


def position(df: DataFrame, order: list[Column], bucket: Column, groups: list[str] = (), name: str = "position") -> DataFrame:
    """``df`` with its 1-based position under ``order`` within ``groups``; ``bucket`` must rise with the order."""
    groups = list(groups)
    marked = df.withColumn("_b", bucket)
    sizes = marked.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    earlier = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    keys = [*groups, "_b"]
    ranked = marked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    renamed = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return ranked.join(renamed, on).withColumn(name, (F.col("_start") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_start", *[f"_k{i}" for i in range(len(keys))])


def hash_position(df: DataFrame, key: str, seed: object, groups: list[str] = (), name: str = "position") -> DataFrame:
    """Position in the seeded shuffle order; 4,096 buckets by the hash's first digits."""
    h = hash_key(seed, F.col(key))
    return position(df, [h, F.col(key)], F.substring(h, 1, 3), groups, name)


def quota_sample(df: DataFrame, group: str, key: str, quotas: dict[str, int], seed: object = 42) -> DataFrame:
    """At most ``quotas[g]`` rows of each group, the first in the seeded order; groups without a quota give none."""
    table = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    ranked = hash_position(df.where(F.col(group).isin(*quotas)), key, seed, [group], "_rank")
    return ranked.where(F.col("_rank") <= table[F.col(group)]).drop("_rank")


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the element at index n div 2 of the sorted values; over counts of values, never over lists."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_upto", upto).withColumn("_at", F.floor(F.sum("_n").over(w) / 2) + 1)
    return ranked.where("_upto >= _at").groupBy(group).agg(F.min(value).alias("median"))
