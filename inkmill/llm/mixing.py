"""Mixing sources to target shares by systematic sampling.

Every record of a source is expected in as many copies as the source must be repeated; the expected copies are summed
up along a fixed order of the source, one random offset is added, and a record is emitted once for each whole number
that its interval covers. The order is by length, then hash, so equal steps take equal shares of every length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.ranking import hash_key, hash_number
from inkmill.plans.lineage import written

#: Hexadecimal digits of the order's hash that cut a class of length into parts: 4,096 of them. Prefix sums run over the
#: parts, which are few, and within a part, so that a source of 10^10 records of like length has some 10^6 in each.
PART_DIGITS = 3


def plain_name(name: Column) -> Column:
    """One spelling of a dataset or author: lower case, letters and digits, runs of other signs as one underscore; null if blank."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "_")
    out = F.regexp_replace(out, r"^_+|_+$", "")
    return F.when(F.length(out) > 0, out)


def length_step(n: Column) -> Column:
    """The class of a length of at least 1: four to each doubling, in whole numbers that any engine repeats."""
    bits = F.length(F.bin(n)) - 1
    return (bits * 4 + F.floor(n * 4 / F.pow(F.lit(2.0), bits)) - 4).cast("int")


def mix_plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(dataset, target_share, max_repeats, available, wanted, copies): what each source must give.

    Shares are taken of their sum over the sources that have text. Without ``total`` the mixture is as large as the caps
    allow with every share met; with a larger ``total``, sources at their cap give what they can.
    """
    plan = targets.select(plain_name(F.col("dataset")).alias("dataset"), F.col("target_share").cast("decimal(18,9)").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    plan = plan.where("dataset is not null and target_share > 0 and max_repeats > 0").groupBy("dataset").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = plan.join(sizes, "dataset", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    whole = Window.partitionBy(F.lit(0))  # one row per source of the target table
    present = F.when(F.col("available") > 0, F.col("target_share"))
    share = present.cast("double") / F.sum(present).over(whole).cast("double")
    size = F.lit(float(total)) if total else F.min(F.col("available") * F.col("max_repeats") / F.col("_share")).over(whole)
    plan = plan.withColumn("_share", share).withColumn("wanted", F.coalesce(F.col("_share") * size, F.lit(0.0)))
    copies = F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return plan.withColumn("copies", copies).drop("_share")


def mix(records: DataFrame, targets: DataFrame, key: str = "id", text: str = "text", dataset: str = "dataset", seed: int = 42, total: float | None = None) -> DataFrame:
    """The mixture: the records' rows with ``dataset`` in one spelling, ``n_chars`` and ``copy_no`` from 1 to the record's copies.

    Rows delivered under one key count once, as the delivery that is least by dataset, length, hash of the text and the
    other columns, whatever the order of rows. Records without a dataset or of one without a target, and null or empty
    texts, add nothing to any share and are left out. No record is used more than its dataset's ``max_repeats`` times.
    A source may hold any share of the rows: its order is cut into parts by length and hash, and only sums of parts meet.
    """
    order = hash_key(seed, F.col(key))
    rows = records.withColumn(dataset, plain_name(F.col(dataset))).where(F.col(dataset).isNotNull() & (F.length(text) > 0) & F.col(key).isNotNull())
    others = [F.col(c) for c in records.columns if c not in (key, text, dataset)]
    rows = rows.withColumn("_row", F.concat(F.md5(text), F.to_json(F.struct(F.lit(0), *others)))).withColumn("n_chars", F.length(text).cast("bigint"))
    # One delivery per key, chosen without its text, which is shuffled once and only in the last join; written, since three sums read it.
    one = rows.groupBy(key).agg(F.min(F.struct(dataset, "n_chars", "_row")).alias("_one"))
    slim = written(one.select(key, f"_one.{dataset}", "_one.n_chars", F.md5(F.concat_ws("|", f"_one.{dataset}", "_one._row")).alias("_row"), length_step(F.col("_one.n_chars")).alias("_step"), order.alias("_order"), F.left(order, F.lit(PART_DIGITS)).alias("_part")))
    sizes = slim.groupBy(F.col(dataset).alias("dataset")).agg(F.sum("n_chars").alias("available"))
    plan = mix_plan(sizes, targets, total)
    parts = slim.groupBy(dataset, "_step", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(dataset).orderBy("_step", "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(dataset, "_step", "_part").orderBy("_order", key)
    placed = slim.withColumn("_rank", F.row_number().over(within)).join(parts, [dataset, "_step", "_part"]).join(F.broadcast(plan.select(F.col("dataset").alias(dataset), "copies", "max_repeats")), dataset)
    offset = hash_number(seed, F.col(dataset)) / float(1 << 32)
    at = F.col("_before") + F.col("_rank")
    upto = lambda n: F.floor(n * F.col("copies") + offset)
    count = F.least(upto(at) - upto(at - 1), F.col("max_repeats").cast("bigint"))
    placed = placed.select(key, "_row", count.cast("int").alias("_count")).where("_count > 0")
    # What is dropped are repeats equal in every column; the join has clustered the rows by these two already.
    out = rows.withColumn("_row", F.md5(F.concat_ws("|", dataset, "_row"))).join(placed, [key, "_row"]).dropDuplicates([key, "_row"])
    return out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count", "_row")


def mixed_shares(mixture: DataFrame, targets: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, target_share, wanted_share, actual_chars, actual_share, records, most_copies) per dataset of the targets."""
    got = mixture.groupBy(F.col(dataset).alias("dataset")).agg(F.sum("n_chars").alias("actual_chars"), F.count("*").alias("records"), F.max("copy_no").alias("most_copies"))
    plan = targets.select(plain_name(F.col("dataset")).alias("dataset"), F.col("target_share").cast("double").alias("target_share")).where("dataset is not null").groupBy("dataset").agg(F.sum("target_share").alias("target_share"))
    whole = Window.partitionBy(F.lit(0))  # one row per source of the target table
    out = plan.join(got, "dataset", "left").fillna(0, ["actual_chars", "records", "most_copies"])
    return out.select("dataset", "target_share", F.round(F.col("target_share") / F.sum("target_share").over(whole), 9).alias("wanted_share"), "actual_chars", F.round(F.col("actual_chars") / F.sum("actual_chars").over(whole), 9).alias("actual_share"), "records", "most_copies")


def author_shares(mixture: DataFrame, author: str = "author") -> DataFrame:
    """(author, actual_chars, actual_share): spellings of one author together; null, blank and ``unknown`` as ``unknown``."""
    who = F.coalesce(plain_name(F.col(author)), F.lit("unknown"))
    got = mixture.groupBy(who.alias("author")).agg(F.sum("n_chars").alias("actual_chars"))
    total = got.agg(F.sum("actual_chars").alias("_total"))
    return got.crossJoin(F.broadcast(total)).select("author", "actual_chars", F.round(F.col("actual_chars") / F.col("_total"), 9).alias("actual_share"))
