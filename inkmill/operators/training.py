"""Training rows: label masks, truncation, padding and packing, with a pluggable tokenizer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.ranking import hash_number

IGNORED = -100


def char_ids(text: Column) -> Column:
    """The default tokenizer: one id per character, its code point."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))


def token_column(text: Column, encode=None) -> Column:
    """Ids by ``encode`` (a list of texts to a list of id lists; an Arrow batch at a time), by characters where it is None."""
    if encode is None:
        return F.when(text == "", F.array().cast("array<int>")).otherwise(char_ids(text))
    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        return pd.Series(encode(s.fillna("").tolist()))

    return ids(text)


def masked(df: DataFrame, prompt: Column, answer: Column, most: int, pad: int = 0, soft: Column | None = None) -> DataFrame:
    """``df`` with input_ids, attention_mask and labels of ``most`` places.

    The prompt's labels are ignored, unless ``soft`` holds; over-long answers are cut; rows whose prompt alone is longer
    than ``most`` get empty arrays, to be filtered out. ``prompt`` and ``answer`` are id arrays.
    """
    n = F.size(prompt)
    ids = F.slice(F.concat(prompt, answer), 1, most)
    quiet = F.concat(F.array_repeat(F.lit(IGNORED), n), answer)
    labels = F.slice(F.when(soft, F.concat(prompt, answer)).otherwise(quiet) if soft is not None else quiet, 1, most)
    missing = F.greatest(F.lit(0), F.lit(most) - F.size(ids))
    none = F.array().cast("array<int>")
    fits = n <= most
    return df.withColumns({
        "input_ids": F.when(fits, F.concat(ids, F.array_repeat(F.lit(pad), missing))).otherwise(none),
        "attention_mask": F.when(fits, F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing))).otherwise(none),
        "labels": F.when(fits, F.concat(labels, F.array_repeat(F.lit(IGNORED), missing))).otherwise(none),
    })


def soft_rows(key: Column, share: float = 0.2, seed: object = 42) -> Column:
    """A repeatable share of rows, by hash."""
    return hash_number(seed, key) % 10000 < int(share * 10000)


def packed(df: DataFrame, batch: str, seq: str, ids: str, length: int, eos: int, pad: int) -> DataFrame:
    """(batch, block, input_ids, attention_mask, labels): each batch's sequences, an ``eos`` after each, cut into blocks.

    The last block is padded; padding is masked and ignored, and so are separators where ``eos`` is ``pad``. Sequences are
    laid out by a running sum over the batch; each gives its pieces per block, so tokens are never one row each.
    """
    own = Window.partitionBy(batch).orderBy(seq)
    rows = df.select(batch, seq, F.concat(F.col(ids), F.array(F.lit(eos))).alias("_ids"))
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.size("_ids")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    end = F.col("_start") + F.size("_ids")
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / length), F.floor((end - 1) / length))))
    low = F.greatest(F.col("_start"), F.col("block") * length)
    high = F.least(end, (F.col("block") + 1) * length)
    rows = rows.select(batch, "block", "_start", F.slice("_ids", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int")).alias("_part"))
    made = rows.groupBy(batch, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_part"))), lambda x: x["_part"])).alias("_all"))
    full = F.concat(F.col("_all"), F.array_repeat(F.lit(pad), F.lit(length) - F.size("_all")))
    made = made.select(batch, "block", full.alias("input_ids"))
    return made.withColumn("attention_mask", F.transform("input_ids", lambda x: (x != pad).cast("int"))).withColumn("labels", F.transform("input_ids", lambda x: F.when(x == pad, F.lit(IGNORED)).otherwise(x)))


def mask_counts(df: DataFrame) -> DataFrame:
    """(rows, positions, ignored, learned) over training rows."""
    n = F.size(F.filter("labels", lambda x: x == IGNORED))
    return df.agg(F.count("*").alias("rows"), F.sum(F.size("labels")).alias("positions"), F.sum(n).alias("ignored"), F.sum(F.size("labels") - n).alias("learned"))


def step_estimate(rows: Column, batch: int, accumulation: int) -> Column:
    return F.floor(rows / (batch * accumulation)).cast("bigint")
