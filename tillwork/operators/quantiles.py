"""Exact percentiles, interpolated between the two nearest values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillwork.functions.values import round_half_up

APPROXIMATE_ACCURACY = 10_000


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs: the form the percentiles start from."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def approximate_summary(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, int]) -> DataFrame:
    """Count, total, least, most and percentiles from a sketch: one aggregation."""
    amount = F.col(value)
    sketches = [
        F.percentile_approx(amount, percent / 100, APPROXIMATE_ACCURACY).cast("double").alias(name) for name, percent in wanted.items()
    ]
    return df.groupBy(*keys).agg(
        F.count(amount).alias("count"),
        F.sum(amount).alias("total"),
        F.min(amount).alias("least"),
        F.max(amount).alias("most"),
        *sketches,
    )


def exact_summary(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, int], approximate: bool = False
) -> DataFrame:
    """Count, total, least, most and exact percentiles of an amount per key.

    No key's values are gathered anywhere:

    1. Count equal values; this is the only step that moves the whole data.
    2. Add the counts up in coarse buckets that keep the order of the values
       (steps of one percent of the value), a few thousand per key.
    3. The running total over the buckets tells in which bucket each wanted rank
       lies; only those buckets are opened and ranked value by value.

    Each bucket is ranked in its own task, and holds at most the distinct amounts
    within one percent of each other. Null values are left out. Without keys the
    result is one row even for no input.
    """
    if approximate:
        return approximate_summary(df, keys, value, wanted)
    keys = list(keys)
    amount = F.col(value)
    counts = value_counts(df.where(amount.isNotNull()), keys, value)
    magnitude = amount.cast("double")
    counts = counts.withColumn("bucket", F.signum(magnitude) * F.floor(F.log1p(F.abs(magnitude)) * 100))

    whole = Window.partitionBy(*keys)
    in_order = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = counts.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("in_bucket"),
        F.sum(amount * F.col("n")).alias("amount"),
        F.min(amount).alias("least"),
        F.max(amount).alias("most"),
    )
    buckets = buckets.select(
        *keys,
        "bucket",
        (F.sum("in_bucket").over(in_order) - F.col("in_bucket")).alias("before"),
        F.sum("in_bucket").over(in_order).alias("through"),
        F.sum("in_bucket").over(whole).alias("count"),
        F.sum("amount").over(whole).alias("total"),
        F.min("least").over(whole).alias("least"),
        F.max("most").over(whole).alias("most"),
    )

    def ranks(percent: int):
        """Ranks on either side of a percentile, and how far it lies between them (in percent)."""
        scaled = (F.col("count") - 1) * percent
        rest = scaled % 100
        low = ((scaled - rest) / 100).cast("bigint")
        return low, F.when(rest > 0, low + 1).otherwise(low), rest

    def holds(rank):
        return (F.col("before") <= rank) & (rank < F.col("through"))

    needed = F.lit(False)
    for percent in wanted.values():
        low, high, _ = ranks(percent)
        needed = needed | holds(low) | holds(high)
    summary = ["count", "total", "least", "most"]
    opened = buckets.where(needed).select(*keys, "bucket", "before", *summary)

    by_value = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(opened, [*keys, "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(by_value))

    picks = [F.max(name).alias(name) for name in summary]
    for name, percent in wanted.items():
        low, high, rest = ranks(percent)
        picks += [
            F.min(F.when(F.col("upto") > low, amount)).alias(f"{name}__low"),
            F.min(F.when(F.col("upto") > high, amount)).alias(f"{name}__high"),
            F.max(rest).alias(f"{name}__rest"),
        ]
    results = []
    for name in wanted:
        low, high = F.col(f"{name}__low").cast("decimal(30,4)"), F.col(f"{name}__high").cast("decimal(30,4)")
        step = (high - low) * F.col(f"{name}__rest") / 100
        results.append(round_half_up(low + step, 4).alias(name))
    picked = ranked.groupBy(*keys).agg(*picks)
    return picked.select(*keys, F.coalesce("count", F.lit(0)).alias("count"), *summary[1:], *results)
