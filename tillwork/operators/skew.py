"""Letting adaptive execution split hot join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own_shuffle(df: DataFrame) -> DataFrame:
    """Give ``df`` a shuffle of its own before it is joined with rows of hot keys.

    Adaptive execution splits a hot key only where both sides of a join come
    straight from a shuffle. A side that was just aggregated by the join key does
    not: it is joined in the tasks that aggregated it, and the other side's hot key
    stays in one of them. Rebalancing it first costs one more move of the smaller,
    aggregated side and lets the larger side be split.
    """
    return df.hint("rebalance")
