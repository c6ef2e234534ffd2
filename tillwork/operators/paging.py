"""Pages of a sorted result, with the number of rows and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_of(df: DataFrame, order: Sequence[Column | str], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 0) of ``df`` with ``total_count`` and ``total_pages``.

    Sort, offset and limit run as a distributed top-k. The total is a scalar
    subquery; pages are rounded up, so an exact multiple has no empty last page.
    """
    total = df.agg(F.count(F.lit(1)))
    rows = df.orderBy(*order).offset(page * size).limit(size)
    rows = rows.withColumn("total_count", total.scalar())
    return rows.withColumn("total_pages", F.ceil(F.col("total_count") / size))
