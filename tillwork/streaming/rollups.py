"""Running totals over the event stream that equal the batch result at any time, and revenue by windows of event time.

For running totals every micro-batch is reduced to a small part of a table whose log knows the batches it has taken in:
a batch that runs twice changes nothing, and parts are merged in tiers as more of them come. No streaming state is kept:
a session has no natural end, and an event that comes late counts like any other. Windows of event time keep state and
give each hour once, when the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillwork.functions import endpoints as E
from tillwork.functions.values import mean_of, round_half_up, whole_seconds
from tillwork.operators.relations import Relations, checkouts
from tillwork.operators.skew import own_shuffle
from tillwork.plans.metrics import METRICS
from tillwork.sources.mirror import MirroredTable, StreamBatch
from tillwork.streaming.ingest import DRAIN


def write_parts(
    events: DataFrame,
    reduce: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    fan: int = 16,
) -> StreamingQuery:
    """Store ``reduce`` of each micro-batch as a part of the table at ``path``.

    ``merge`` reduces the rows of several parts to those of one. When ``fan`` parts of a tier have come, they become one
    part of the next tier, so there are about ``fan`` parts per power of ``fan`` batches.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        table = MirroredTable(batch.sparkSession, path)
        batch.persist()
        try:
            seen = StreamBatch.of(batch, batch_id)
            if not table.taken(seen):
                table.append(reduce(batch), batch=seen)
            if table.compact(fan, merge):
                table.vacuum()
        finally:
            batch.unpersist()

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN))
        .start()
    )


def session_part(batch: DataFrame) -> DataFrame:
    """What one batch knows about its sessions; minima, maxima and counts only."""
    at = F.col("event_timestamp")
    step = F.struct("event_timestamp", "event_id", "endpoint")
    return batch.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.min(step).alias("first_step"),
        F.max(step).alias("last_step"),
        F.min(F.when(E.is_add_to_cart(), at)).alias("first_cart_ts"),
        F.min(F.when(E.is_checkout(), at)).alias("first_checkout_ts"),
    )


def merge_sessions(parts: DataFrame) -> DataFrame:
    """One row per session of the rows that several parts have of it."""
    return parts.groupBy("session_id").agg(
        F.sum("request_count").alias("request_count"),
        F.min("first_step").alias("first_step"),
        F.max("last_step").alias("last_step"),
        F.min("first_cart_ts").alias("first_cart_ts"),
        F.min("first_checkout_ts").alias("first_checkout_ts"),
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions so far: the parts of all batches merged."""
    merged = merge_sessions(MirroredTable(spark, path).read())
    first, last = F.col("first_step.event_timestamp"), F.col("last_step.event_timestamp")
    return merged.select(
        "session_id",
        "request_count",
        first.alias("first_event_ts"),
        last.alias("last_event_ts"),
        "first_cart_ts",
        "first_checkout_ts",
        F.col("first_step.endpoint").alias("first_endpoint"),
        F.col("last_step.endpoint").alias("last_endpoint"),
        whole_seconds(first, last).alias("duration_seconds"),
    )


def sales_part(batch: DataFrame) -> DataFrame:
    """The checkouts of one batch, equal ones once."""
    return checkouts(batch).distinct()


def merge_sales(parts: DataFrame) -> DataFrame:
    return parts.distinct()


class _SalesSoFar(Relations):
    """The shared relations with the checkouts taken from the stored parts."""

    def __init__(self, tables: Mapping[str, DataFrame], sales: DataFrame):
        super().__init__(tables)
        self.checkouts = sales


def read_revenue_by_hour(spark: SparkSession, path: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Revenue by hour of all checkouts so far, at today's carts and prices."""
    sales = MirroredTable(spark, path).read()
    return METRICS["M08"].build(_SalesSoFar(tables, sales))


# ------------------------------------------------------------- event-time windows


def cart_snapshot(r: Relations) -> DataFrame:
    """Code, id and value of every cart, for the windows to look up; a cart without lines is worth 0."""
    carts = r.tables["shopping_cart"].select(F.col("SHP_CART_CODE").alias("cart_code"), "SHP_CART_ID")
    return carts.join(own_shuffle(r.cart_values), "SHP_CART_ID", "left").withColumn(
        "cart_value", F.coalesce("cart_value", F.lit(0).cast("decimal(38,2)"))
    )


def revenue_windows(events: DataFrame, carts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Checkouts of each hour of event time, from a stream of events and a stored :func:`cart_snapshot`.

    An hour comes out once, when events show that it ended ``delay`` ago; a checkout that comes later than that is not
    counted (Spark tells how many there were), nor is one without a time. Equal checkouts count once. State is held per
    hour and session or cart, never per hour alone: sessions and carts of an hour are first reduced to a row each and
    then counted. The carts are read anew for each micro-batch.
    """
    at = F.col("event_timestamp")
    watched = events.select("session_id", at, "endpoint").withWatermark("event_timestamp", delay)
    # The condition has the time in it, so that all events move the watermark and not checkouts alone.
    sold = watched.where(F.when(at.isNotNull(), E.is_checkout())).select(
        "session_id", at, E.checkout_cart_code().alias("cart_code")
    )
    named = sold.dropDuplicates(["session_id", "event_timestamp", "cart_code"]).join(carts, "cart_code")
    nothing = F.lit(0).cast("decimal(38,2)")
    counted = named.select(
        at,
        F.explode(
            F.array(
                F.struct(F.lit("session").alias("kind"), F.col("session_id").cast("string").alias("id"), nothing.alias("value"), F.lit(0).alias("rows")),
                F.struct(F.lit("cart").alias("kind"), F.col("SHP_CART_ID").cast("string").alias("id"), F.col("cart_value").cast("decimal(38,2)").alias("value"), F.lit(1).alias("rows")),
            )
        ).alias("one"),
    ).select(at, "one.*")
    each = counted.groupBy(F.window("event_timestamp", "1 hour").alias("hour"), "kind", "id").agg(
        F.sum("value").alias("value"), F.sum("rows").alias("rows")
    )
    return (
        each.groupBy(F.window(F.window_time("hour"), "1 hour").alias("hour"))
        .agg(
            F.count(F.when(F.col("kind") == "session", F.col("id"))).alias("sale_sessions"),
            F.count(F.when(F.col("kind") == "cart", F.col("id"))).alias("sold_carts"),
            F.sum("value").alias("value"),
            F.sum("rows").alias("rows"),
        )
        .select(F.col("hour.start").alias("checkout_hour"), "sale_sessions", "sold_carts", "value", "rows")
    )


def write_windows(windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append ended hours to parquet files; with the checkpoint each hour is there once, also after a replay."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN))
        .start()
    )


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Revenue of the hours that have ended, as the metric has it."""
    return (
        spark.read.parquet(path)
        .select("checkout_hour", "sale_sessions", "sold_carts", round_half_up("value").alias("revenue"), mean_of("value", "rows").alias("avg_cart_value"))
        .orderBy("checkout_hour")
    )


def heartbeat(events: DataFrame, at) -> DataFrame:
    """An event of the schema of ``events`` that says only that it is ``at`` now: it ends hours, but is no request."""
    columns = [
        (F.lit(at).cast("timestamp") if f.name == "event_timestamp" else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in events.schema
    ]
    return events.sparkSession.range(1).select(*columns)
