"""The shop's metrics. Each is a function from the shared relations to a frame.

Percentiles and distinct counts are exact. The metrics that have them take
``approximate=True`` to use sketches instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions import endpoints as E
from tillwork.functions.values import mean_of, percent, ratio, round_half_up, whole_seconds
from tillwork.operators.quantiles import exact_summary
from tillwork.operators.relations import Relations, line_values, sales
from tillwork.operators.skew import own_shuffle


@dataclass(frozen=True)
class Metric:
    id: str
    name: str
    build: Callable[[Relations], DataFrame]

    def __call__(self, tables: Mapping[str, DataFrame] | Relations) -> DataFrame:
        return self.build(tables if isinstance(tables, Relations) else Relations(tables))


METRICS: dict[str, Metric] = {}


def metric(id: str, name: str):
    def register(build):
        METRICS[id] = Metric(id, name, build)
        return build

    return register


def _largest(groups: DataFrame, label: str, count: str, share: str, top: int) -> DataFrame:
    """The largest groups with their share of all.

    The total is a scalar subquery over the groups: no window over all of them,
    and no second pass over what was grouped.
    """
    total = groups.agg(F.sum(count)).scalar()
    return groups.orderBy(F.desc(count), label).limit(top).withColumn(share, percent(count, total))


def _by_rank(label: str, order: list[str]):
    rank = F.lit(None)
    for position, value in reversed(list(enumerate(order))):
        rank = F.when(F.col(label) == value, position).otherwise(rank)
    return rank


# ------------------------------------------------------------- sessions and funnel


@metric("M01", "average_session_duration")
def average_session_duration(r: Relations) -> DataFrame:
    totals = r.sessions.agg(F.sum("duration_seconds").alias("s"), F.count("duration_seconds").alias("n"))
    return totals.select((ratio("s", "n") / 60).alias("average_session_minutes"))


def _has_cart():
    return F.col("first_cart_ts").isNotNull()


def _bought_after_cart():
    return F.col("first_checkout_ts") >= F.col("first_cart_ts")


@metric("M02", "cart_to_sale_conversion_rate")
def cart_to_sale_conversion_rate(r: Relations) -> DataFrame:
    return r.sessions.agg(
        F.count_if(_has_cart()).alias("sessions_with_cart"),
        F.count_if(_bought_after_cart()).alias("sessions_with_sale"),
    ).withColumn("cart_to_sale_conversion_rate_pct", percent("sessions_with_sale", "sessions_with_cart"))


@metric("M06", "visit_to_purchase_conversion_rate")
def visit_to_purchase_conversion_rate(r: Relations) -> DataFrame:
    return r.sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count_if("saw_checkout_path").alias("sale_sessions")
    ).withColumn("conversion_rate", ratio("sale_sessions", "total_sessions"))


@metric("M07", "funnel_stage_distribution")
def funnel_stage_distribution(r: Relations) -> DataFrame:
    return r.sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(_has_cart()).alias("sessions_with_cart"),
        F.count_if(_bought_after_cart()).alias("sessions_with_checkout"),
    ).withColumns(
        {
            "visit_to_cart_rate_pct": percent("sessions_with_cart", "total_sessions"),
            "cart_to_checkout_rate_pct": percent("sessions_with_checkout", "sessions_with_cart"),
            "visit_to_checkout_rate_pct": percent("sessions_with_checkout", "total_sessions"),
        }
    )


def _status():
    return F.when(F.col("converted"), "converted").otherwise("not_converted")


def _by_conversion(r: Relations, value: str, approximate: bool) -> DataFrame:
    sessions = r.sessions.withColumn("session_status", _status())
    return exact_summary(sessions, ["session_status"], value, {"p50": 50, "p95": 95}, approximate)


@metric("M14", "session_duration_by_conversion_status")
def session_duration_by_conversion_status(r: Relations, approximate: bool = False) -> DataFrame:
    return _by_conversion(r, "duration_seconds", approximate).select(
        "session_status",
        F.col("count").alias("sessions"),
        round_half_up(ratio("total", "count") / 60).alias("avg_session_duration_minutes"),
        round_half_up(F.col("p50") / 60).alias("median_session_duration_minutes"),
        round_half_up(F.col("p95") / 60).alias("p95_session_duration_minutes"),
    )


@metric("M15", "request_count_by_conversion_status")
def request_count_by_conversion_status(r: Relations, approximate: bool = False) -> DataFrame:
    return _by_conversion(r, "request_count", approximate).select(
        "session_status",
        F.col("count").alias("sessions"),
        mean_of("total", "count").alias("avg_requests_per_session"),
        round_half_up("p50", 4).alias("median_requests_per_session"),
        round_half_up("p95", 4).alias("p95_requests_per_session"),
    )


@metric("M16", "endpoint_popularity_by_conversion_status")
def endpoint_popularity_by_conversion_status(r: Relations, top: int = 10, per_status: bool = False) -> DataFrame:
    """Requests per (status, endpoint), cart paths left out; the first ``top`` rows.

    Requests are counted per (session, endpoint) first, so the join with the sale
    sessions sees a busy session once per endpoint. ``per_status`` gives ``top``
    rows of each status instead of ``top`` in all.
    """
    endpoint = F.col("endpoint")
    used = (
        r.events.where(~endpoint.like(E.GUEST_CART_PATHS) & ~endpoint.like(E.USER_CART_PATHS))
        .groupBy("session_id", "endpoint")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    buyers = r.sale_sessions.withColumn("converted", F.lit(True))
    counted = (
        used.join(own_shuffle(buyers), "session_id", "left")
        .withColumn("converted", F.coalesce("converted", F.lit(False)))
        .groupBy(_status().alias("session_status"), "endpoint")
        .agg(F.sum("requests").alias("request_count"), F.count("session_id").alias("sessions_using_endpoint"))
    )

    def first(df: DataFrame) -> DataFrame:
        return df.orderBy("session_status", F.desc("request_count"), "endpoint").limit(top)

    if not per_status:
        return first(counted)
    is_converted = F.col("session_status") == "converted"
    return first(counted.where(is_converted)).unionByName(first(counted.where(~is_converted)))


@metric("M17", "first_endpoint_entry_point_analysis")
def first_endpoint_entry_point_analysis(r: Relations, top: int = 10) -> DataFrame:
    groups = r.sessions.groupBy("first_endpoint").agg(F.count(F.lit(1)).alias("sessions"))
    return _largest(groups, "first_endpoint", "sessions", "share_of_sessions_pct", top)


@metric("M18", "last_endpoint_before_abandoned_session")
def last_endpoint_before_abandoned_session(r: Relations, top: int = 10) -> DataFrame:
    abandoned = r.sessions.where(~F.col("converted"))
    groups = abandoned.groupBy(F.col("last_endpoint").alias("last_endpoint_before_abandonment")).agg(
        F.count(F.lit(1)).alias("abandoned_sessions")
    )
    return _largest(
        groups, "last_endpoint_before_abandonment", "abandoned_sessions", "share_of_abandoned_sessions_pct", top
    )


@metric("M21", "time_from_cart_to_purchase")
def time_from_cart_to_purchase(r: Relations, approximate: bool = False) -> DataFrame:
    waits = r.sessions.where(_bought_after_cart()).select(
        whole_seconds("first_cart_ts", "first_checkout_ts").alias("seconds")
    )
    return exact_summary(waits, [], "seconds", {"p50": 50, "p95": 95}, approximate).select(
        F.col("count").alias("converted_sessions"),
        round_half_up(ratio("total", "count") / 60).alias("avg_minutes_from_cart_to_checkout"),
        round_half_up("p50", 4).alias("median_seconds_from_cart_to_checkout"),
        round_half_up("p95", 4).alias("p95_seconds_from_cart_to_checkout"),
    )


@metric("M22", "cart_abandonment")
def cart_abandonment(r: Relations) -> DataFrame:
    return r.sessions.agg(
        F.count_if(_has_cart()).alias("cart_sessions"),
        F.count_if(_has_cart() & F.col("first_checkout_ts").isNull()).alias("abandoned_cart_sessions"),
    ).withColumn("cart_abandonment_rate_pct", percent("abandoned_cart_sessions", "cart_sessions"))


# ------------------------------------------------------------------ value of sales


@metric("M03", "average_session_value_session_ltv")
def average_session_value_session_ltv(r: Relations) -> DataFrame:
    """Counts of sessions and sums of their values come from one row each; sessions and values don't meet."""
    bought = r.session_values.where("session_id IS NOT NULL").agg(
        F.struct(F.count("session_value").alias("sessions"), F.sum("session_value").alias("value")).alias("bought")
    )
    return (
        r.sessions.agg(F.count("session_id").alias("total_sessions"), F.count(F.lit(1)).alias("rows"))
        .withColumn("bought", bought.scalar())
        .select("total_sessions", "rows", F.col("bought.sessions").alias("converted_sessions"), F.col("bought.value").alias("value"))
        .select(
            "total_sessions",
            "converted_sessions",
            mean_of("value", "converted_sessions").alias("avg_session_value_converted_only"),
            mean_of(F.when(F.col("rows") > 0, F.coalesce("value", F.lit(0))), "rows").alias(
                "avg_session_value_all_sessions"
            ),
        )
    )


@metric("M05", "average_item_sold_price")
def average_item_sold_price(r: Relations) -> DataFrame:
    """Mean price of a sold unit. A sold cart without lines adds one free unit."""
    lines = line_values(r.sold_lines, r.prices).groupBy("SHP_CART_ID").agg(
        F.sum("line_value").alias("value"), F.sum("units").alias("units")
    )
    return (
        r.sold_carts.join(lines, "SHP_CART_ID", "left")
        .agg(F.sum(F.coalesce("value", F.lit(0))).alias("value"), F.sum(F.coalesce("units", F.lit(1))).alias("units"))
        .select(mean_of("value", "units").alias("avg_item_sold_price"))
    )


@metric("M08", "revenue_by_hour")
def revenue_by_hour(r: Relations, approximate: bool = False) -> DataFrame:
    """``approximate`` counts sessions and carts by sketch instead of one by one."""
    count_of = F.approx_count_distinct if approximate else F.count_distinct
    return (
        r.valued(sales(r.checkouts, r.tables["shopping_cart"], "session_id", "event_timestamp"))
        .groupBy(F.date_trunc("hour", "event_timestamp").alias("checkout_hour"))
        .agg(
            count_of("session_id").alias("sale_sessions"),
            count_of("SHP_CART_ID").alias("sold_carts"),
            F.sum("cart_value").alias("value"),
            F.count(F.lit(1)).alias("rows"),
        )
        .select(
            "checkout_hour",
            "sale_sessions",
            "sold_carts",
            round_half_up("value").alias("revenue"),
            mean_of("value", "rows").alias("avg_cart_value"),
        )
        .orderBy("checkout_hour")
    )


# Labels and upper ends of the request-count buckets.
REQUEST_BUCKETS = [("1-5 requests", 5), ("6-10 requests", 10), ("11-20 requests", 20), ("21-50 requests", 50)]
MOST_REQUESTS = "50+ requests"


@metric("M09", "revenue_by_session_intensity_bucket")
def revenue_by_session_intensity_bucket(r: Relations) -> DataFrame:
    bucket = F.lit(MOST_REQUESTS)
    for label, upto in reversed(REQUEST_BUCKETS):
        bucket = F.when(F.col("request_count") <= upto, label).otherwise(bucket)
    sold = F.col("session_value") > 0
    order = [label for label, _ in REQUEST_BUCKETS] + [MOST_REQUESTS]
    return (
        r.sessions.select("session_id", "request_count", "duration_seconds")
        .join(r.session_values, "session_id", "left")
        .groupBy(bucket.alias("request_count_bucket"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.count_if(sold).alias("converted_sessions"),
            F.coalesce(F.sum("session_value"), F.lit(0)).alias("value"),
            F.sum(F.when(sold, F.col("session_value"))).alias("sold_value"),
            F.sum("duration_seconds").alias("seconds"),
        )
        .select(
            "request_count_bucket",
            "sessions",
            "converted_sessions",
            percent("converted_sessions", "sessions").alias("conversion_rate_pct"),
            mean_of("value", "sessions").alias("avg_session_value_all_sessions"),
            mean_of("sold_value", "converted_sessions").alias("avg_session_value_converted_only"),
            round_half_up(ratio("seconds", "sessions") / 60).alias("avg_session_duration_minutes"),
        )
        .orderBy(_by_rank("request_count_bucket", order))
    )


@metric("M10", "top_products_by_sold_quantity_and_revenue")
def top_products_by_sold_quantity_and_revenue(r: Relations, top: int = 20) -> DataFrame:
    """Best sellers by revenue. Sold carts without lines show up as a null product."""
    priced = line_values(r.sold_lines, r.prices)
    with_lines = priced.select("PRODUCT_ID", "units", F.col("line_value").alias("value"), F.lit(1).alias("carts"))
    without_lines = r.sold_carts.join(r.sold_lines.select("SHP_CART_ID"), "SHP_CART_ID", "left_anti").select(
        F.lit(None).cast("bigint").alias("PRODUCT_ID"),
        F.lit(1).cast("bigint").alias("units"),
        F.lit(0).cast("decimal(18,2)").alias("value"),
        F.lit(0).alias("carts"),
    )
    return (
        with_lines.unionByName(without_lines)
        .groupBy("PRODUCT_ID")
        .agg(
            F.sum("units").alias("units_sold"),
            round_half_up(F.sum("value")).alias("product_revenue"),
            F.sum("carts").alias("sold_carts_containing_product"),
        )
        .orderBy(F.desc("product_revenue"), F.asc_nulls_last("PRODUCT_ID"))
        .limit(top)
    )


@metric("M23", "cart_value_distribution")
def cart_value_distribution(r: Relations, approximate: bool = False) -> DataFrame:
    wanted = {"median_cart_value": 50, "p75_cart_value": 75, "p90_cart_value": 90, "p95_cart_value": 95}
    return exact_summary(r.sold_cart_values, [], "cart_value", wanted, approximate).select(
        F.col("count").alias("sold_carts"),
        mean_of("total", "count").alias("avg_cart_value"),
        round_half_up("least").alias("min_cart_value"),
        round_half_up("most").alias("max_cart_value"),
        *wanted,
    )


# ----------------------------------------------------------------------- the carts


def _classified(r: Relations, carts: DataFrame, other: str) -> DataFrame:
    """Carts with ``cart_status``: sale, or ``other`` if never checked out."""
    sold = r.sold_carts.withColumn("sold", F.lit(True))
    return carts.join(sold, "SHP_CART_ID", "left").withColumn(
        "cart_status", F.when(F.col("sold"), "sale").otherwise(other)
    )


@metric("M04", "average_cart_statistics")
def average_cart_statistics(r: Relations) -> DataFrame:
    per_status = (
        _classified(r, r.cart_stats, "failed")
        .groupBy("cart_status")
        .agg(
            F.count(F.lit(1)).alias("carts"),
            F.sum("item_line_count").alias("lines"),
            F.sum("total_item_units").alias("units"),
        )
    )
    # The total row is added up from the two status rows, not from the carts.
    return (
        per_status.rollup("cart_status")
        .agg(F.sum("carts").alias("carts"), F.sum("lines").alias("lines"), F.sum("units").alias("units"))
        .select(
            F.coalesce("cart_status", F.lit("all")).alias("cart_status"),
            "carts",
            mean_of("lines", "carts").alias("avg_item_count_in_cart"),
            mean_of("units", "carts").alias("weighted_avg_items_in_cart"),
        )
        .orderBy(_by_rank("cart_status", ["all", "failed", "sale"]))
    )


# Labels of the cart-size buckets with their first and last size.
CART_SIZE_BUCKETS = [("1 item", 1, 1), ("2 items", 2, 2), ("3-5 items", 3, 5), ("6-10 items", 6, 10)]
OTHER_CART_SIZES = "10+ items"


@metric("M11", "cart_abandonment_by_cart_size")
def cart_abandonment_by_cart_size(r: Relations) -> DataFrame:
    bucket = F.lit(OTHER_CART_SIZES)
    for label, low, high in reversed(CART_SIZE_BUCKETS):
        bucket = F.when(F.col("total_item_units").between(low, high), label).otherwise(bucket)
    order = [label for label, _, _ in CART_SIZE_BUCKETS] + [OTHER_CART_SIZES]
    return (
        _classified(r, r.cart_stats, "failed")
        .groupBy(bucket.alias("cart_size_bucket"))
        .agg(
            F.count(F.lit(1)).alias("carts"),
            F.count_if(F.col("cart_status") == "sale").alias("sold_carts"),
            F.count_if(F.col("cart_status") == "failed").alias("failed_carts"),
        )
        .withColumn("cart_conversion_rate_pct", percent("sold_carts", "carts"))
        .orderBy(_by_rank("cart_size_bucket", order))
    )


@metric("M12", "successful_carts_per_successful_session")
def successful_carts_per_successful_session(r: Relations) -> DataFrame:
    per_session = r.session_carts.groupBy("session_id").agg(F.count("SHP_CART_ID").alias("carts"))
    return per_session.agg(
        F.count(F.lit(1)).alias("successful_sessions"),
        F.sum("carts").alias("total_successful_carts"),
        mean_of(F.sum("carts"), F.count(F.lit(1))).alias("avg_successful_carts_per_successful_session"),
        F.min("carts").alias("min_successful_carts_per_successful_session"),
        F.max("carts").alias("max_successful_carts_per_successful_session"),
    )


@metric("M13", "estimated_abandoned_cart_value")
def estimated_abandoned_cart_value(r: Relations, approximate: bool = False) -> DataFrame:
    classified = _classified(r, r.cart_values, "abandoned")
    return exact_summary(classified, ["cart_status"], "cart_value", {"median_cart_value": 50}, approximate).select(
        "cart_status",
        F.col("count").alias("carts"),
        round_half_up("total").alias("total_cart_value"),
        mean_of("total", "count").alias("avg_cart_value"),
        "median_cart_value",
    )


@metric("M19", "average_item_lines_per_cart")
def average_item_lines_per_cart(r: Relations) -> DataFrame:
    per_cart = r.items.groupBy("SHP_CART_ID").agg(F.count("PRODUCT_ID").alias("lines"))
    return per_cart.agg(ratio(F.sum("lines"), F.count("lines")).alias("avg_item_lines_per_cart"))


@metric("M20", "average_units_per_cart")
def average_units_per_cart(r: Relations) -> DataFrame:
    """A line without a quantity adds nothing here, unlike in ``cart_stats``."""
    per_cart = r.items.groupBy("SHP_CART_ID").agg(F.sum("QUANTITY").alias("units"))
    return per_cart.agg(ratio(F.sum("units"), F.count("units")).alias("avg_units_per_cart"))
