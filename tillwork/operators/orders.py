"""Orders and their people: payments, history, reviews, searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.values import blank_to_null
from tillwork.operators.paging import page_of


def payment_state(transactions: DataFrame, start=None, end=None) -> DataFrame:
    """Per order: can it be captured, what can be captured or refunded, what came last.

    One aggregation over the transactions, optionally of a date range (both ends
    included).
    """
    if start is not None:
        transactions = transactions.where(F.col("TRANSACTION_DATE") >= F.lit(start).cast("timestamp"))
    if end is not None:
        transactions = transactions.where(F.col("TRANSACTION_DATE") <= F.lit(end).cast("timestamp"))
    kind, id_ = F.col("TRANSACTION_TYPE"), F.col("TRANSACTION_ID")

    def last_id(condition):
        return F.max(F.when(condition, id_))

    found = transactions.groupBy("ORDER_ID").agg(
        F.bool_or(kind == "AUTHORIZE").alias("authorized"),
        F.bool_or(kind.isin("CAPTURE", "AUTHORIZECAPTURE", "REFUND")).alias("settled"),
        F.bool_or(kind.isin("CAPTURE", "REFUND")).alias("closed"),
        last_id((kind == "AUTHORIZE") & blank_to_null("DETAILS").isNotNull()).alias("authorization"),
        last_id(kind == "CAPTURE").alias("capture"),
        last_id(kind == "AUTHORIZECAPTURE").alias("direct"),
        F.max_by(kind, F.struct("TRANSACTION_DATE", "TRANSACTION_ID")).alias("LAST_TYPE"),
    )
    return found.select(
        "ORDER_ID",
        (F.col("authorized") & ~F.col("settled")).alias("CAPTURABLE"),
        F.when(~F.col("closed"), F.col("authorization")).alias("CAPTURABLE_TRANSACTION"),
        F.coalesce("capture", "direct").alias("REFUNDABLE_TRANSACTION"),
        "LAST_TYPE",
    )


def transaction_detail(transactions: DataFrame, field: str) -> DataFrame:
    """One field of the JSON details of each transaction."""
    details = F.from_json("DETAILS", "MAP<STRING, STRING>")
    return transactions.select("TRANSACTION_ID", F.element_at(details, field).alias("DETAIL"))


def review_summary(reviews: DataFrame, subject: str = "PRODUCT_ID", reviewer: str = "CUSTOMER_ID") -> DataFrame:
    """Mean rating and number of reviews per subject, the latest of each reviewer counting.

    A subject with very many reviews is first cut to one row per reviewer, then
    summed on the map side.
    """
    newest = F.max(F.struct("REVIEW_DATE", "REVIEW_ID", "RATING"))
    latest = reviews.groupBy(subject, reviewer).agg(newest.alias("latest"))
    return latest.groupBy(subject).agg(
        (F.sum("latest.RATING") / F.count("latest.RATING")).alias("REVIEW_AVG"), F.count(F.lit(1)).alias("REVIEW_COUNT")
    )


def order_history(history: DataFrame) -> DataFrame:
    """Status changes per order, newest first.

    Sorted, not numbered: a sort by order and date splits even a single very long
    history over several tasks.
    """
    rows = history.select("ORDER_ID", "HISTORY_ID", "STATUS", "DATE_ADDED")
    return rows.orderBy("ORDER_ID", F.desc("DATE_ADDED"), F.desc("HISTORY_ID"))


def current_status(orders: DataFrame, history: DataFrame) -> DataFrame:
    """Where each order stands; one without history was ordered when it was bought."""
    newest = history.groupBy("ORDER_ID").agg(
        F.max_by(F.struct("STATUS", "DATE_ADDED"), F.struct("DATE_ADDED", "HISTORY_ID")).alias("now"), F.count(F.lit(1)).alias("changes")
    )
    return orders.select("ORDER_ID", "DATE_PURCHASED").join(newest, "ORDER_ID", "left").select(
        "ORDER_ID",
        F.coalesce("now.STATUS", F.lit("ORDERED")).alias("STATUS"),
        F.coalesce("now.DATE_ADDED", "DATE_PURCHASED").alias("SINCE"),
        F.coalesce("changes", F.lit(0)).alias("CHANGES"),
    )


@dataclass(frozen=True)
class OrderCriteria:
    """What an order search may ask for; a field left out does not filter."""

    store: int
    customer_name: str | None = None
    email: str | None = None
    phone: str | None = None
    id_part: str | None = None
    status: str | None = None
    payment: str | None = None
    customer_id: int | None = None
    ascending: bool = False
    page: int = 0
    size: int = 20


def matching_orders(orders: DataFrame, c: OrderCriteria) -> DataFrame:
    rows = orders.where(F.col("MERCHANT_ID") == c.store)
    if c.customer_name:
        rows = rows.where(F.col("BILLING_FIRST_NAME").contains(c.customer_name) | F.col("BILLING_LAST_NAME").contains(c.customer_name))
    if c.email:
        rows = rows.where(F.col("CUSTOMER_EMAIL").contains(c.email))
    if c.phone:
        rows = rows.where(F.col("BILLING_PHONE").contains(c.phone) | F.col("DELIVERY_PHONE").contains(c.phone))
    if c.id_part:
        rows = rows.where(F.col("ORDER_ID").cast("string").contains(c.id_part))
    if c.status:
        rows = rows.where(F.col("ORDER_STATUS") == c.status.upper())
    if c.payment:
        rows = rows.where(F.col("PAYMENT_MODULE_CODE").contains(c.payment))
    if c.customer_id is not None:
        rows = rows.where(F.col("CUSTOMER_ID") == c.customer_id)
    return rows


def order_search(orders: DataFrame, criteria: OrderCriteria) -> DataFrame:
    """A page of the matching orders, newest first unless asked otherwise."""
    rows = matching_orders(orders, criteria).select("ORDER_ID", "ORDER_STATUS", "CUSTOMER_ID", "BILLING_LAST_NAME", "ORDER_TOTAL")
    order = F.asc("ORDER_ID") if criteria.ascending else F.desc("ORDER_ID")
    return page_of(rows, [order], criteria.page, criteria.size)


@dataclass(frozen=True)
class CustomerCriteria:
    """What a customer search may ask for; a field left out does not filter."""

    store: int
    name: str | None = None
    first_name: str | None = None
    last_name: str | None = None
    email: str | None = None
    country: str | None = None
    page: int = 0
    size: int = 20


def customer_search(customers: DataFrame, c: CustomerCriteria) -> DataFrame:
    """A page of the matching customers."""
    rows = customers.where(F.col("MERCHANT_ID") == c.store)
    if c.name:
        rows = rows.where(F.col("FIRST_NAME").contains(c.name) | F.col("LAST_NAME").contains(c.name))
    for column, part in (("FIRST_NAME", c.first_name), ("LAST_NAME", c.last_name), ("EMAIL", c.email), ("COUNTRY", c.country)):
        if part:
            rows = rows.where(F.col(column).contains(part))
    rows = rows.select("CUSTOMER_ID", "FIRST_NAME", "LAST_NAME", "EMAIL", "COUNTRY")
    return page_of(rows, ["CUSTOMER_ID"], c.page, c.size)
