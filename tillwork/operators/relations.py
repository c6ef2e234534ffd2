"""The relations the metrics share: sessions, checkouts, sold carts, cart values.

All of them aggregate on the map side before they shuffle, so a session or a
cart that owns a large part of the rows arrives at its reducer as one row per
map task. Joins carry no broadcast hint: adaptive execution broadcasts a side
when its measured size allows it and splits hot keys when it does not.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions import endpoints as E
from tillwork.functions.values import whole_seconds
from tillwork.operators.skew import own_shuffle


def checkouts(events: DataFrame) -> DataFrame:
    """Every cart checkout: session, time and the cart code in the path."""
    return events.where(E.is_checkout()).select(
        "session_id", "event_timestamp", E.checkout_cart_code().alias("cart_code")
    )


def sale_sessions(events: DataFrame) -> DataFrame:
    """Sessions with at least one checkout."""
    return checkouts(events).select("session_id").distinct()


def session_facts(events: DataFrame) -> DataFrame:
    """One row per session with everything the session metrics ask for.

    A metric that reads only some of the columns pays only for those: unused
    aggregates are pruned from the plan.
    """
    order = F.struct("event_timestamp", "event_id")
    at = F.col("event_timestamp")
    grouped = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.min(at).alias("first_event_ts"),
        F.max(at).alias("last_event_ts"),
        F.min(F.when(E.is_add_to_cart(), at)).alias("first_cart_ts"),
        F.min(F.when(E.is_checkout(), at)).alias("first_checkout_ts"),
        F.max(F.col("endpoint").like(E.ANY_CHECKOUT)).alias("any_checkout_path"),
        F.min_by("endpoint", order).alias("first_endpoint"),
        F.max_by("endpoint", order).alias("last_endpoint"),
    )
    # A row without a session id is a session of its own, but never a sale: a
    # null matches nothing.
    known = F.col("session_id").isNotNull()
    return grouped.withColumns(
        {
            "duration_seconds": whole_seconds("first_event_ts", "last_event_ts"),
            "converted": F.col("first_checkout_ts").isNotNull() & known,
            "saw_checkout_path": F.coalesce("any_checkout_path", F.lit(False)) & known,
        }
    )


def sold_carts(checkout_rows: DataFrame, carts: DataFrame) -> DataFrame:
    """Ids of the carts whose code was checked out, each once, as carts have one row per id."""
    codes = checkout_rows.select(F.col("cart_code").alias("SHP_CART_CODE")).distinct()
    return carts.select("SHP_CART_ID", "SHP_CART_CODE").join(codes, "SHP_CART_CODE", "left_semi").select("SHP_CART_ID")


def sales(checkout_rows: DataFrame, carts: DataFrame, *columns: str) -> DataFrame:
    """Distinct ``columns`` of the checkouts with the id of the cart they name.

    The code stays among the distinct keys: the join has already brought equal
    codes together, so making the rows distinct needs no shuffle of its own.
    """
    named = checkout_rows.select(*columns, F.col("cart_code").alias("SHP_CART_CODE"))
    joined = named.join(carts.select("SHP_CART_ID", "SHP_CART_CODE"), "SHP_CART_CODE")
    return joined.distinct().drop("SHP_CART_CODE")


def session_carts(checkout_rows: DataFrame, carts: DataFrame) -> DataFrame:
    """Distinct (session, cart) pairs."""
    return sales(checkout_rows, carts, "session_id")


def product_prices(availability: DataFrame, prices: DataFrame) -> DataFrame:
    """One price per product: the highest over its availabilities."""
    return (
        availability.select("PRODUCT_ID", "PRODUCT_AVAIL_ID")
        .join(prices.select("PRODUCT_AVAIL_ID", "PRODUCT_PRICE_AMOUNT"), "PRODUCT_AVAIL_ID", "left")
        .groupBy("PRODUCT_ID")
        .agg(F.max("PRODUCT_PRICE_AMOUNT").alias("product_price_amount"))
    )


def units() -> F.Column:
    """Quantity of a cart line; a line without one counts as a single unit."""
    return F.coalesce("QUANTITY", F.lit(1))


def line_values(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Cart lines with units and value; a line without a price is worth 0."""
    return items.join(own_shuffle(prices), "PRODUCT_ID", "left").select(
        "SHP_CART_ID",
        "PRODUCT_ID",
        units().alias("units"),
        (F.coalesce("product_price_amount", F.lit(0).cast("decimal(18,2)")) * units()).alias("line_value"),
    )


def cart_values(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Value of every cart that has lines."""
    return line_values(items, prices).groupBy("SHP_CART_ID").agg(F.sum("line_value").alias("cart_value"))


def cart_stats(items: DataFrame) -> DataFrame:
    """Lines and units of every cart that has lines."""
    return items.groupBy("SHP_CART_ID").agg(
        F.count(F.lit(1)).alias("item_line_count"), F.sum(units()).alias("total_item_units")
    )


class Relations:
    """The shared relations over one set of tables, each built at most once.

    With ``keep=True`` the relations several metrics of a group need are held
    (memory, then disk) until :meth:`release`; a lost executor's part is
    recomputed from the tables.
    """

    def __init__(self, tables: Mapping[str, DataFrame], keep: bool = False):
        self.tables = tables
        self._keep = keep
        self._held: list[DataFrame] = []

    def _hold(self, df: DataFrame) -> DataFrame:
        if self._keep:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(df)
        return df

    def release(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    @property
    def events(self) -> DataFrame:
        return self.tables["api_performance"]

    @property
    def items(self) -> DataFrame:
        return self.tables["shopping_cart_item"].select("SHP_CART_ID", "PRODUCT_ID", "QUANTITY")

    @cached_property
    def checkouts(self) -> DataFrame:
        return self._hold(checkouts(self.events))

    @cached_property
    def sessions(self) -> DataFrame:
        return self._hold(session_facts(self.events))

    @cached_property
    def sale_sessions(self) -> DataFrame:
        return self.checkouts.select("session_id").distinct()

    @cached_property
    def sold_carts(self) -> DataFrame:
        return self._hold(sold_carts(self.checkouts, self.tables["shopping_cart"]))

    @cached_property
    def session_carts(self) -> DataFrame:
        return session_carts(self.checkouts, self.tables["shopping_cart"])

    @cached_property
    def prices(self) -> DataFrame:
        return self._hold(product_prices(self.tables["product_availability"], self.tables["product_price"]))

    @cached_property
    def sold_lines(self) -> DataFrame:
        """Lines of sold carts, equal products of a cart added up.

        The semi join has brought a cart's lines together, so adding them up takes
        no shuffle, and a cart of very many lines is small before it is priced.
        """
        lines = self.items.join(self.sold_carts, "SHP_CART_ID", "left_semi")
        return self._hold(lines.groupBy("SHP_CART_ID", "PRODUCT_ID").agg(F.sum(units()).alias("QUANTITY")))

    @cached_property
    def sold_line_values(self) -> DataFrame:
        """Value of every sold cart that has lines."""
        return self._hold(cart_values(self.sold_lines, self.prices))

    @cached_property
    def cart_values(self) -> DataFrame:
        return cart_values(self.items, self.prices)

    def valued(self, sales: DataFrame) -> DataFrame:
        """``sales`` (rows with a cart id) with the value of their cart.

        A cart's value is worked out once however often it was sold, and only
        lines of sold carts are priced.
        """
        return sales.join(own_shuffle(self.sold_line_values), "SHP_CART_ID", "left").withColumn(
            "cart_value", F.coalesce("cart_value", F.lit(0))
        )

    @cached_property
    def sold_cart_values(self) -> DataFrame:
        """Value of every sold cart; one without lines is worth 0."""
        return self.valued(self.sold_carts)

    @cached_property
    def session_cart_values(self) -> DataFrame:
        """Value per (session, sold cart)."""
        return self.valued(self.session_carts)

    @cached_property
    def session_values(self) -> DataFrame:
        return self._hold(self.session_cart_values.groupBy("session_id").agg(F.sum("cart_value").alias("session_value")))

    @cached_property
    def cart_stats(self) -> DataFrame:
        return cart_stats(self.items)
