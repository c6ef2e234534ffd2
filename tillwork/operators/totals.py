"""The total rows of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.operators.carts import DISCOUNT_CODE

# Code, type and sort order of the rows.
SUBTOTAL = ("order.total.subtotal", "SUBTOTAL", 5)
SHIPPING = ("order.total.shipping", "SHIPPING", 100)
HANDLING = ("order.total.handling", "HANDLING", 120)
TOTAL = ("order.total.total", "TOTAL", 500)
FIRST_DISCOUNT, FIRST_TAX = 10, 200
VALUE = "decimal(15,4)"


_ROW = f"array<struct<CODE:string,ORDER_TOTAL_TYPE:string,SORT_ORDER:int,VALUE:{VALUE}>>"


def _row(code: Column, type_: str, order: Column, value: Column) -> Column:
    return F.struct(
        code.alias("CODE"), F.lit(type_).alias("ORDER_TOTAL_TYPE"), order.cast("int").alias("SORT_ORDER"), value.cast(VALUE).alias("VALUE")
    )


def _fixed_row(kind: tuple[str, str, int], value: Column, present: Column | None = None) -> Column:
    code, type_, order = kind
    row = F.array(_row(F.lit(code), type_, F.lit(order), value)).cast(_ROW)
    return row if present is None else F.when(present, row).otherwise(F.array().cast(_ROW))


def order_totals(
    orders: DataFrame,
    lines: DataFrame,
    extras: DataFrame,
    discounts: DataFrame,
    taxes: DataFrame,
    handling_charged: bool = True,
) -> DataFrame:
    """Additional prices, discounts, subtotal, shipping, handling, taxes and total as rows.

    ``extras`` has one row per line and additional price, ``discounts`` one per promoted
    line, and each of these becomes a row, numbered by product. Everything else is summed up
    per order and code first, so an order then has a handful of amounts however
    many lines it has; its rows are made from those in one step. Free shipping
    costs 0; handling is charged all the same. Additional prices get their own
    rows and never enter the subtotal, one-time ones neither. A line without a price counts
    as 0; ``UNPRICED_LINES`` of the total row says how many there are.
    """

    def part(rows: DataFrame, kind: str, code: Column, value: Column) -> DataFrame:
        return rows.select("ORDER_ID", F.lit(kind).alias("kind"), code.alias("code"), value.cast("decimal(28,6)").alias("value"))

    parts = (
        part(lines, "item", F.lit(""), F.col("ITEM_PRICE") * F.col("QUANTITY"))
        .unionByName(part(extras, "extra", F.col("CODE"), F.col("VALUE")))
        .unionByName(part(discounts, "discount", F.lit(DISCOUNT_CODE), F.col("VALUE").cast(VALUE)))
        .unionByName(part(taxes, "tax", F.col("TAX_CODE"), F.col("VALUE")))
        .unionByName(part(lines.where("ITEM_PRICE IS NULL"), "unpriced", F.lit(""), F.lit(1)))
    )
    per_code = parts.groupBy("ORDER_ID", "kind", "code").agg(F.coalesce(F.sum("value"), F.lit(0)).cast(VALUE).alias("value"))
    per_order = per_code.groupBy("ORDER_ID").agg(F.array_sort(F.collect_list(F.struct("kind", "code", "value"))).alias("parts"))

    wide = orders.select("ORDER_ID", "SHIPPING", "HANDLING", "FREE_SHIPPING").join(per_order, "ORDER_ID", "left")
    zero = F.lit(0).cast(VALUE)

    def of_kind(kind: str) -> Column:
        return F.coalesce(F.filter("parts", lambda p: p["kind"] == kind), F.array().cast(f"array<struct<kind:string,code:string,value:{VALUE}>>"))

    def sum_of(kind: str) -> Column:
        return F.aggregate(of_kind(kind), zero, lambda total, p: (total + p["value"]).cast(VALUE))

    def rows_of(kind: str, type_: str, first: int, step: int = 1) -> Column:
        return F.transform(of_kind(kind), lambda p, i: _row(p["code"], type_, i * step + first, p["value"])).cast(_ROW)

    shipped = F.when(F.col("FREE_SHIPPING"), zero).otherwise(F.col("SHIPPING").cast(VALUE))
    has_shipping = F.col("SHIPPING").isNotNull()
    handled = F.coalesce(has_shipping & (F.col("HANDLING") > 0) & F.lit(handling_charged), F.lit(False))
    wide = wide.withColumns(
        {
            "subtotal": sum_of("item") - sum_of("discount"),
            "shipped": F.when(has_shipping, shipped).otherwise(zero),
            "handling": F.when(handled, F.col("HANDLING").cast(VALUE)).otherwise(zero),
            "handled": handled,
            "tax": sum_of("tax"),
        }
    )
    rows = F.concat(
        rows_of("extra", "PRODUCT", 0, step=0),
        _fixed_row(SUBTOTAL, F.col("subtotal")),
        _fixed_row(SHIPPING, F.col("shipped"), has_shipping),
        _fixed_row(HANDLING, F.col("handling"), F.col("handled")),
        rows_of("tax", "TAX", FIRST_TAX),
        _fixed_row(TOTAL, F.col("subtotal") + F.col("shipped") + F.col("handling") + F.col("tax")),
    )
    unpriced = F.when(F.col("CODE") == TOTAL[0], F.col("unpriced")).alias("UNPRICED_LINES")
    summed = (
        wide.select("ORDER_ID", sum_of("unpriced").cast("bigint").alias("unpriced"), F.explode(rows).alias("row"))
        .select("ORDER_ID", "row.*", "unpriced")
        .select("ORDER_ID", "CODE", "ORDER_TOTAL_TYPE", "SORT_ORDER", "VALUE", unpriced)
    )
    return summed.unionByName(_discount_rows(orders, discounts))


def _discount_rows(orders: DataFrame, discounts: DataFrame) -> DataFrame:
    """A row per promoted line. They are numbered by a window, which spills, not gathered."""
    nth = F.row_number().over(Window.partitionBy("ORDER_ID").orderBy("PRODUCT_ID", "VALUE"))
    row = _row(F.lit(DISCOUNT_CODE), "SUBTOTAL", nth - 1 + FIRST_DISCOUNT, F.col("VALUE"))
    return (
        discounts.join(orders.select("ORDER_ID"), "ORDER_ID", "left_semi")
        .select("ORDER_ID", row.alias("row"))
        .select("ORDER_ID", "row.*", F.lit(None).cast("bigint").alias("UNPRICED_LINES"))
    )


def available_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of products that are available: what a cart's totals are made of."""
    return lines.join(products.where("AVAILABLE").select("PRODUCT_ID"), "PRODUCT_ID", "left_semi")
