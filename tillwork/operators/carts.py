"""Cart lines: pricing them anew, merging carts, what has to be shipped, promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.values import moment
from tillwork.operators.prices import add_surcharge, positive_surcharge
from tillwork.operators.skew import own_shuffle

# Promotion code, first day it no longer holds, share taken off.
PROMOTIONS = [("Test1234", "2025-10-31", "0.10")]
DISCOUNT_CODE = "order.total.discount"


def priced_cart_lines(
    lines: DataFrame, line_attributes: DataFrame, owners: DataFrame, priced: DataFrame, attributes: DataFrame
) -> DataFrame:
    """Cart lines at today's price.

    The product is looked up by the line's SKU; a line whose SKU leads nowhere is
    obsolete. Chosen attributes that the product no longer has are left out, the
    others add their positive prices.
    """
    known = lines.drop("PRODUCT_ID").join(owners.select("SKU", "PRODUCT_ID"), "SKU", "left")
    offered = attributes.select("PRODUCT_ID", "ATTRIBUTE_ID", "PRICE")
    kept = line_attributes.join(offered, ["PRODUCT_ID", "ATTRIBUTE_ID"])
    extra = kept.groupBy("CART_ID", "PRODUCT_ID").agg(
        positive_surcharge().alias("_extra"), F.count(F.lit(1)).alias("kept_attributes")
    )
    price = priced.select("PRODUCT_ID", "FINAL_PRICE", "ORIGINAL_PRICE", "DISCOUNTED_PRICE")
    joined = known.join(own_shuffle(price), "PRODUCT_ID", "left").join(extra, ["CART_ID", "PRODUCT_ID"], "left")
    joined = add_surcharge(joined, F.col("_extra"), discounted_too=True)
    return joined.select(
        "CART_ID",
        "SKU",
        "PRODUCT_ID",
        "QUANTITY",
        F.col("PRODUCT_ID").isNull().alias("OBSOLETE"),
        F.coalesce("kept_attributes", F.lit(0)).alias("KEPT_ATTRIBUTES"),
        F.col("FINAL_PRICE").alias("ITEM_PRICE"),
        "ORIGINAL_PRICE",
        "DISCOUNTED_PRICE",
        (F.col("FINAL_PRICE") * F.col("QUANTITY")).alias("SUB_TOTAL"),
    )


def priced_carts(carts: DataFrame, priced_lines: DataFrame) -> DataFrame:
    """Subtotal per cart; a cart is obsolete if it is empty or any line is."""
    per_cart = priced_lines.groupBy("CART_ID").agg(
        F.max("OBSOLETE").alias("any_obsolete"),
        F.sum("SUB_TOTAL").alias("SUB_TOTAL"),
        F.count(F.lit(1)).alias("LINE_COUNT"),
    )
    return carts.select("CART_ID").join(per_cart, "CART_ID", "left").select(
        "CART_ID",
        F.coalesce("any_obsolete", F.lit(True)).alias("OBSOLETE"),
        F.coalesce("LINE_COUNT", F.lit(0)).alias("LINE_COUNT"),
        "SUB_TOTAL",
    )


def line_attribute_key(line_attributes: DataFrame) -> DataFrame:
    """The attributes of a cart line as one comparable text."""
    return line_attributes.groupBy("CART_ID", "PRODUCT_ID").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("ATTRIBUTE_ID")), lambda a: a.cast("string")), ",").alias("ATTRIBUTES")
    )


def merge_carts(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines of the users' carts after the session carts are folded in.

    ``pairs`` has ``SESSION_CART``, ``USER_CART`` and both customers. If both
    belong to the same customer and both have lines, the user's cart stays as it
    is. Lines of the same product with the same attributes add up.
    """
    with_lines = lines.select("CART_ID").distinct()
    pairs = (
        pairs.join(with_lines.select(F.col("CART_ID").alias("USER_CART"), F.lit(True).alias("user_has")), "USER_CART", "left")
        .join(with_lines.select(F.col("CART_ID").alias("SESSION_CART"), F.lit(True).alias("session_has")), "SESSION_CART", "left")
    )
    same = F.coalesce(F.col("SESSION_CUSTOMER") == F.col("USER_CUSTOMER"), F.lit(False))
    stays = same & F.col("user_has").isNotNull() & F.col("session_has").isNotNull()
    moved = pairs.where(~stays).select(F.col("SESSION_CART").alias("CART_ID"), "USER_CART")
    users = pairs.select(F.col("USER_CART").alias("CART_ID")).distinct()
    own = lines.join(users, "CART_ID", "left_semi")
    folded = lines.join(moved, "CART_ID").withColumn("CART_ID", F.col("USER_CART")).select(*lines.columns)
    return own.unionByName(folded).groupBy("CART_ID", "PRODUCT_ID", "ATTRIBUTES").agg(F.sum("QUANTITY").alias("QUANTITY"))


def shippable_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of products that are not virtual and can be shipped."""
    wanted = products.where(~F.col("PRODUCT_VIRTUAL") & F.col("PRODUCT_SHIP")).select("PRODUCT_ID")
    return lines.join(wanted, "PRODUCT_ID", "left_semi")


def requires_shipping(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per cart whether anything in it has to be shipped."""
    ships = (~F.col("PRODUCT_VIRTUAL") & F.col("PRODUCT_SHIP")).alias("ships")
    return (
        lines.select("CART_ID", "PRODUCT_ID")
        .join(products.select("PRODUCT_ID", ships), "PRODUCT_ID", "left")
        .groupBy("CART_ID")
        .agg(F.coalesce(F.max("ships"), F.lit(False)).alias("REQUIRES_SHIPPING"))
    )


def promotions(spark) -> DataFrame:
    rows = spark.createDataFrame(PROMOTIONS, "PROMO_CODE STRING, ENDS STRING, RATE STRING")
    return rows.select("PROMO_CODE", F.to_date("ENDS").alias("ENDS"), F.col("RATE").cast("decimal(5,4)").alias("RATE"))


def promo_discounts(carts: DataFrame, lines: DataFrame, priced: DataFrame, promos: DataFrame, as_of) -> DataFrame:
    """Amount taken off each line of a cart whose promotion code holds at ``as_of``.

    A code counts once it has been added, and as long as the promotion runs.
    """
    now = moment(as_of)
    added = F.coalesce(F.to_date("PROMO_ADDED"), F.to_date(now))
    holding = (
        carts.where(added <= F.to_date(now))
        .join(promos.where(F.col("ENDS").cast("timestamp") > now), "PROMO_CODE")
        .select("CART_ID", "PROMO_CODE", "RATE")
    )
    price = priced.select("PRODUCT_ID", "FINAL_PRICE")
    value = F.col("FINAL_PRICE") * F.col("RATE") * F.col("QUANTITY")
    return lines.join(holding, "CART_ID").join(own_shuffle(price), "PRODUCT_ID").select(
        "CART_ID", "PRODUCT_ID", "PROMO_CODE", value.cast("decimal(28,6)").alias("VALUE")
    )
