"""What a product costs today, and what is in stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.values import MONEY, moment

# The region that stands for all regions.
ALL_REGIONS = "*"


def special_applies(as_of) -> Column:
    """Whether the special price of a price row holds at ``as_of``.

    With both dates between them, with only an end until then, without dates
    always if it is positive. A start alone gives no discount.
    """
    now = moment(as_of)
    start, end = F.col("SPECIAL_START").cast("timestamp"), F.col("SPECIAL_END").cast("timestamp")
    undated = start.isNull() & end.isNull() & (F.col("SPECIAL_AMOUNT") > 0)
    dated = (start.isNull() | (start < now)) & (end > now)
    return F.col("SPECIAL_AMOUNT").isNotNull() & F.coalesce(undated | dated, F.lit(False))


def has_discount(as_of) -> Column:
    """The narrower test: both dates are set and ``as_of`` lies between them."""
    now = moment(as_of)
    inside = (F.col("SPECIAL_START").cast("timestamp") < now) & (F.col("SPECIAL_END").cast("timestamp") > now)
    return F.coalesce(inside, F.lit(False))


def discount_percent(special, amount) -> Column:
    """Whole percent off, cut, not rounded."""
    share = F.try_divide(F.col(special).cast("double"), F.col(amount).cast("double"))
    return (100 - share * 100).cast("float").cast("int")


def final_prices(prices: DataFrame, as_of) -> DataFrame:
    """Every price row with its final, original and discounted price."""
    on_sale = special_applies(as_of)
    return prices.select(
        "PRODUCT_PRICE_ID",
        "PRODUCT_AVAIL_ID",
        "PRODUCT_PRICE_CODE",
        "PRODUCT_PRICE_TYPE",
        F.coalesce("DEFAULT_PRICE", F.lit(False)).alias("DEFAULT_PRICE"),
        F.when(on_sale, F.col("SPECIAL_AMOUNT")).otherwise(F.col("PRODUCT_PRICE_AMOUNT")).alias("FINAL_PRICE"),
        F.col("PRODUCT_PRICE_AMOUNT").alias("ORIGINAL_PRICE"),
        on_sale.alias("DISCOUNTED"),
        F.when(on_sale, discount_percent("SPECIAL_AMOUNT", "PRODUCT_PRICE_AMOUNT")).alias("DISCOUNT_PERCENT"),
        F.when(on_sale, F.col("SPECIAL_AMOUNT")).alias("DISCOUNTED_PRICE"),
        F.when(on_sale, F.col("SPECIAL_END")).alias("DISCOUNT_END"),
    )


_PRICE_FIELDS = [
    "PRODUCT_PRICE_ID", "PRODUCT_PRICE_CODE", "PRODUCT_PRICE_TYPE", "DEFAULT_PRICE", "FINAL_PRICE",
    "ORIGINAL_PRICE", "DISCOUNTED", "DISCOUNT_PERCENT", "DISCOUNTED_PRICE", "DISCOUNT_END",
]


def _applicable(inventory: DataFrame, prices: DataFrame, variants: DataFrame, as_of) -> DataFrame:
    """Prices that may count for a product, with ``source``: 2 for its default variant, 1 for itself."""
    defaults = variants.where("DEFAULT_SELECTION").select(F.col("VARIANT_ID").alias("PRODUCT_VARIANT"), F.lit(True).alias("is_default"))
    rows = inventory.select("PRODUCT_AVAIL_ID", "PRODUCT_ID", "PRODUCT_VARIANT", "REGION").join(defaults, "PRODUCT_VARIANT", "left")
    source = F.when(F.col("PRODUCT_VARIANT").isNull(), 1).when(F.col("is_default"), 2)
    rows = rows.withColumn("source", source).where("source IS NOT NULL")
    return rows.join(final_prices(prices, as_of), "PRODUCT_AVAIL_ID").withColumn(
        "everywhere", F.coalesce(F.col("REGION") == ALL_REGIONS, F.lit(False))
    )


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the default price, else the first; nothing if no price holds everywhere.

    One aggregation picks the set (variant before product), the region and the
    price: the greatest of a struct, so a product with very many prices is cut
    down on the map side.
    """
    rank = F.struct("source", "everywhere", "DEFAULT_PRICE", (-F.col("PRODUCT_PRICE_ID")).alias("_first"))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("everywhere", *_PRICE_FIELDS), rank).alias("best"))
    return best.where("best.everywhere").select(*keys, *[F.col(f"best.{name}") for name in _PRICE_FIELDS])


def effective_prices(inventory: DataFrame, prices: DataFrame, variants: DataFrame, as_of) -> DataFrame:
    """One price per product.

    The default variant's availabilities count if any of them has a price, else
    the product's own; of those the ones for all regions. A product left without
    a price has no row.
    """
    return _best(_applicable(inventory, prices, variants, as_of), ["PRODUCT_ID"])


def additional_prices(inventory: DataFrame, prices: DataFrame, variants: DataFrame, as_of) -> DataFrame:
    """The other prices of the products that have a default price, as rows."""
    rows = _applicable(inventory, prices, variants, as_of)
    used = rows.groupBy("PRODUCT_ID").agg(
        F.max("source").alias("used"),
        F.max(F.when(F.col("everywhere") & F.col("DEFAULT_PRICE"), F.col("source"))).alias("with_default"),
    )
    others = rows.where(F.col("everywhere") & ~F.col("DEFAULT_PRICE"))
    matched = others.join(used, "PRODUCT_ID").where("source = used AND with_default = used")
    return matched.select("PRODUCT_ID", "PRODUCT_PRICE_ID", "PRODUCT_PRICE_CODE", "PRODUCT_PRICE_TYPE", "FINAL_PRICE")


def variant_prices(inventory: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """One price per variant from its own availabilities."""
    rows = inventory.where("PRODUCT_VARIANT IS NOT NULL").select("PRODUCT_AVAIL_ID", F.col("PRODUCT_VARIANT").alias("VARIANT_ID"), "REGION")
    rows = rows.join(final_prices(prices, as_of), "PRODUCT_AVAIL_ID").withColumns(
        {"source": F.lit(1), "everywhere": F.coalesce(F.col("REGION") == ALL_REGIONS, F.lit(False))}
    )
    return _best(rows, ["VARIANT_ID"])


def availability_prices(prices: DataFrame, as_of) -> DataFrame:
    """One price per availability, whatever its region."""
    rows = final_prices(prices, as_of).withColumns({"source": F.lit(1), "everywhere": F.lit(True)})
    return _best(rows, ["PRODUCT_AVAIL_ID"])


def positive_surcharge() -> Column:
    """Sum of the positive attribute prices of a group; null if there is none."""
    return F.sum(F.when(F.col("PRICE") > 0, F.col("PRICE")))


def add_surcharge(priced: DataFrame, surcharge: Column, discounted_too: bool) -> DataFrame:
    extra = F.coalesce(surcharge, F.lit(0)).cast(MONEY)
    changed = {
        "FINAL_PRICE": (F.col("FINAL_PRICE") + extra).cast(MONEY),
        "ORIGINAL_PRICE": (F.col("ORIGINAL_PRICE") + extra).cast(MONEY),
    }
    if discounted_too:
        changed["DISCOUNTED_PRICE"] = (F.col("DISCOUNTED_PRICE") + extra).cast(MONEY)
    return priced.withColumns(changed)


def prices_with_default_attributes(priced: DataFrame, attributes: DataFrame) -> DataFrame:
    """Product prices plus their default attributes; the discounted price stays as it is."""
    extra = attributes.where("IS_DEFAULT").groupBy("PRODUCT_ID").agg(positive_surcharge().alias("_extra"))
    return add_surcharge(priced.join(extra, "PRODUCT_ID", "left"), F.col("_extra"), discounted_too=False).drop("_extra")


def product_stock(products: DataFrame, inventory: DataFrame, priced: DataFrame) -> DataFrame:
    """Quantity and price per product: the availability for all regions, else the first."""
    first = F.struct((F.col("REGION") != ALL_REGIONS).alias("elsewhere"), "PRODUCT_AVAIL_ID")
    chosen = (
        inventory.where("PRODUCT_VARIANT IS NULL")
        .withColumn("REGION", F.coalesce("REGION", F.lit("")))
        .groupBy("PRODUCT_ID")
        .agg(F.min_by("QUANTITY", first).alias("QUANTITY"))
    )
    price = priced.select("PRODUCT_ID", "FINAL_PRICE", "DISCOUNTED", "DISCOUNTED_PRICE")
    return products.select("PRODUCT_ID", "SKU").join(chosen, "PRODUCT_ID").join(price, "PRODUCT_ID", "left")


def variant_stock(variants: DataFrame, inventory: DataFrame, own_prices: DataFrame, product_level: DataFrame) -> DataFrame:
    """Quantity and price per variant, each from the product where the variant has none."""
    first = F.struct((F.col("REGION") != ALL_REGIONS).alias("elsewhere"), "PRODUCT_AVAIL_ID")
    own = (
        inventory.where("PRODUCT_VARIANT IS NOT NULL")
        .withColumn("REGION", F.coalesce("REGION", F.lit("")))
        .groupBy(F.col("PRODUCT_VARIANT").alias("VARIANT_ID"))
        .agg(F.min_by("QUANTITY", first).alias("own_quantity"))
    )
    of_product = product_level.select(
        "PRODUCT_ID", *[F.col(c).alias(f"p_{c}") for c in ("QUANTITY", "FINAL_PRICE", "DISCOUNTED", "DISCOUNTED_PRICE")]
    )
    price = own_prices.select("VARIANT_ID", "FINAL_PRICE", "DISCOUNTED", "DISCOUNTED_PRICE")
    joined = variants.select("VARIANT_ID", "PRODUCT_ID", "SKU").join(own, "VARIANT_ID", "left").join(price, "VARIANT_ID", "left")
    joined = joined.join(of_product, "PRODUCT_ID", "left")
    has_own = F.col("FINAL_PRICE").isNotNull()
    return joined.select(
        "VARIANT_ID",
        "PRODUCT_ID",
        "SKU",
        F.coalesce("own_quantity", "p_QUANTITY").alias("QUANTITY"),
        *[F.when(has_own, F.col(c)).otherwise(F.col(f"p_{c}")).alias(c) for c in ("FINAL_PRICE", "DISCOUNTED", "DISCOUNTED_PRICE")],
    )


def decrement_stock(inventory: DataFrame, products: DataFrame, ordered: DataFrame) -> DataFrame:
    """Stock after taking off what was ordered per SKU, from every availability.

    It may go negative; ``SHORT`` marks the rows where it does.
    """
    taken = ordered.groupBy("SKU").agg(F.sum("QUANTITY").alias("taken"))
    per_product = products.select("PRODUCT_ID", "SKU").join(taken, "SKU").select("PRODUCT_ID", "taken")
    left = F.col("QUANTITY") - F.coalesce("taken", F.lit(0))
    return inventory.join(per_product, "PRODUCT_ID", "left").select(
        "PRODUCT_AVAIL_ID", "PRODUCT_ID", left.alias("QUANTITY"), (left < 0).alias("SHORT")
    )
