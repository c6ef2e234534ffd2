"""Shipping: who can be shipped to, by which carrier, at what price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.values import MONEY, as_column, blank_to_null

# The shop's shipping rules.
DISTANCE_PRICES = [(530, 75), (3550, 140)]
SHORT_DISTANCE_PRICES = [(40, 75), (80, 120), (2550, 140)]
PRICE_PER_KM_NEAR, PRICE_PER_KM_FAR = 2, 3
NEAR_KM, LAST_KM = 20, 150
CARRIER_COUNTRY, CARRIER_PROVINCE = "CA", "QC"
CARRIER_WEIGHT, CARRIER_SIZE = 62, 66
LIGHT_CARRIER, HEAVY_CARRIER = "canadapost", "priceByDistance"
WEIGHT_OPTION, DISTANCE_OPTION, PICKUP_OPTION = "customWeight", "priceByDistance", "storePickUp"
NO_SHIPPING = "NO_SHIPPING_TO_SELECTED_COUNTRY"


def has_postal_code(name: str = "POSTAL_CODE") -> Column:
    return blank_to_null(name).isNotNull()


def _units(parcels: DataFrame) -> tuple[DataFrame, Column]:
    """Parcels with how often each is there: once, or as its ``QUANTITY`` says, so lines needn't be made into units."""
    if "QUANTITY" in parcels.columns:
        return parcels.where("QUANTITY >= 1"), F.col("QUANTITY").cast("int")
    return parcels, F.lit(1)


def weight_quotes(orders: DataFrame, parcels: DataFrame, regions: DataFrame, tiers: DataFrame) -> DataFrame:
    """Price by total weight: the first tier of the region that carries it. ``parcels`` may be lines with a ``QUANTITY``.

    A region's tiers are a short list kept by the shop; they travel as one array,
    so orders are not multiplied and not grouped again.
    """
    parcels, units = _units(parcels)
    weight = parcels.groupBy("ORDER_ID").agg(F.sum(F.col("WEIGHT") * units).alias("weight"))
    tier = F.struct("POSITION", "MAX_WEIGHT", "PRICE")
    lists = tiers.groupBy("REGION").agg(F.array_sort(F.collect_list(tier)).alias("tiers"))
    by_country = regions.join(lists, "REGION").select(F.col("COUNTRY").alias("DELIVERY_COUNTRY"), "REGION", "tiers")
    fitting = F.get(F.filter("tiers", lambda t: t["MAX_WEIGHT"] >= F.col("weight")), F.lit(0))
    return (
        orders.where(has_postal_code())
        .select("ORDER_ID", "DELIVERY_COUNTRY")
        .join(weight, "ORDER_ID")
        .join(by_country, "DELIVERY_COUNTRY")
        .withColumn("tier", fitting)
        .where("tier IS NOT NULL")
        .select("ORDER_ID", "REGION", F.col("weight").alias("WEIGHT"), F.col("tier.PRICE").alias("PRICE"))
    )


def price_by_distance(distance, steps: Sequence[tuple[int, int]] = DISTANCE_PRICES) -> Column:
    """Flat price by distance in whole kilometres; an unknown distance counts as 0.

    Where two steps hold the narrower one is taken; beyond the last there is none.
    """
    km = F.coalesce(as_column(distance).cast("bigint"), F.lit(0))
    price = F.lit(None).cast(MONEY)
    for upto, value in sorted(steps, reverse=True):
        price = F.when(km <= upto, F.lit(value).cast(MONEY)).otherwise(price)
    return price


def price_per_km(distance) -> Column:
    """Distance times the price of a kilometre; none beyond the last."""
    km = as_column(distance)
    rate = F.when(km <= NEAR_KM, PRICE_PER_KM_NEAR).otherwise(PRICE_PER_KM_FAR)
    return F.when(km <= LAST_KM, (km.cast("decimal(18,4)") * rate).cast("decimal(18,4)"))


def rule_quotes(orders: DataFrame, pickup_price: float | None = None) -> DataFrame:
    """Prices by the distance rules and for collecting in the store, per order."""
    known = has_postal_code()
    return orders.select(
        "ORDER_ID",
        F.when(known, price_by_distance("DISTANCE_KM")).alias("DISTANCE_PRICE"),
        F.when(known, price_by_distance("DISTANCE_KM", SHORT_DISTANCE_PRICES)).alias("SHORT_DISTANCE_PRICE"),
        F.when(known, price_per_km("DISTANCE_KM")).alias("KM_PRICE"),
        F.lit(pickup_price).cast(MONEY).alias("PICKUP_PRICE"),
        F.when(
            F.lit(pickup_price is not None), F.concat(F.lit(PICKUP_OPTION + "_"), F.coalesce("DELIVERY_ZONE", "DELIVERY_STATE", F.lit("null")))
        ).alias("PICKUP_OPTION"),
    )


def carrier_choice(orders: DataFrame, parcels: DataFrame) -> DataFrame:
    """Carrier by total weight and longest side, both cut to whole units; null leaves it as it was.

    ``parcels`` may be lines with a ``QUANTITY``.
    """
    parcels, units = _units(parcels)
    size = F.greatest("HEIGHT", "LENGTH", "WIDTH")
    totals = parcels.groupBy("ORDER_ID").agg(
        F.sum(F.col("WEIGHT") * units).cast("bigint").alias("weight"), F.max(size).cast("bigint").alias("size")
    )
    weight, size = F.coalesce("weight", F.lit(0)), F.coalesce("size", F.lit(0))
    home = F.col("DELIVERY_COUNTRY") == CARRIER_COUNTRY
    province = F.coalesce("DELIVERY_ZONE", "DELIVERY_STATE") == CARRIER_PROVINCE
    light = (weight < CARRIER_WEIGHT) & (size < CARRIER_SIZE)
    heavy = (weight > CARRIER_WEIGHT) | (size > CARRIER_SIZE)
    carrier = F.when(home & light, LIGHT_CARRIER).when(home & province & heavy, HEAVY_CARRIER)
    joined = orders.join(totals, "ORDER_ID", "left")
    return joined.select("ORDER_ID", weight.alias("WEIGHT"), size.alias("SIZE"), carrier.alias("CARRIER"))


def shipping_eligibility(orders: DataFrame, amounts: DataFrame, settings: DataFrame, countries: DataFrame) -> DataFrame:
    """Whether each order can be shipped, and whether that is free.

    ``settings`` has one row per store, ``countries`` the countries a store ships
    to. National stores ship at home only. Shipping is free above the threshold;
    under the national rule only at home.
    """
    allowed = countries.select("MERCHANT_ID", F.col("COUNTRY").alias("DELIVERY_COUNTRY"), F.lit(True).alias("listed")).distinct()
    rows = orders.select("ORDER_ID", "MERCHANT_ID", "DELIVERY_COUNTRY").join(settings, "MERCHANT_ID")
    rows = rows.join(allowed, ["MERCHANT_ID", "DELIVERY_COUNTRY"], "left")
    rows = rows.join(amounts.groupBy("ORDER_ID").agg(F.sum("AMOUNT").alias("amount")), "ORDER_ID", "left")
    at_home = F.col("DELIVERY_COUNTRY") == F.col("STORE_COUNTRY")
    national = F.col("SHIPPING_TYPE") == "NATIONAL"
    ok = F.coalesce(F.when(national, at_home).otherwise(F.col("listed")), F.lit(False))
    above = F.col("FREE_ENABLED") & (F.coalesce("amount", F.lit(0)) > F.col("FREE_ABOVE"))
    free = F.coalesce(ok & above & (at_home | (F.col("FREE_TYPE") != "NATIONAL")), F.lit(False))
    return rows.select(
        "ORDER_ID", ok.alias("CAN_SHIP"), F.when(~ok, F.concat_ws(" ", F.lit(NO_SHIPPING), "DELIVERY_COUNTRY")).alias("RETURN_CODE"), free.alias("FREE_SHIPPING")
    )


def choose_option(options: DataFrame, rule: str) -> DataFrame:
    """The option taken per order: LEAST, HIGHEST, or ALL (all kept, the least selected).

    Prices are compared in whole units; the first of equals is taken.
    """
    whole = F.col("PRICE").cast("bigint")
    if rule == "HIGHEST":
        chosen = F.max_by("OPTION_CODE", F.struct(whole.alias("w"), (-F.col("POSITION")).alias("p")))
    else:
        chosen = F.min_by("OPTION_CODE", F.struct(whole.alias("w"), F.col("POSITION").alias("p")))
    selected = options.groupBy("ORDER_ID").agg(chosen.alias("CHOSEN"))
    joined = options.join(selected, "ORDER_ID").withColumn("SELECTED", F.col("OPTION_CODE") == F.col("CHOSEN")).drop("CHOSEN")
    return joined if rule == "ALL" else joined.where("SELECTED")
