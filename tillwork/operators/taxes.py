"""Taxes of an order."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.values import blank_to_null

AMOUNT = "decimal(28,2)"


@dataclass(frozen=True)
class TaxSettings:
    """A store's tax rules. ``basis`` is SHIPPING, BILLING or STORE."""

    basis: str = "SHIPPING"
    collect_outside_province: bool = True
    collect_at_store_address: bool = False
    default_class: int = 1
    store_country: str | None = None
    store_zone: str | None = None
    store_zone_name: str | None = None
    store_state: str | None = None


#: The columns of a table of rules: one row per ``MERCHANT_ID``, the fields of :class:`TaxSettings` in capitals.
RULES = tuple(f.name.upper() for f in fields(TaxSettings))


def _fixed(s: TaxSettings) -> dict[str, Column]:
    return {f.name: F.lit(getattr(s, f.name)) for f in fields(s)}


def _address(orders: DataFrame, rule: dict[str, Column], *carried: str) -> DataFrame:
    """Country, zone and state that decide an order's tax; ``rule`` has a column for each setting."""
    own = {part: rule[f"store_{part.lower()}"].cast("string") for part in ("COUNTRY", "ZONE", "STATE")}
    picked = {
        part: F.when(rule["basis"] == "STORE", own[part])
        .when(rule["basis"] == "SHIPPING", F.col(f"DELIVERY_{part}"))
        .otherwise(F.col(f"BILLING_{part}") if f"BILLING_{part}" in orders.columns else F.lit(None))
        for part in ("COUNTRY", "ZONE", "STATE")
    }
    zone, state = picked["ZONE"], blank_to_null(picked["STATE"])
    in_zone = (zone.isNull() | (zone == rule["store_zone"])) & (state.isNull() | (state == rule["store_zone_name"]))
    in_state = state.isNull() | (state == rule["store_state"])
    inside = F.when(rule["store_zone"].isNotNull(), in_zone).when(blank_to_null(own["STATE"]).isNotNull(), in_state).otherwise(True)
    owed = orders.where(rule["collect_outside_province"] | F.coalesce(inside, F.lit(False)))
    at_store = rule["collect_at_store_address"]
    found = {"COUNTRY": picked["COUNTRY"], "ZONE": zone, "STATE": state}
    places = [F.when(at_store, own[part]).otherwise(column).alias(part) for part, column in found.items()]
    return owed.select("ORDER_ID", *places, *carried).where("ZONE IS NOT NULL OR STATE IS NOT NULL")


def tax_address(orders: DataFrame, s: TaxSettings) -> DataFrame:
    """Country, zone and state that decide the tax; orders that owe none are left out."""
    return _address(orders, _fixed(s))


def _amounts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Amount per order and tax class; a null class is the default one, which shipping and handling go to."""
    charged = F.coalesce(F.col("SHIPPING") > 0, F.lit(False))
    handling = F.when(F.col("HANDLING") > 0, F.col("HANDLING")).otherwise(F.lit(0))
    shipping = F.when(charged, F.col("SHIPPING") + handling).otherwise(F.lit(0))
    none = F.lit(None).cast("bigint")
    of_orders = orders.select("ORDER_ID", none.alias("TAX_CLASS_ID"), shipping.cast(AMOUNT).alias("amount"))
    of_lines = lines.select(
        "ORDER_ID", F.col("TAX_CLASS_ID").cast("bigint").alias("TAX_CLASS_ID"),
        F.coalesce(F.col("ITEM_PRICE") * F.col("QUANTITY"), F.lit(0)).cast(AMOUNT).alias("amount"),
    )
    return of_lines.unionByName(of_orders)


def _per_class(amounts: DataFrame) -> DataFrame:
    return amounts.groupBy("ORDER_ID", "TAX_CLASS_ID").agg(F.sum("amount").cast(AMOUNT).alias("amount"))


def taxable_amounts(orders: DataFrame, lines: DataFrame, s: TaxSettings) -> DataFrame:
    """Amount per order and tax class; shipping and handling go to the default class.

    A line without a price counts as 0.
    """
    default = F.lit(s.default_class).cast("bigint")
    return _per_class(_amounts(orders, lines).withColumn("TAX_CLASS_ID", F.coalesce("TAX_CLASS_ID", default)))


def _rates_by(rates: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rates of a place as one array. A place has a handful of them."""
    rate = F.struct("PRIORITY", "TAX_RATE_ID", "RATE", F.coalesce("PIGGYBACK", F.lit(False)).alias("PIGGYBACK"), "TAX_CODE")
    return rates.groupBy(*keys).agg(F.collect_list(rate).alias(name))


def _charge(rates: Column, amount: Column) -> Column:
    """Taxes on ``amount``, one after the other.

    A compound rate is charged on the amount with the taxes so far; later plain
    rates then start from that sum as well.
    """
    zero = F.lit(0).cast(AMOUNT)
    nothing = F.array().cast("array<struct<TAX_CODE:string,VALUE:decimal(28,2)>>")
    start = F.struct(amount.cast(AMOUNT).alias("base"), zero.alias("total"), nothing.alias("items"))

    def step(state: Column, rate: Column) -> Column:
        compound = rate["PIGGYBACK"] & (state["total"] > 0)
        base = F.when(compound, state["total"]).otherwise(state["base"]).cast(AMOUNT)
        hundredth = F.lit("0.01").cast("decimal(3,2)")
        value = F.round(base.cast("decimal(20,2)") * rate["RATE"].cast("decimal(7,4)") * hundredth, 2).cast(AMOUNT)
        item = F.struct(rate["TAX_CODE"].alias("TAX_CODE"), value.alias("VALUE"))
        return F.struct(
            base.alias("base"), (base + value).cast(AMOUNT).alias("total"), F.concat(state["items"], F.array(item)).alias("items")
        )

    return F.aggregate(rates, start, step, lambda state: state["items"])


def taxes(orders: DataFrame, lines: DataFrame, rates: DataFrame, s: TaxSettings = TaxSettings(), first_per_code: bool = False) -> DataFrame:
    """Tax per order and tax code, by code.

    An order with a state but no zone is taxed by the rates of its state, any
    other by those of its zone and those without a zone. Amounts of the same code
    add up; ``first_per_code`` keeps only the first one.
    """
    return _charged(tax_address(orders, s), taxable_amounts(orders, lines, s), rates, [], first_per_code)


def store_taxes(orders: DataFrame, lines: DataFrame, rates: DataFrame, rules: DataFrame, first_per_code: bool = False) -> DataFrame:
    """The taxes of orders of many stores, each by the rules and rates of its own.

    ``rules`` has a row per ``MERCHANT_ID`` with the columns ``RULES``, and ``rates`` a ``MERCHANT_ID``; both are as small
    as there are stores and places. An order of a store without rules owes none. Everything else is as in :func:`taxes`.
    """
    placed = orders.join(rules.select("MERCHANT_ID", *RULES), "MERCHANT_ID")
    rule = {name.lower(): F.col(name) for name in RULES}
    amounts = _per_class(_amounts(orders, lines)).join(
        placed.select("ORDER_ID", F.col("DEFAULT_CLASS").cast("bigint").alias("DEFAULT_CLASS")), "ORDER_ID"
    )
    # Lines of the default class and those without any, brought together where they already are.
    by_class = _per_class(amounts.withColumn("TAX_CLASS_ID", F.coalesce("TAX_CLASS_ID", "DEFAULT_CLASS")))
    return _charged(_address(placed, rule, "MERCHANT_ID"), by_class, rates, ["MERCHANT_ID"], first_per_code)


def _charged(places: DataFrame, amounts: DataFrame, rates: DataFrame, store: list[str], first_per_code: bool) -> DataFrame:
    rates = rates.select(*store, "TAX_RATE_ID", "PRIORITY", "RATE", "PIGGYBACK", "TAX_CODE", "COUNTRY", "ZONE", "STATE")
    of_zone = _rates_by(rates.where("ZONE IS NOT NULL"), [*store, "COUNTRY", "ZONE"], "of_zone")
    of_country = _rates_by(rates.where("ZONE IS NULL"), [*store, "COUNTRY"], "of_country")
    of_state = _rates_by(rates.where("STATE IS NOT NULL"), [*store, "COUNTRY", "STATE"], "of_state")
    placed = (
        places.join(of_zone, [*store, "COUNTRY", "ZONE"], "left")
        .join(of_country, [*store, "COUNTRY"], "left")
        .join(of_state, [*store, "COUNTRY", "STATE"], "left")
    )
    none = F.array().cast(of_zone.schema["of_zone"].dataType)
    by_zone = F.concat(F.coalesce("of_zone", none), F.coalesce("of_country", none))
    chosen = F.when(F.col("ZONE").isNull(), F.coalesce("of_state", none)).otherwise(by_zone)
    placed = placed.select("ORDER_ID", F.array_sort(chosen).alias("rates")).where(F.size("rates") > 0)
    charged = placed.join(amounts, "ORDER_ID").select(
        "ORDER_ID", "TAX_CLASS_ID", F.posexplode(_charge(F.col("rates"), F.col("amount"))).alias("place", "item")
    )
    value = F.min_by("item.VALUE", F.struct("TAX_CLASS_ID", "place")) if first_per_code else F.sum("item.VALUE")
    return charged.groupBy("ORDER_ID", F.col("item.TAX_CODE").alias("TAX_CODE")).agg(value.cast(AMOUNT).alias("VALUE"))
