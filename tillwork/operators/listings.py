"""Finding products: listings, SKUs, regions, related products, stock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.operators.categories import ancestors, on_sale
from tillwork.operators.paging import page_of
from tillwork.operators.prices import ALL_REGIONS

ALL_LANGUAGES = "_all"


@dataclass(frozen=True)
class ProductCriteria:
    """What a product listing may ask for; a field left out does not filter."""

    store: int
    language: str | None = None
    product_ids: Sequence[int] | None = None
    category_ids: Sequence[int] | None = None
    manufacturer_id: int | None = None
    available: bool | None = None
    as_of: dt.datetime | str | None = None
    name: str | None = None
    sku: str | None = None
    # option code -> part of the value's name; every option has to match
    option_values: Mapping[str, str] | None = None
    value_codes: Sequence[str] | None = None
    page: int = 0
    size: int = 20


def matching_products(tables: Mapping[str, DataFrame], criteria: ProductCriteria) -> DataFrame:
    """Products that meet the criteria, each once.

    Conditions on the product itself are plain filters that reach the scan; each
    one on another table is a semi join, so nothing is multiplied.
    """
    c = criteria
    rows = tables["product"].where(F.col("MERCHANT_ID") == c.store)
    if c.product_ids:
        rows = rows.where(F.col("PRODUCT_ID").isin(list(c.product_ids)))
    if c.manufacturer_id is not None:
        rows = rows.where(F.col("MANUFACTURER_ID") == c.manufacturer_id)
    if c.sku:
        rows = rows.where(F.lower("SKU").contains(c.sku.lower()))
    if c.available is not None:
        live = on_sale(c.as_of)
        rows = rows.where(live if c.available else ~live)
    described = tables["product_description"]
    if c.language and c.language != ALL_LANGUAGES:
        described = described.where(F.col("LANGUAGE") == c.language)
    if c.name:
        described = described.where(F.lower("NAME").contains(c.name.lower()))
    rows = rows.join(described, "PRODUCT_ID", "left_semi")
    if c.category_ids:
        inside = tables["product_category"].where(F.col("CATEGORY_ID").isin(list(c.category_ids)))
        rows = rows.join(inside, "PRODUCT_ID", "left_semi")
    for option, value in (c.option_values or {}).items():
        having = tables["product_attribute"].where((F.col("OPTION_CODE") == option) & F.col("VALUE_NAME").contains(value))
        rows = rows.join(having, "PRODUCT_ID", "left_semi")
    if c.value_codes:
        having = tables["product_attribute"].where(F.col("VALUE_CODE").isin(list(c.value_codes)))
        rows = rows.join(having, "PRODUCT_ID", "left_semi")
    return rows


def product_listing(tables: Mapping[str, DataFrame], criteria: ProductCriteria) -> DataFrame:
    """One page of the matching products by sort order, with the totals.

    The page is cut from ids first; names are joined to the page only.
    """
    rows = matching_products(tables, criteria).select("PRODUCT_ID", "SKU", "MANUFACTURER_ID", "SORT_ORDER")
    page = page_of(rows, ["SORT_ORDER", "PRODUCT_ID"], criteria.page, criteria.size)
    language = criteria.language
    if not language or language == ALL_LANGUAGES:
        return page
    names = tables["product_description"].where(F.col("LANGUAGE") == language).select("PRODUCT_ID", "NAME")
    return page.join(names, "PRODUCT_ID", "left")


def category_listing_products(tables: Mapping[str, DataFrame], category_id: int, store: int) -> DataFrame:
    """Products of a category and of everything below it."""
    below = ancestors(tables["category"]).where(F.col("ANCESTOR_ID") == category_id)
    inside = tables["product_category"].join(below, "CATEGORY_ID", "left_semi")
    rows = tables["product"].where(F.col("MERCHANT_ID") == store).join(inside, "PRODUCT_ID", "left_semi")
    return rows.select("PRODUCT_ID", "SKU", "SORT_ORDER").orderBy("SORT_ORDER", "PRODUCT_ID")


def products_by_region(tables: Mapping[str, DataFrame], category_ids: Sequence[int], country: str | None, store: int, as_of) -> DataFrame:
    """Live products of some categories that are sold in a country or everywhere."""
    regions = [ALL_REGIONS] + ([country] if country else [])
    sold = tables["inventory"].where(F.col("REGION").isin(regions))
    inside = tables["product_category"].where(F.col("CATEGORY_ID").isin(list(category_ids)))
    rows = tables["product"].where((F.col("MERCHANT_ID") == store) & on_sale(as_of))
    rows = rows.join(sold, "PRODUCT_ID", "left_semi").join(inside, "PRODUCT_ID", "left_semi")
    return rows.select("PRODUCT_ID", "SKU", "SORT_ORDER").orderBy("SORT_ORDER", "PRODUCT_ID")


def product_in_region(tables: Mapping[str, DataFrame], product_ids: Sequence[int], country: str | None, as_of) -> DataFrame:
    """The given products as far as they are live and sold in a country or everywhere."""
    regions = [ALL_REGIONS] + ([country] if country else [])
    sold = tables["inventory"].where(F.col("REGION").isin(regions))
    rows = tables["product"].where(F.col("PRODUCT_ID").isin(list(product_ids)) & on_sale(as_of))
    return rows.join(sold, "PRODUCT_ID", "left_semi").select("PRODUCT_ID", "SKU")


def products_by_tax_class(tables: Mapping[str, DataFrame], tax_class: int) -> DataFrame:
    return tables["product"].where(F.col("TAX_CLASS_ID") == tax_class).select("PRODUCT_ID", "SKU")


def sku_owners(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Every SKU with the product it leads to: its own, or that of the variant."""
    own = products.select("SKU", "PRODUCT_ID", F.lit(None).cast("bigint").alias("VARIANT_ID"))
    return own.unionByName(variants.select("SKU", "PRODUCT_ID", "VARIANT_ID"))


def sku_lookup(skus: DataFrame, products: DataFrame, variants: DataFrame) -> DataFrame:
    """Products for a table of SKUs, with a flag for those that exist.

    "Own SKU or variant's SKU" is a union of two equi joins, not an OR.
    """
    found = skus.select("SKU").distinct().join(sku_owners(products, variants), "SKU", "left")
    return found.withColumn("FOUND", F.col("PRODUCT_ID").isNotNull()).distinct()


def availability_by_sku(skus: DataFrame, products: DataFrame, variants: DataFrame, inventory: DataFrame) -> DataFrame:
    """Availabilities for a table of SKUs: a product's all, a variant's its own."""
    wanted = skus.select("SKU").distinct()
    of_product = products.join(wanted, "SKU").select("SKU", "PRODUCT_ID").join(inventory, "PRODUCT_ID")
    of_variant = variants.join(wanted, "SKU").select("SKU", F.col("VARIANT_ID").alias("PRODUCT_VARIANT")).join(inventory, "PRODUCT_VARIANT")
    columns = ["SKU", "PRODUCT_AVAIL_ID", "PRODUCT_ID", "REGION", "QUANTITY"]
    return of_product.select(*columns).unionByName(of_variant.select(*columns)).distinct()


def related_products(tables: Mapping[str, DataFrame], store: int, code: str, language: str, available: bool | None = None) -> DataFrame:
    """Related products of every product for a kind of relationship, with their names."""
    rows = tables["product_relationship"].where((F.col("STORE_ID") == store) & (F.col("CODE") == code))
    related = tables["product"].select(F.col("PRODUCT_ID").alias("RELATED_PRODUCT_ID"), "AVAILABLE")
    if available is not None:
        related = related.where(F.col("AVAILABLE") == available)
    names = tables["product_description"].where(F.col("LANGUAGE") == language)
    names = names.select(F.col("PRODUCT_ID").alias("RELATED_PRODUCT_ID"), F.col("NAME").alias("RELATED_NAME"))
    return rows.join(related, "RELATED_PRODUCT_ID").join(names, "RELATED_PRODUCT_ID").select(
        "RELATIONSHIP_ID", "PRODUCT_ID", "RELATED_PRODUCT_ID", "RELATED_NAME"
    )


def relationship_groups(relationships: DataFrame, store: int) -> DataFrame:
    """Group codes of a store: relationships that start at no product."""
    return relationships.where((F.col("STORE_ID") == store) & F.col("PRODUCT_ID").isNull()).groupBy("CODE").agg(
        F.count(F.lit(1)).alias("member_count")
    )


def relationships_of(relationships: DataFrame, products: DataFrame) -> DataFrame:
    """Relationships a product has part in, at either end."""
    wanted = products.select(F.col("PRODUCT_ID").alias("ANY_PRODUCT_ID"))
    starts = relationships.withColumn("ANY_PRODUCT_ID", F.col("PRODUCT_ID")).join(wanted, "ANY_PRODUCT_ID")
    ends = relationships.withColumn("ANY_PRODUCT_ID", F.col("RELATED_PRODUCT_ID")).join(wanted, "ANY_PRODUCT_ID")
    return starts.unionByName(ends).select("ANY_PRODUCT_ID", "RELATIONSHIP_ID", "CODE").distinct()


def stock_listing(tables: Mapping[str, DataFrame], store: int, product_id: int | None = None, sku: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    """A page of availabilities with the number and the span of their prices."""
    rows = tables["inventory"].where(F.col("MERCHANT_ID") == store)
    if product_id is not None:
        rows = rows.where(F.col("PRODUCT_ID") == product_id)
    if sku is not None:
        owners = sku_owners(tables["product"], tables["product_variant"]).where(F.col("SKU") == sku)
        of_product = rows.join(owners.where("VARIANT_ID IS NULL").select("PRODUCT_ID"), "PRODUCT_ID", "left_semi")
        of_variant = rows.join(owners.where("VARIANT_ID IS NOT NULL").select(F.col("VARIANT_ID").alias("PRODUCT_VARIANT")), "PRODUCT_VARIANT", "left_semi")
        rows = of_product.unionByName(of_variant.select(*of_product.columns)).distinct()
    paged = page_of(rows.select("PRODUCT_AVAIL_ID", "PRODUCT_ID", "PRODUCT_VARIANT", "REGION", "QUANTITY"), ["PRODUCT_AVAIL_ID"], page, size)
    prices = tables["price_list"].join(paged.select("PRODUCT_AVAIL_ID"), "PRODUCT_AVAIL_ID", "left_semi")
    spans = prices.groupBy("PRODUCT_AVAIL_ID").agg(
        F.count(F.lit(1)).alias("price_count"), F.min("PRODUCT_PRICE_AMOUNT").alias("lowest_price"), F.max("PRODUCT_PRICE_AMOUNT").alias("highest_price")
    )
    return paged.join(spans, "PRODUCT_AVAIL_ID", "left").withColumn("price_count", F.coalesce("price_count", F.lit(0)))
