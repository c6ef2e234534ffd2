"""The catalog, order and customer operators as named queries over the shop tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions import values
from tillwork.operators import carts, categories, listings, orders, parcels, prices, search, shipping, taxes, totals
from tillwork.operators.listings import ProductCriteria
from tillwork.operators.orders import CustomerCriteria, OrderCriteria
from tillwork.operators.parcels import Box
from tillwork.operators.skew import own_shuffle
from tillwork.operators.taxes import TaxSettings
from tillwork.sources.starschema import AS_OF, Shop

QUERIES = {}


def query(id: str):
    """Register a query; amounts leave as doubles."""

    def register(build):
        if id in QUERIES:
            raise ValueError(f"{id} is registered twice")
        QUERIES[id] = lambda shop: _amounts_as_double(build(shop))
        return build

    return register


def _amounts_as_double(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields]
    )


# ------------------------------------------------------------------ shared inputs


def _priced(shop: Shop) -> DataFrame:
    return prices.effective_prices(shop["inventory"], shop["price_list"], shop["product_variant"], AS_OF)


def _priced_with_attributes(shop: Shop) -> DataFrame:
    return prices.prices_with_default_attributes(_priced(shop), shop["product_attribute"])


def _order_lines(shop: Shop) -> DataFrame:
    """Lines of orders with today's price, null if there is none, and the product's tax class."""
    price = _priced(shop).select("PRODUCT_ID", F.col("FINAL_PRICE").alias("ITEM_PRICE"))
    lines = shop["cart_line"].select(F.col("CART_ID").alias("ORDER_ID"), "PRODUCT_ID", "QUANTITY")
    return lines.join(own_shuffle(price), "PRODUCT_ID", "left").join(
        shop["product"].select("PRODUCT_ID", "TAX_CLASS_ID"), "PRODUCT_ID", "left"
    )


def _shipped_lines(shop: Shop) -> DataFrame:
    lines = carts.shippable_lines(shop["cart_line"], shop["product"])
    return lines.select(F.col("CART_ID").alias("ORDER_ID"), "PRODUCT_ID", "QUANTITY")


def _measured(shop: Shop) -> DataFrame:
    return parcels.measured_lines(_shipped_lines(shop), shop["product"], shop["product_attribute"])


def _parcels(shop: Shop) -> DataFrame:
    return parcels.parcels_per_item(_measured(shop))


def _stock(shop: Shop) -> tuple[DataFrame, DataFrame]:
    of_products = prices.product_stock(shop["product"], shop["inventory"], _priced_with_attributes(shop))
    own = prices.variant_prices(shop["inventory"], shop["price_list"], AS_OF)
    return of_products, prices.variant_stock(shop["product_variant"], shop["inventory"], own, of_products)


def _carts(shop: Shop) -> DataFrame:
    return shop["shopping_cart"].select(
        F.col("SHP_CART_ID").alias("CART_ID"), "CUSTOMER_ID", "PROMO_CODE", F.col("DATE_MODIFIED").alias("PROMO_ADDED")
    )


def _discounts(shop: Shop) -> DataFrame:
    return carts.promo_discounts(_carts(shop), shop["cart_line"], _priced_with_attributes(shop), carts.promotions(shop.spark), AS_OF)


_TAX = TaxSettings(collect_outside_province=True, default_class=1)


def _taxes(shop: Shop, **options) -> DataFrame:
    return taxes.taxes(shop["shop_order"], _order_lines(shop), shop["tax_rate"], _TAX, **options)


# ----------------------------------------------------------------------- products


@query("C01")
def c01(shop):
    wanted = ProductCriteria(
        store=1, language="en", category_ids=list(range(101, 111)), available=True, as_of=AS_OF, page=1, size=10
    )
    return listings.product_listing(shop, wanted)


@query("C01_by_options")
def c01_by_options(shop):
    wanted = ProductCriteria(store=1, language="fr", option_values={"type": "e", "size": "medium"}, value_codes=["m", "l"], size=25)
    return listings.product_listing(shop, wanted)


@query("C01_by_text")
def c01_by_text(shop):
    wanted = ProductCriteria(store=1, language="_all", name="RING", sku="1", available=False, as_of=AS_OF, size=50)
    return listings.product_listing(shop, wanted)


@query("C01_by_manufacturer")
def c01_by_manufacturer(shop):
    return listings.matching_products(shop, ProductCriteria(store=1, manufacturer_id=17)).select("PRODUCT_ID", "SKU")


@query("C02")
def c02(shop):
    return listings.category_listing_products(shop, 2, 1)


@query("C03")
def c03(shop):
    return listings.products_by_region(shop, [101, 102, 103, 104, 105], "CA", 1, AS_OF)


@query("C03_by_id")
def c03_by_id(shop):
    return listings.product_in_region(shop, [1, 2, 3, 37, 74, 111], None, AS_OF)


@query("C03_tax_class")
def c03_tax_class(shop):
    return listings.products_by_tax_class(shop, 2)


def _skus(shop: Shop) -> DataFrame:
    return shop["cart_line"].select("SKU").unionByName(shop["product_variant"].select("SKU"))


@query("C04")
def c04(shop):
    return listings.sku_lookup(_skus(shop), shop["product"], shop["product_variant"])


@query("C04_availability")
def c04_availability(shop):
    return listings.availability_by_sku(_skus(shop), shop["product"], shop["product_variant"], shop["inventory"])


@query("C05")
def c05(shop):
    return _priced(shop).drop("PRODUCT_PRICE_TYPE", "DEFAULT_PRICE")


@query("C05_additional")
def c05_additional(shop):
    return prices.additional_prices(shop["inventory"], shop["price_list"], shop["product_variant"], AS_OF)


@query("C05_variant")
def c05_variant(shop):
    rows = prices.variant_prices(shop["inventory"], shop["price_list"], AS_OF)
    return rows.select("VARIANT_ID", "PRODUCT_PRICE_ID", "FINAL_PRICE")


@query("C05_availability")
def c05_availability(shop):
    return prices.availability_prices(shop["price_list"], AS_OF).select("PRODUCT_AVAIL_ID", "PRODUCT_PRICE_ID", "FINAL_PRICE")


@query("C06")
def c06(shop):
    rows = prices.final_prices(shop["price_list"], AS_OF)
    return rows.drop("DEFAULT_PRICE", "PRODUCT_PRICE_TYPE", "PRODUCT_PRICE_CODE")


@query("C06_has_discount")
def c06_has_discount(shop):
    return shop["price_list"].select("PRODUCT_PRICE_ID", prices.has_discount(AS_OF).alias("HAS_DISCOUNT"))


@query("C07")
def c07(shop):
    return _priced_with_attributes(shop).select("PRODUCT_ID", "FINAL_PRICE", "ORIGINAL_PRICE", "DISCOUNTED_PRICE")


@query("C08")
def c08(shop):
    return _stock(shop)[0].select("PRODUCT_ID", "SKU", "QUANTITY", "FINAL_PRICE")


@query("C08_variant")
def c08_variant(shop):
    return _stock(shop)[1].select("VARIANT_ID", "SKU", "QUANTITY", "FINAL_PRICE")


@query("C09")
def c09(shop):
    return prices.decrement_stock(shop["inventory"], shop["product"], shop["cart_line"])


# -------------------------------------------------------------------------- carts


def _priced_lines(shop: Shop) -> DataFrame:
    owners = listings.sku_owners(shop["product"], shop["product_variant"])
    return carts.priced_cart_lines(
        shop["cart_line"], shop["cart_line_attribute"], owners, _priced(shop), shop["product_attribute"]
    )


@query("C10")
def c10(shop):
    return _priced_lines(shop)


@query("C10_carts")
def c10_carts(shop):
    return carts.priced_carts(_carts(shop), _priced_lines(shop))


@query("C11")
def c11(shop):
    keys = carts.line_attribute_key(shop["cart_line_attribute"])
    lines = shop["cart_line"].select("CART_ID", "PRODUCT_ID", "QUANTITY").join(keys, ["CART_ID", "PRODUCT_ID"], "left")
    lines = lines.withColumn("ATTRIBUTES", F.coalesce("ATTRIBUTES", F.lit("")))
    owners = _carts(shop).select("CART_ID", "CUSTOMER_ID")
    session = owners.where("CART_ID % 2 = 1").select(
        F.col("CART_ID").alias("SESSION_CART"),
        F.when(F.col("CART_ID") % 4 == 1, F.col("CUSTOMER_ID")).alias("SESSION_CUSTOMER"),
        (F.col("CART_ID") - 1).alias("USER_CART"),
    )
    # Every eighth pair belongs to one customer.
    user = owners.select(F.col("CART_ID").alias("USER_CART"), F.col("CUSTOMER_ID").alias("own"))
    pairs = session.join(user, "USER_CART").withColumn(
        "USER_CUSTOMER", F.when(F.col("USER_CART") % 16 == 0, F.col("SESSION_CUSTOMER")).otherwise(F.col("own"))
    )
    return carts.merge_carts(lines, pairs.drop("own"))


@query("C12")
def c12(shop):
    return carts.shippable_lines(shop["cart_line"], shop["product"])


@query("C12_carts")
def c12_carts(shop):
    return carts.requires_shipping(shop["cart_line"], shop["product"])


def _order_extras(shop: Shop) -> DataFrame:
    extra = prices.additional_prices(shop["inventory"], shop["price_list"], shop["product_variant"], AS_OF)
    lines = shop["cart_line"].select(F.col("CART_ID").alias("ORDER_ID"), "PRODUCT_ID")
    return lines.join(extra, "PRODUCT_ID").select(
        "ORDER_ID", "PRODUCT_ID", F.col("PRODUCT_PRICE_CODE").alias("CODE"), F.col("FINAL_PRICE").alias("VALUE")
    )


def _order_discounts(shop: Shop) -> DataFrame:
    return _discounts(shop).select(F.col("CART_ID").alias("ORDER_ID"), "PRODUCT_ID", "VALUE")


@query("C13")
def c13(shop):
    return totals.order_totals(
        shop["shop_order"], _order_lines(shop), _order_extras(shop), _order_discounts(shop), _taxes(shop)
    )


@query("C13_cart")
def c13_cart(shop):
    """Cart form: the same calculation, with available products only and nothing shipped yet."""
    unshipped = shop["shop_order"].withColumn("SHIPPING", F.lit(None).cast("decimal(18,2)"))
    lines = totals.available_lines(_order_lines(shop), shop["product"])
    return totals.order_totals(
        unshipped,
        lines,
        totals.available_lines(_order_extras(shop), shop["product"]),
        totals.available_lines(_order_discounts(shop), shop["product"]),
        taxes.taxes(unshipped, lines, shop["tax_rate"], _TAX),
    )


# --------------------------------------------------------------------- categories


@query("C14")
def c14(shop):
    return categories.rebuild_lineage(shop["category"])


@query("C14_move")
def c14_move(shop):
    return categories.move_category(shop["category"], 3, 101)


@query("C15")
def c15(shop):
    return categories.ancestors(shop["category"])


@query("C15_subtree")
def c15_subtree(shop):
    roots = shop["category"].where("PARENT_ID IS NULL")
    return categories.subtrees(shop["category"], roots).select("ROOT_ID", "CATEGORY_ID", "LINEAGE", "SORT_ORDER")


@query("C15_listing")
def c15_listing(shop):
    rows = categories.category_listing(shop["category"], store=1, min_depth=1, featured=True, visible=True, name="1")
    return rows.select("CATEGORY_ID", "NAME", "LINEAGE")


@query("C16")
def c16(shop):
    return categories.products_per_category(shop["product"], shop["product_category"], AS_OF)


@query("C16_subtree")
def c16_subtree(shop):
    return categories.products_per_subtree(shop["product"], shop["product_category"], shop["category"], AS_OF)


@query("C16_manufacturer")
def c16_manufacturer(shop):
    return categories.products_per_manufacturer(shop["product"])


@query("C16_totals")
def c16_totals(shop):
    return categories.store_totals(shop["category"], shop["manufacturer"])


@query("C17")
def c17(shop):
    return categories.category_facets(shop["product_category"], shop["category"], shop["product_attribute"])


@query("C18")
def c18(shop):
    return categories.brands_in_category(shop["product_category"], shop["category"], shop["product"], shop["manufacturer"])


@query("C19")
def c19(shop):
    return categories.category_removal_impact(shop["product_category"], shop["category"])


# ----------------------------------------------------------------------- shipping


@query("C20")
def c20(shop):
    return shipping.weight_quotes(shop["shop_order"], _measured(shop), shop["shipping_region"], shop["shipping_weight_tier"])


_PICKUP = 1.5


@query("C21")
def c21(shop):
    return shipping.rule_quotes(shop["shop_order"], _PICKUP)


def _carrier_orders(shop: Shop) -> DataFrame:
    """Orders with the two countries and the province the carrier rules speak of."""
    home = F.col("DELIVERY_COUNTRY").isin("N0", "N1", "N2", "N3", "N4")
    return shop["shop_order"].withColumns(
        {
            "DELIVERY_COUNTRY": F.when(home, "CA").otherwise(F.col("DELIVERY_COUNTRY")),
            "DELIVERY_ZONE": F.when(F.col("DELIVERY_ZONE") == "Z0", "QC").otherwise(F.col("DELIVERY_ZONE")),
        }
    )


@query("C22")
def c22(shop):
    return shipping.carrier_choice(_carrier_orders(shop), _measured(shop))


@query("C23")
def c23(shop):
    settings = shop.spark.createDataFrame(
        [(1, "INTERNATIONAL", "N1", True, Decimal("3000.00"), "NATIONAL"), (2, "NATIONAL", "N2", True, Decimal("1000.00"), "INTERNATIONAL")],
        "MERCHANT_ID INT, SHIPPING_TYPE STRING, STORE_COUNTRY STRING, FREE_ENABLED BOOLEAN, FREE_ABOVE DECIMAL(18,2), FREE_TYPE STRING",
    )
    allowed = shop["nation"].where("n_nationkey % 3 <> 0").select(
        F.lit(1).alias("MERCHANT_ID"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("COUNTRY")
    )
    amounts = _order_lines(shop).select("ORDER_ID", (F.col("ITEM_PRICE") * F.col("QUANTITY")).alias("AMOUNT"))
    return shipping.shipping_eligibility(shop["shop_order"], amounts, settings, allowed)


def _options(shop: Shop) -> DataFrame:
    rules = shipping.rule_quotes(shop["shop_order"], _PICKUP)
    weighed = shipping.weight_quotes(shop["shop_order"], _measured(shop), shop["shipping_region"], shop["shipping_weight_tier"])

    def option(rows, code, position, price):
        return rows.where(F.col(price).isNotNull()).select(
            "ORDER_ID", F.lit(code).alias("OPTION_CODE"), F.lit(position).alias("POSITION"), F.col(price).cast("decimal(18,4)").alias("PRICE")
        )

    return (
        option(weighed, shipping.WEIGHT_OPTION, 0, "PRICE")
        .unionByName(option(rules, shipping.DISTANCE_OPTION, 1, "KM_PRICE"))
        .unionByName(option(rules, shipping.PICKUP_OPTION, 2, "PICKUP_PRICE"))
    )


@query("C23_least")
def c23_least(shop):
    return shipping.choose_option(_options(shop), "LEAST").drop("SELECTED")


@query("C23_highest")
def c23_highest(shop):
    return shipping.choose_option(_options(shop), "HIGHEST").drop("SELECTED")


@query("C23_all")
def c23_all(shop):
    return shipping.choose_option(_options(shop), "ALL")


@query("C24")
def c24(shop):
    return _parcels(shop)


_BOX = Box(length=10, width=6, height=6, weight=0.5, max_weight=60)


@query("C25")
def c25(shop):
    return parcels.parcels_in_boxes(_measured(shop), _BOX)


@query("C25_errors")
def c25_errors(shop):
    return parcels.packing_errors(_measured(shop), Box(length=8, width=5, height=4, weight=0.5, max_weight=45))


# ---------------------------------------------------------------- money and people


@query("C26")
def c26(shop):
    return orders.payment_state(shop["sm_transaction"])


@query("C26_in_range")
def c26_in_range(shop):
    rows = orders.payment_state(shop["sm_transaction"], "1997-01-01 00:00:00", "1998-01-01 00:00:00")
    return rows.where("CAPTURABLE").select("ORDER_ID")


@query("C26_details")
def c26_details(shop):
    return orders.transaction_detail(shop["sm_transaction"], "TRANSACTIONID")


@query("C27")
def c27(shop):
    return _taxes(shop)


@query("C27_first_per_code")
def c27_first_per_code(shop):
    return _taxes(shop, first_per_code=True)


@query("C27_province")
def c27_province(shop):
    settings = TaxSettings(collect_outside_province=False, store_country="N4", store_zone="Z2", store_zone_name="P1")
    return taxes.tax_address(shop["shop_order"], settings)


@query("C27_stores")
def c27_stores(shop):
    """Two stores: one taxes by delivery, the other by its own address, with higher rates and another default class."""
    rules = shop.spark.sql("""
        SELECT * FROM VALUES
          (1, 'SHIPPING', true, false, 1, 'N1', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)),
          (2, 'STORE', true, false, 2, 'N4', 'Z2', 'P1', CAST(NULL AS STRING))
        AS rules(MERCHANT_ID, BASIS, COLLECT_OUTSIDE_PROVINCE, COLLECT_AT_STORE_ADDRESS, DEFAULT_CLASS,
                 STORE_COUNTRY, STORE_ZONE, STORE_ZONE_NAME, STORE_STATE)""")
    rates = shop["tax_rate"]
    of_other = rates.where("TAX_RATE_ID % 3 <> 0").withColumn("RATE", (F.col("RATE") + 1).cast("decimal(7,4)"))
    by_store = rates.withColumn("MERCHANT_ID", F.lit(1)).unionByName(of_other.withColumn("MERCHANT_ID", F.lit(2)))
    return taxes.store_taxes(shop["shop_order"], _order_lines(shop), by_store, rules)


@query("C28")
def c28(shop):
    return _discounts(shop)


@query("C29")
def c29(shop):
    return orders.review_summary(shop["product_review"])


@query("C29_by_customer")
def c29_by_customer(shop):
    return orders.review_summary(shop["product_review"], "CUSTOMER_ID", "PRODUCT_ID")


@query("C30")
def c30(shop):
    return listings.related_products(shop, 1, "RELATED_ITEM", "en", available=True)


@query("C30_groups")
def c30_groups(shop):
    return listings.relationship_groups(shop["product_relationship"], 1)


@query("C30_of_product")
def c30_of_product(shop):
    return listings.relationships_of(shop["product_relationship"], shop["product"])


@query("C31")
def c31(shop):
    return orders.order_search(
        shop["shop_order"], OrderCriteria(store=1, customer_name="MACH", status="delivered", payment="strip", phone="5", page=1, size=15)
    )


@query("C31_by_id")
def c31_by_id(shop):
    return orders.order_search(shop["shop_order"], OrderCriteria(store=1, id_part="77", email="@example", ascending=True))


@query("C31_by_customer")
def c31_by_customer(shop):
    return orders.matching_orders(shop["shop_order"], OrderCriteria(store=1, customer_id=7)).select("ORDER_ID", "ORDER_STATUS")


@query("C32")
def c32(shop):
    return orders.customer_search(
        shop["shop_customer"], CustomerCriteria(store=1, name="000", first_name="E", last_name="1", email="@", country="N1", size=30)
    )


@query("C33")
def c33(shop):
    return orders.order_history(shop["order_status_history"])


@query("C33_current")
def c33_current(shop):
    return orders.current_status(shop["shop_order"], shop["order_status_history"])


@query("C34")
def c34(shop):
    return listings.stock_listing(shop, 1, page=2, size=25)


@query("C34_by_sku")
def c34_by_sku(shop):
    return listings.stock_listing(shop, 1, sku="sku24-v1")


# ------------------------------------------------------------------------- search


def _documents(shop: Shop) -> DataFrame:
    of_products, of_variants = _stock(shop)
    return search.search_documents(shop, of_products, of_variants, orders.review_summary(shop["product_review"]), "DEFAULT")


def _entries(map_column: str):
    """A map as text, by key, so that any engine can compare it."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(map_column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )


@query("C35")
def c35(shop):
    def lines(column):
        return F.array_join(
            F.transform(
                column,
                lambda m: F.array_join(
                    F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";"
                ),
            ),
            "|",
        )

    return _documents(shop).withColumns(
        {"attributes": _entries("attributes"), "inventory": lines(F.col("inventory")), "variants": lines(F.col("variants"))}
    )


def _plain_documents(shop: Shop) -> DataFrame:
    """What search needs of the documents."""
    return shop["product_description"].select(
        F.col("PRODUCT_ID").alias("id"), F.lit("default").alias("store"), F.col("LANGUAGE").alias("language"), F.col("NAME").alias("name")
    )


def _requests(shop: Shop) -> DataFrame:
    """Every customer's market segment and every product name as a search."""
    names = shop["part"].select(F.col("p_name").alias("text")).unionByName(shop["customer"].select(F.col("c_mktsegment").alias("text"))).distinct()
    return names.select(F.col("text").alias("request_id"), F.lit("default").alias("store"), F.lit("en").alias("language"), "text")


@query("C36_terms")
def c36_terms(shop):
    return search.search_terms(_plain_documents(shop))


@query("C36")
def c36(shop):
    return search.keyword_search(search.search_terms(_plain_documents(shop)), _requests(shop))


@query("C36_page")
def c36_page(shop):
    """Every request asks for some hits from some place on, by the length of its text."""
    size = F.length("text")
    asked = _requests(shop).withColumn("count", 3 + size % 9).withColumn("start", size % 3 * 4)
    return search.search_page(search.search_terms(_plain_documents(shop)), asked)


@query("C36_suggest_some")
def c36_suggest_some(shop):
    documents = _plain_documents(shop)
    return search.suggest(documents, search.search_terms(documents), _requests(shop), search.MOST_SUGGESTIONS)


@query("C36_suggest")
def c36_suggest(shop):
    documents = _plain_documents(shop)
    return search.suggest(documents, search.search_terms(documents), _requests(shop))


@query("C37")
def c37(shop):
    hits = search.keyword_search(search.search_terms(_plain_documents(shop)), _requests(shop))
    return search.category_search_facets(hits, shop["product_category"])


# --------------------------------------------------------------- scalar functions


@query("F01_postal_code")
def f01(shop):
    return shop["shop_order"].select("ORDER_ID", values.postal_code("POSTAL_CODE").alias("POSTAL_CODE"))


@query("F02_units")
def f02(shop):
    return shop["product"].select(
        "PRODUCT_ID",
        values.weight_in("WEIGHT", "KG", "LB").alias("POUNDS"),
        values.weight_in("WEIGHT", "LB", "KG").alias("KILOGRAMS"),
        values.weight_in("WEIGHT", "KG", "KG").alias("SAME"),
        values.length_in("LENGTH", "CM", "IN").alias("INCHES_ASKED"),
        values.length_in("LENGTH", "IN", "CM").alias("CENTIMETRES_ASKED"),
    )


@query("F03_money_text")
def f03(shop):
    return shop["price_list"].select("PRODUCT_PRICE_ID", values.money_text("PRODUCT_PRICE_AMOUNT").alias("AMOUNT_TEXT"))
