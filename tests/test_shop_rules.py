"""Catalog, order and shipping rules on hand-made rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwork.functions import values
from tillwork.operators import carts, categories, listings, orders, parcels, prices, search, shipping, taxes, totals
from tillwork.operators.paging import page_of
from tillwork.operators.parcels import Box, measured_lines, packing_errors, parcels_in_boxes, parcels_per_item
from tillwork.operators.taxes import TaxSettings

NOW = dt.datetime(2024, 2, 15)
PRICE = "PRODUCT_PRICE_ID BIGINT, PRODUCT_AVAIL_ID BIGINT, PRODUCT_PRICE_CODE STRING, DEFAULT_PRICE BOOLEAN, PRODUCT_PRICE_TYPE STRING, PRODUCT_PRICE_AMOUNT DECIMAL(18,2), SPECIAL_AMOUNT DECIMAL(18,2), SPECIAL_START DATE, SPECIAL_END DATE"
INVENTORY = "PRODUCT_AVAIL_ID BIGINT, PRODUCT_ID BIGINT, PRODUCT_VARIANT BIGINT, REGION STRING, QUANTITY INT"
VARIANT = "VARIANT_ID BIGINT, PRODUCT_ID BIGINT, SKU STRING, DEFAULT_SELECTION BOOLEAN"


def day(month, number=1):
    return dt.date(2024, month, number)


def price(id, avail=1, default=True, amount="10.00", special=None, start=None, end=None, code="base"):
    return (id, avail, code, default, "ONE_TIME", D(amount), None if special is None else D(special), start, end)


# ---------------------------------------------------------------------- functions


def test_golden_values_of_the_unit_functions(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    assert value(values.postal_code(F.lit("364856-A56 - B888@"))) == "364856A56B888"
    assert value(values.weight_in(F.lit("100.789"), "LB", "LB")) == D("100.79")
    assert value(values.weight_in(F.lit("100.789"), "KG", "LB")) == D("221.74")
    assert value(values.weight_in(F.lit("100.789"), "LB", "KG")) == D("45.81")
    assert value(values.length_in(F.lit("100.789"), "CM", "IN")) == D("256.00")
    assert value(values.length_in(F.lit("100.789"), "IN", "CM")) == D("39.31")
    assert value(values.money_text(F.lit(D("1234567.5")))) == "1,234,567.50"
    assert value(values.round_half_up(F.lit(1.005))) == 1.01
    assert value(values.ratio(F.lit(1), F.lit(0))) is None


# ------------------------------------------------------------------------- prices


@pytest.mark.parametrize(
    "row, applies",
    [
        (price(1, special="8"), True),
        (price(1, special="0"), False),
        (price(1, special=None, start=day(2), end=day(3)), False),
        (price(1, special="8", start=day(2), end=day(3)), True),
        (price(1, special="8", end=day(3)), True),
        (price(1, special="8", end=day(2, 15)), False),
        (price(1, special="8", start=day(2)), False),
        (price(1, special="8", start=day(1), end=day(2)), False),
        (price(1, special="8", start=day(3), end=day(4)), False),
    ],
)
def test_when_a_special_price_holds(spark, row, applies):
    got = prices.final_prices(spark.createDataFrame([row], PRICE), NOW).first()
    assert got.DISCOUNTED is applies
    assert got.FINAL_PRICE == (row[6] if applies else D("10.00"))
    assert got.DISCOUNT_PERCENT == (int(100 - float(row[6]) * 10) if applies else None)


def effective(spark, inventory, rows, variants=()):
    args = (spark.createDataFrame(list(inventory), INVENTORY), spark.createDataFrame(list(rows), PRICE), spark.createDataFrame(list(variants), VARIANT))
    found = {r.PRODUCT_ID: r.PRODUCT_PRICE_ID for r in prices.effective_prices(*args, NOW).collect()}
    others = sorted((r.PRODUCT_ID, r.PRODUCT_PRICE_ID) for r in prices.additional_prices(*args, NOW).collect())
    return found, others


def test_default_price_wins_and_the_others_are_additional(spark):
    assert effective(spark, [(1, 7, None, "*", 1)], [price(1, default=False), price(2), price(3, default=False)]) == ({7: 2}, [(7, 1), (7, 3)])


def test_without_a_default_the_first_price_is_taken_alone(spark):
    assert effective(spark, [(1, 7, None, "*", 1)], [price(4, default=False), price(3, default=False)]) == ({7: 3}, [])


def test_only_the_region_for_all_counts(spark):
    assert effective(spark, [(1, 7, None, "CA", 1)], [price(1)]) == ({}, [])
    assert effective(spark, [(1, 7, None, "CA", 1), (2, 7, None, "*", 1)], [price(1), price(2, avail=2)]) == ({7: 2}, [])


def test_default_variant_goes_before_the_product_if_it_has_a_price(spark):
    inventory = [(1, 7, None, "*", 1), (2, 7, 70, "*", 1)]
    both = [price(1), price(2, avail=2)]
    assert effective(spark, inventory, both, [(70, 7, "v", True)])[0] == {7: 2}
    assert effective(spark, inventory, both, [(70, 7, "v", False)])[0] == {7: 1}
    assert effective(spark, inventory, both[:1], [(70, 7, "v", True)])[0] == {7: 1}
    # A variant that is sold in one region only hides the product's price.
    assert effective(spark, [(1, 7, None, "*", 1), (2, 7, 70, "CA", 1)], both, [(70, 7, "v", True)])[0] == {}


def test_stock_goes_negative_and_is_flagged(spark):
    inventory = spark.createDataFrame([(1, 7, None, "*", 5), (2, 7, None, "CA", 9), (3, 8, None, "*", 1)], INVENTORY)
    products = spark.createDataFrame([(7, "a"), (8, "b")], "PRODUCT_ID BIGINT, SKU STRING")
    ordered = spark.createDataFrame([("a", 4), ("a", 3), ("zzz", 1)], "SKU STRING, QUANTITY BIGINT")
    got = sorted(tuple(r) for r in prices.decrement_stock(inventory, products, ordered).collect())
    assert got == [(1, 7, -2, True), (2, 7, 2, False), (3, 8, 1, False)]


# --------------------------------------------------------------------- categories


def tree(spark, *pairs):
    return spark.createDataFrame(list(pairs), "CATEGORY_ID BIGINT, PARENT_ID BIGINT")


def test_lineage_of_a_deep_tree_with_broken_parts(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (20, 99), (21, 20), (30, 31), (31, 30), (32, 31), (40, 40)]
    got = {r.CATEGORY_ID: (r.DEPTH, r.LINEAGE, r.ERROR) for r in categories.rebuild_lineage(tree(spark, *rows)).collect()}
    assert got == {
        1: (0, "/1/", None),
        2: (1, "/1/2/", None),
        3: (2, "/1/2/3/", None),
        4: (3, "/1/2/3/4/", None),
        20: (None, None, "missing parent"),
        21: (None, None, "missing parent"),
        30: (None, None, "cycle"),
        31: (None, None, "cycle"),
        32: (None, None, "cycle"),
        40: (None, None, "cycle"),
    }


def test_lineage_of_a_chain_of_any_depth(spark):
    chain = [(i, i - 1 or None) for i in range(1, 5001)]
    rows = categories.rebuild_lineage(tree(spark, *chain, (6001, 6003), (6002, 6001), (6003, 6002)))
    got = {r.CATEGORY_ID: (r.DEPTH, r.ERROR) for r in rows.drop("LINEAGE").collect()}
    assert all(got[i] == (i - 1, None) for i in range(1, 5001))
    assert [got[i] for i in (6001, 6002, 6003)] == [(None, "cycle")] * 3
    assert rows.where("CATEGORY_ID = 5000").first().LINEAGE == "/" + "/".join(map(str, range(1, 5001))) + "/"


def test_moving_a_subtree(spark):
    moved = categories.move_category(tree(spark, (1, None), (2, 1), (3, 2), (9, None)), 2, 9)
    assert {r.CATEGORY_ID: r.LINEAGE for r in moved.collect()} == {1: "/1/", 9: "/9/", 2: "/9/2/", 3: "/9/2/3/"}
    root = categories.move_category(tree(spark, (1, None), (2, 1), (3, 2)), 2, None)
    assert {r.CATEGORY_ID: r.LINEAGE for r in root.collect()} == {1: "/1/", 2: "/2/", 3: "/2/3/"}


def test_ancestors_do_not_mix_up_ids_that_begin_alike(spark):
    df = spark.createDataFrame([(1, "/1/"), (11, "/11/"), (5, "/11//5/")], "CATEGORY_ID BIGINT, LINEAGE STRING")
    got = sorted((r.CATEGORY_ID, r.ANCESTOR_ID) for r in categories.ancestors(df).collect())
    assert got == [(1, 1), (5, 5), (5, 11), (11, 11)]


# ------------------------------------------------------------------------- orders

ORDER = "ORDER_ID BIGINT, SHIPPING DECIMAL(18,2), HANDLING DECIMAL(18,2), FREE_SHIPPING BOOLEAN"
LINE = "ORDER_ID BIGINT, PRODUCT_ID BIGINT, QUANTITY BIGINT, ITEM_PRICE DECIMAL(18,2), TAX_CLASS_ID BIGINT"


def test_order_totals(spark):
    got = totals.order_totals(
        spark.createDataFrame([(1, D("7.00"), D("2.00"), False), (2, D("7.00"), D("2.00"), True), (3, None, None, False)], ORDER),
        spark.createDataFrame([(1, 1, 2, D("10.00"), 1), (1, 2, 1, D("5.00"), 1), (2, 1, 1, D("10.00"), 1), (2, 3, 4, None, 1)], LINE),
        spark.createDataFrame([(1, "setup", D("3.00")), (1, "setup", D("3.00")), (1, "care", D("1.00"))], "ORDER_ID BIGINT, CODE STRING, VALUE DECIMAL(18,2)"),
        spark.createDataFrame([(1, 2, D("0.50")), (1, 1, D("1.50")), (9, 1, D("9.00"))], "ORDER_ID BIGINT, PRODUCT_ID BIGINT, VALUE DECIMAL(18,2)"),
        spark.createDataFrame([(1, "QST", D("2.00")), (1, "GST", D("1.00"))], "ORDER_ID BIGINT, TAX_CODE STRING, VALUE DECIMAL(18,2)"),
    )
    unpriced = got.where("ORDER_TOTAL_TYPE = 'TOTAL'").orderBy("ORDER_ID").collect()
    assert [r.UNPRICED_LINES for r in unpriced] == [0, 1, 0]
    rows = {}
    for r in got.orderBy("ORDER_ID", "SORT_ORDER", "CODE").collect():
        rows.setdefault(r.ORDER_ID, []).append((r.SORT_ORDER, r.CODE, float(r.VALUE)))
    assert rows == {
        1: [
            (0, "care", 1.0), (0, "setup", 6.0), (5, "order.total.subtotal", 23.0), (10, "order.total.discount", 1.5), (11, "order.total.discount", 0.5),
            (100, "order.total.shipping", 7.0), (120, "order.total.handling", 2.0), (200, "GST", 1.0), (201, "QST", 2.0), (500, "order.total.total", 35.0),
        ],
        2: [(5, "order.total.subtotal", 10.0), (100, "order.total.shipping", 0.0), (120, "order.total.handling", 2.0), (500, "order.total.total", 12.0)],
        3: [(5, "order.total.subtotal", 0.0), (500, "order.total.total", 0.0)],
    }


ADDRESS = "ORDER_ID BIGINT, DELIVERY_COUNTRY STRING, DELIVERY_ZONE STRING, DELIVERY_STATE STRING, SHIPPING DECIMAL(18,2), HANDLING DECIMAL(18,2)"
RATE = "TAX_RATE_ID BIGINT, PRIORITY INT, RATE DECIMAL(7,4), TAX_CODE STRING, PIGGYBACK BOOLEAN, COUNTRY STRING, ZONE STRING, STATE STRING"


def tax(spark, orders_, lines, rates, settings_=TaxSettings(), **options):
    result = taxes.taxes(spark.createDataFrame(orders_, ADDRESS), spark.createDataFrame(lines, LINE), spark.createDataFrame(rates, RATE), settings_, **options)
    return sorted((r.ORDER_ID, r.TAX_CODE, float(r.VALUE)) for r in result.collect())


def test_compound_rates_build_on_the_sum_so_far(spark):
    order = [(1, "CA", "QC", None, None, None)]
    line = [(1, 1, 1, D("100.00"), 1)]
    plain = [(1, 0, D("5"), "A", False, "CA", "QC", None), (2, 1, D("10"), "B", False, "CA", "QC", None)]
    assert tax(spark, order, line, plain) == [(1, "A", 5.0), (1, "B", 10.0)]
    compound = [plain[0], (2, 1, D("10"), "B", True, "CA", "QC", None), (3, 2, D("1"), "C", True, "CA", "QC", None), (4, 3, D("1"), "D", False, "CA", "QC", None)]
    assert tax(spark, order, line, compound) == [(1, "A", 5.0), (1, "B", 10.5), (1, "C", 1.16), (1, "D", 1.16)]


def test_a_code_shared_by_two_classes(spark):
    order = [(1, "CA", "QC", None, D("10.00"), D("5.00"))]
    lines = [(1, 1, 1, D("100.00"), 2), (1, 2, 2, D("10.00"), None)]
    rates = [(1, 0, D("10"), "A", False, "CA", "QC", None)]
    # class 1: 20 + 10 shipping + 5 handling; class 2: 100
    assert tax(spark, order, lines, rates) == [(1, "A", 13.5)]
    assert tax(spark, order, lines, rates, first_per_code=True) == [(1, "A", 3.5)]


def test_which_rates_apply(spark):
    rates = [
        (1, 0, D("1"), "zone", False, "CA", "QC", None),
        (2, 0, D("2"), "state", False, "CA", None, "Nord"),
        (3, 0, D("4"), "country", False, "CA", None, None),
        (4, 0, D("8"), "abroad", False, "US", "QC", None),
    ]
    orders_ = [(1, "CA", "QC", "Nord", None, None), (2, "CA", None, "Nord", None, None), (3, "CA", "ON", None, None, None), (4, "CA", None, " ", None, None), (5, "FR", "X", None, None, None)]
    lines = [(i, 1, 1, D("100.00"), 1) for i in range(1, 6)]
    assert tax(spark, orders_, lines, rates) == [
        (1, "country", 4.0), (1, "state", 2.0), (1, "zone", 1.0), (2, "state", 2.0), (3, "country", 4.0), (3, "state", 2.0),
    ]


def test_no_tax_outside_the_stores_province(spark):
    rates = [(1, 0, D("1"), "t", False, "CA", z, s) for z, s in (("QC", None), ("ON", None), (None, "Nord"), (None, "Quebec"))]
    orders_ = [(1, "CA", "QC", None, None, None), (2, "CA", "ON", None, None, None), (3, "CA", None, "Nord", None, None), (4, "CA", None, "Quebec", None, None)]
    lines = [(i, 1, 1, D("100.00"), 1) for i in range(1, 5)]
    here = TaxSettings(collect_outside_province=False, store_country="CA", store_zone="QC", store_zone_name="Quebec")
    assert {o for o, _, _ in tax(spark, orders_, lines, rates, here)} == {1, 4}
    at_store = TaxSettings(basis="STORE", store_country="CA", store_zone="QC")
    assert {o for o, _, _ in tax(spark, orders_, lines, rates, at_store)} == {1, 2, 3, 4}


def test_promotion_runs_out(spark):
    cart = spark.createDataFrame([(1, "Test1234", NOW), (2, "nope", NOW), (3, "Test1234", dt.datetime(2030, 1, 1))], "CART_ID BIGINT, PROMO_CODE STRING, PROMO_ADDED TIMESTAMP")
    lines = spark.createDataFrame([(c, 7, 3) for c in (1, 2, 3)], "CART_ID BIGINT, PRODUCT_ID BIGINT, QUANTITY BIGINT")
    priced = spark.createDataFrame([(7, D("12.50"))], "PRODUCT_ID BIGINT, FINAL_PRICE DECIMAL(18,2)")

    def at(when):
        rows = carts.promo_discounts(cart, lines, priced, carts.promotions(spark), when).collect()
        return [(r.CART_ID, float(r.VALUE)) for r in rows]

    assert at("2025-10-30 23:59:59") == [(1, 3.75)]
    assert at("2025-10-31 00:00:00") == []


def test_merging_carts(spark):
    lines = spark.createDataFrame(
        [(1, 7, "", 2), (1, 8, "5", 1), (2, 7, "", 3), (2, 8, "6", 1), (3, 7, "", 1), (4, 7, "", 9), (5, 9, "", 4)],
        "CART_ID BIGINT, PRODUCT_ID BIGINT, ATTRIBUTES STRING, QUANTITY BIGINT",
    )
    pairs = spark.createDataFrame([(2, 1, None, 50), (4, 3, 60, 60), (5, 6, 70, 70)], "SESSION_CART BIGINT, USER_CART BIGINT, SESSION_CUSTOMER BIGINT, USER_CUSTOMER BIGINT")
    got = sorted(tuple(r) for r in carts.merge_carts(lines, pairs).collect())
    assert got == [(1, 7, "", 5), (1, 8, "5", 1), (1, 8, "6", 1), (3, 7, "", 1), (6, 9, "", 4)]


def test_payments(spark):
    rows = [
        (1, 1, "AUTHORIZE", 1, "{}"), (2, 2, "AUTHORIZE", 1, "{}"), (3, 2, "CAPTURE", 2, None), (4, 3, "INIT", 1, None),
        (5, 4, "AUTHORIZECAPTURE", 1, None), (6, 4, "REFUND", 3, None), (7, 5, "AUTHORIZE", 1, " "), (8, 6, "CAPTURE", 9, None), (9, 6, "AUTHORIZECAPTURE", 1, None),
    ]
    df = spark.createDataFrame([(i, o, t, dt.datetime(2024, 1, d), x) for i, o, t, d, x in rows], "TRANSACTION_ID BIGINT, ORDER_ID BIGINT, TRANSACTION_TYPE STRING, TRANSACTION_DATE TIMESTAMP, DETAILS STRING")
    assert sorted(tuple(r) for r in orders.payment_state(df).collect()) == [
        (1, True, 1, None, "AUTHORIZE"),
        (2, False, None, 3, "CAPTURE"),
        (3, False, None, None, "INIT"),
        (4, False, None, 5, "REFUND"),
        (5, True, None, None, "AUTHORIZE"),
        (6, False, None, 8, "CAPTURE"),
    ]
    # In the first days of January order 2 had not been captured yet.
    early = orders.payment_state(df, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)).where("CAPTURABLE")
    assert sorted(r.ORDER_ID for r in early.collect()) == [1, 2, 5]


def test_an_edited_review_counts_once(spark):
    rows = [(1, 7, 50, 1.0, 1), (2, 7, 50, 5.0, 2), (3, 7, 51, 2.0, 1)]
    df = spark.createDataFrame([(i, p, c, r, dt.datetime(2024, 1, d)) for i, p, c, r, d in rows], "REVIEW_ID BIGINT, PRODUCT_ID BIGINT, CUSTOMER_ID BIGINT, RATING DOUBLE, REVIEW_DATE TIMESTAMP")
    assert [tuple(r) for r in orders.review_summary(df).collect()] == [(7, 3.5, 2)]


def test_pages(spark):
    df = spark.range(20)
    last = page_of(df, ["id"], 1, 10).collect()
    assert [r.id for r in last] == list(range(10, 20)) and last[0].total_pages == 2 and last[0].total_count == 20
    assert page_of(df, ["id"], 2, 10).count() == 0


# ----------------------------------------------------------------------- shipping


def test_distance_prices(spark):
    km = [None, 0.5, 20.0, 20.5, 40.9, 41.0, 150.0, 150.1, 530.9, 531.0, 3550.0, 3551.0]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(km)], "i INT, km DOUBLE").orderBy("i")
    got = df.select(shipping.price_by_distance("km"), shipping.price_by_distance("km", shipping.SHORT_DISTANCE_PRICES), shipping.price_per_km("km")).collect()

    def plain(place):
        return [None if r[place] is None else float(r[place]) for r in got]

    assert plain(0) == [75, 75, 75, 75, 75, 75, 75, 75, 75, 140, 140, None]
    assert plain(1) == [75, 75, 75, 75, 75, 120, 140, 140, 140, 140, None, None]
    assert plain(2) == [None, 1.0, 40.0, 61.5, 122.7, 123.0, 450.0, None, None, None, None, None]


def test_carrier(spark):
    orders_ = spark.createDataFrame([(1, "CA", None, "ON"), (2, "CA", "QC", None), (3, "CA", None, "ON"), (4, "US", "QC", None), (5, "CA", None, "QC"), (6, "CA", "QC", None)], "ORDER_ID BIGINT, DELIVERY_COUNTRY STRING, DELIVERY_ZONE STRING, DELIVERY_STATE STRING")
    rows = [(1, 61.9, 65.0), (2, 63.0, 1.0), (3, 63.0, 1.0), (4, 1.0, 1.0), (5, 1.0, 67.0), (6, 62.5, 1.0)]
    boxes = spark.createDataFrame([(o, w, s, 1.0, 1.0) for o, w, s in rows], "ORDER_ID BIGINT, WEIGHT DOUBLE, HEIGHT DOUBLE, LENGTH DOUBLE, WIDTH DOUBLE")
    got = {r.ORDER_ID: r.CARRIER for r in shipping.carrier_choice(orders_, boxes).collect()}
    assert got == {1: "canadapost", 2: "priceByDistance", 3: None, 4: None, 5: "priceByDistance", 6: None}


def test_options_are_compared_in_whole_units(spark):
    df = spark.createDataFrame([(1, "a", 0, 5.9), (1, "b", 1, 5.1), (1, "c", 2, 7.2), (1, "d", 3, 7.9)], "ORDER_ID BIGINT, OPTION_CODE STRING, POSITION INT, PRICE DOUBLE")
    assert [r.OPTION_CODE for r in shipping.choose_option(df, "LEAST").collect()] == ["a"]
    assert [r.OPTION_CODE for r in shipping.choose_option(df, "HIGHEST").collect()] == ["c"]
    assert sorted((r.OPTION_CODE, r.SELECTED) for r in shipping.choose_option(df, "ALL").collect()) == [("a", True), ("b", False), ("c", False), ("d", False)]


MEASURED = "ORDER_ID BIGINT, PRODUCT_ID BIGINT, QUANTITY BIGINT, WEIGHT DECIMAL(18,2), HEIGHT DECIMAL(18,2), LENGTH DECIMAL(18,2), WIDTH DECIMAL(18,2)"
BOX = Box(length=10, width=5, height=4, weight=0.25, max_weight=30)


def first_fit(lines, box):
    """One unit after the other into the first box that takes it."""
    full = D(str(box.length)) * D(str(box.width)) * D(str(box.height))
    boxes = [[full, D(str(box.max_weight)), 0]]
    for _, _, quantity, weight, height, length, width in sorted(lines, key=lambda r: r[1]):
        volume = height * length * width
        for _ in range(max(quantity, 1)):
            for b in boxes:
                if b[0] * 3 >= volume * 4 and b[1] >= weight:
                    break
            else:
                b = [full, D(str(box.max_weight)), 0]
                boxes.append(b)
            b[0] -= volume
            b[1] -= weight
            b[2] += 1
    return [(i + 1, b[2], float(D(str(box.weight)) + D(str(box.max_weight)) - b[1])) for i, b in enumerate(boxes)]


size = st.sampled_from([D("0.50"), D("1.00"), D("2.00"), D("3.75"), D("4.00")])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 6), st.integers(0, 60), st.sampled_from([D("0.00"), D("0.10"), D("7.50"), D("30.00")]), size, size, size), min_size=1, max_size=9, unique_by=lambda r: (r[0], r[1])))
def test_boxes_against_packing_unit_by_unit(spark, lines):
    got = {}
    for r in parcels_in_boxes(spark.createDataFrame(lines, MEASURED), BOX).collect():
        got.setdefault(r.ORDER_ID, []).append((r.BOX_NO, r.ITEMS, round(r.WEIGHT, 6)))
    for order in {r[0] for r in lines}:
        assert sorted(got[order]) == first_fit([r for r in lines if r[0] == order], BOX)


def test_a_line_of_a_million_units_is_packed_by_arithmetic(spark):
    line = [(1, 1, 1_000_000, D("1.00"), D("1.00"), D("2.00"), D("1.00"))]
    total = parcels_in_boxes(spark.createDataFrame(line, MEASURED), BOX).agg(F.sum("ITEMS"), F.max("ITEMS"), F.count("*")).first()
    assert tuple(total) == (1_000_000, 30, 33_334)


def test_what_cannot_be_packed(spark):
    lines = [
        (1, 1, 1, D("1"), D("4"), D("10"), D("5")),
        (2, 1, 1, D("1"), D("4.01"), D("1"), D("1")),
        (3, 1, 1, D("31"), D("1"), D("1"), D("1")),
        (4, 1, 1, D("1"), D("0"), D("1"), D("1")),
        (4, 2, 1, D("1"), D("1"), D("1"), D("1")),
    ]
    df = spark.createDataFrame(lines, MEASURED)
    assert {r.ORDER_ID: r.ERROR for r in packing_errors(df, BOX).collect()} == {2: parcels.TOO_BIG, 3: parcels.TOO_HEAVY, 4: parcels.NO_VOLUME}
    # The full-size item needs more than three quarters of the first box: it gets
    # one of its own, and the first stays empty.
    assert sorted((r.ORDER_ID, r.BOX_NO, r.ITEMS) for r in parcels_in_boxes(df, BOX).collect()) == [(1, 1, 0), (1, 2, 1)]


def test_measures_and_parcels(spark):
    products = spark.createDataFrame([(1, False, None, None, None, None), (2, True, None, None, None, None), (3, False, D("2.00"), D("1.00"), D("1.00"), D("1.00"))], "PRODUCT_ID BIGINT, PRODUCT_VIRTUAL BOOLEAN, WEIGHT DECIMAL(18,2), LENGTH DECIMAL(18,2), WIDTH DECIMAL(18,2), HEIGHT DECIMAL(18,2)")
    attributes = spark.createDataFrame([(1, D("0.50")), (1, None), (1, D("0.25"))], "PRODUCT_ID BIGINT, WEIGHT DECIMAL(18,2)")
    lines = spark.createDataFrame([(9, 1, 2), (9, 2, 1), (9, 3, 0)], "ORDER_ID BIGINT, PRODUCT_ID BIGINT, QUANTITY BIGINT")
    measured = measured_lines(lines, products, attributes)
    assert {r.PRODUCT_ID: (float(r.WEIGHT), float(r.LENGTH)) for r in measured.collect()} == {1: (1.75, 4.0), 3: (2.0, 1.0)}
    assert [(r.PRODUCT_ID, r.UNIT) for r in parcels_per_item(measured).orderBy("UNIT").collect()] == [(1, 1), (1, 2)]


# ------------------------------------------------------------------------- search


def test_terms_and_lookup(spark):
    documents = spark.createDataFrame([(1, "s", "en", "Blue Handbags-42 XL"), (2, "s", "en", "Handmade bag"), (3, "s", "fr", "Handbags")], "id BIGINT, store STRING, language STRING, name STRING")
    terms = search.search_terms(documents)
    assert sorted(r.term for r in terms.where("id = 1").collect()) == sorted(["blu", "blue", "han", "hand", "handb", "handba", "handbag", "handbags"])
    asked = spark.createDataFrame([("q", "s", "en", "HANDB")], "request_id STRING, store STRING, language STRING, text STRING")
    assert {r.id: r.matched_terms for r in search.keyword_search(terms, asked).collect()} == {1: 3, 2: 2}
    assert [r.suggestion for r in search.suggest(documents, terms, asked).collect()] == ["Blue Handbags-42 XL"]
    assert terms.where("id = 1 AND length(term) > 10").count() == 0


def test_sku_lookup(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b")], "PRODUCT_ID BIGINT, SKU STRING")
    variants = spark.createDataFrame([(10, 1, "a-red")], "VARIANT_ID BIGINT, PRODUCT_ID BIGINT, SKU STRING")
    skus = spark.createDataFrame([("a",), ("a-red",), ("zzz",), ("a",)], "SKU STRING")
    got = sorted(tuple(r) for r in listings.sku_lookup(skus, products, variants).select("SKU", "PRODUCT_ID", "FOUND").collect())
    assert got == [("a", 1, True), ("a-red", 1, True), ("zzz", None, False)]


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The packing function loads in an interpreter that cannot import this package."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    stored = tmp_path / "function"
    stored.write_bytes(cloudpickle.dumps(parcels._pack(BOX)))
    script = (
        "import sys, pickle, pandas as pd\n"
        "run = pickle.load(open(sys.argv[1], 'rb'))\n"
        "line = pd.DataFrame([(1, 1, 2, 1000000, 1000000, 1000000, 1000000)], "
        "columns=['ORDER_ID', 'PRODUCT_ID', 'units', 'volume', 'weight', 'least_volume', 'least_weight'])\n"
        "assert 'tillwork' not in sys.modules and sum(len(f) for f in run([line])) == 1\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", script, str(stored)], check=True, cwd=tmp_path, env=env)
