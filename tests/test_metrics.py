"""Metric rules on hand-made rows, worked out by hand."""

import pytest

from tests.handmade import CART, at, checkout, tables
from tillwork.operators.relations import Relations
from tillwork.plans.metrics import METRICS


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    return df.collect()[0].asDict()


@pytest.fixture(scope="module")
def funnel(spark):
    """Sessions that go through the funnel in every order."""
    return tables(
        spark,
        events=[
            ("cart-then-buy", 0, CART),
            ("cart-then-buy", 90.9, checkout("c1")),
            ("buy-then-cart", 0, checkout("c2")),
            ("buy-then-cart", 10, CART),
            ("only-buy", 5, checkout("c3")),
            ("only-cart", 5, CART),
            ("same-moment", 7, CART),
            ("same-moment", 7, checkout("c4")),
            ("", 0, CART),
            ("", 60, "GET /api/v1/products"),
            ("near-miss", 0, checkout("c1") + "/extra"),
            ("near-miss", 1, "POST /api/v1/auth/cart//checkout"),
            ("near-miss", 2, "post /api/v1/auth/cart/c1/checkout"),
            ("near-miss", 3, "GET /api/v1/auth/cart/c1/checkout"),
            ("near-miss", 4, "GET /checkout-help"),
        ],
        carts=[1, 2, 3, 4],
    )


def test_checkout_pattern_takes_only_the_exact_path(funnel):
    assert sorted(r.cart_code for r in Relations(funnel).checkouts.collect()) == ["c1", "c2", "c3", "c4"]


def test_conversion_needs_a_checkout_at_or_after_the_first_cart(funnel):
    assert one(METRICS["M02"](funnel)) == {
        "sessions_with_cart": 5,
        "sessions_with_sale": 2,
        "cart_to_sale_conversion_rate_pct": 40.0,
    }


def test_any_checkout_path_counts_as_a_visit_that_bought(funnel):
    assert one(METRICS["M06"](funnel)) == {"total_sessions": 7, "sale_sessions": 5, "conversion_rate": 5 / 7}


def test_funnel(funnel):
    got = one(METRICS["M07"](funnel))
    assert (got["total_sessions"], got["sessions_with_cart"], got["sessions_with_checkout"]) == (7, 5, 2)
    assert (got["visit_to_cart_rate_pct"], got["cart_to_checkout_rate_pct"], got["visit_to_checkout_rate_pct"]) == (71.43, 40.0, 28.57)


def test_abandonment_asks_for_no_checkout_at_all(funnel):
    assert one(METRICS["M22"](funnel)) == {"cart_sessions": 5, "abandoned_cart_sessions": 2, "cart_abandonment_rate_pct": 40.0}


def test_time_to_purchase_truncates_to_whole_seconds(funnel):
    assert one(METRICS["M21"](funnel)) == {
        "converted_sessions": 2,
        "avg_minutes_from_cart_to_checkout": 0.75,
        "median_seconds_from_cart_to_checkout": 45.0,
        "p95_seconds_from_cart_to_checkout": 85.5,
    }


def test_first_and_last_event_tie_is_broken_by_event_id(funnel):
    sessions = {r.session_id: r for r in Relations(funnel).sessions.collect()}
    assert sessions["same-moment"].first_endpoint == CART
    assert sessions["same-moment"].last_endpoint == checkout("c4")


def test_last_endpoint_only_of_sessions_without_checkout(funnel):
    got = {r[0]: r[1:] for r in rows(METRICS["M18"](funnel))}
    assert got == {CART: (1, 33.33), "GET /api/v1/products": (1, 33.33), "GET /checkout-help": (1, 33.33)}


def test_request_buckets_reach_past_fifty(spark):
    events = [("busy", i, "GET /a") for i in range(51)] + [("calm", i, "GET /a") for i in range(50)] + [("one", 0, "GET /a")]
    got = {r.request_count_bucket: r.sessions for r in METRICS["M09"](tables(spark, events)).collect()}
    assert got == {"50+ requests": 1, "21-50 requests": 1, "1-5 requests": 1}


@pytest.fixture(scope="module")
def sales(spark):
    """Carts: 1 sold in two sessions, 2 sold without lines, 3 sold, 4 not sold, 5 not sold."""
    return tables(
        spark,
        events=[
            ("a", 0, checkout("c1")),
            ("b", 3600, checkout("c1")),
            ("b", 3700, checkout("c3")),
            ("c", 10, checkout("c2")),
            ("d", 10, checkout("c999")),
            ("e", 10, "GET /x"),
        ],
        carts=[1, 2, 3, 4, 5],
        items=[(1, 10, 2), (1, 20, None), (3, 30, 1), (4, 10, 1), (5, 99, 4)],
        products=[10, 20, 30],
        # product 30 has no price, 20 has two, 99 has no availability
        prices={10: [5.00], 20: [7.5, 10.25]},
    )


def test_sold_carts_and_their_values(sales):
    r = Relations(sales)
    assert {x.SHP_CART_ID: float(x.cart_value) for x in r.sold_cart_values.collect()} == {1: 20.25, 2: 0.0, 3: 0.0}
    assert {x.session_id: float(x.session_value) for x in r.session_values.collect()} == {"a": 20.25, "b": 20.25, "c": 0.0}


def test_session_value(sales):
    assert one(METRICS["M03"](sales)) == {
        "total_sessions": 5,
        "converted_sessions": 3,
        "avg_session_value_converted_only": 13.5,
        "avg_session_value_all_sessions": 8.1,
    }


def test_item_price_counts_a_free_unit_for_a_sold_cart_without_lines(sales):
    # units: 2 + 1 (null) in cart 1, 1 in cart 3, 1 for the empty cart 2
    assert one(METRICS["M05"](sales)) == {"avg_item_sold_price": 4.05}


def test_revenue_by_hour_counts_a_cart_for_every_checkout(sales):
    assert rows(METRICS["M08"](sales)) == [(at(0), 2, 2, 20.25, 10.13), (at(3600), 1, 2, 20.25, 10.13)]


def test_top_products_have_a_row_for_carts_without_lines(sales):
    assert rows(METRICS["M10"](sales)) == [(20, 1, 10.25, 1), (10, 2, 10.0, 1), (30, 1, 0.0, 1), (None, 1, 0.0, 0)]


def test_cart_statistics_total_row(sales):
    assert rows(METRICS["M04"](sales)) == [("all", 4, 1.25, 2.25), ("failed", 2, 1.0, 2.5), ("sale", 2, 1.5, 2.0)]


def test_cart_sizes(sales):
    assert rows(METRICS["M11"](sales)) == [("1 item", 2, 1, 1, 50.0), ("3-5 items", 2, 1, 1, 50.0)]


def test_carts_per_session(sales):
    assert rows(METRICS["M12"](sales)) == [(3, 4, 1.33, 1, 2)]


def test_abandoned_value(sales):
    assert sorted(rows(METRICS["M13"](sales))) == [("abandoned", 2, 5.0, 2.5, 2.5), ("sale", 2, 20.25, 10.13, 10.125)]


def test_value_distribution(sales):
    assert rows(METRICS["M23"](sales)) == [(3, 6.75, 0.0, 20.25, 0.0, 10.125, 16.2, 18.225)]


def test_null_quantity_is_a_unit_in_one_metric_and_nothing_in_the_other(sales):
    assert one(METRICS["M20"](sales)) == {"avg_units_per_cart": 8 / 4}
    assert one(METRICS["M19"](sales)) == {"avg_item_lines_per_cart": 5 / 4}


def test_per_status_gives_rows_of_both(spark):
    events = [("buyer", i, f"GET /b{i}") for i in range(12)] + [("buyer", 99, checkout("c1"))] + [("looker", 0, "GET /a")]
    shop = Relations(tables(spark, events, carts=[1]))
    crowded = METRICS["M16"].build(shop).collect()
    assert len(crowded) == 10 and {r.session_status for r in crowded} == {"converted"}
    both = METRICS["M16"].build(shop, per_status=True).collect()
    assert {r.session_status for r in both} == {"converted", "not_converted"}


# ----------------------------------------------------------------- whole properties

ONE_ROW = ["M01", "M02", "M03", "M05", "M06", "M07", "M12", "M19", "M20", "M21", "M22", "M23"]


@pytest.mark.parametrize("id", sorted(METRICS))
def test_empty_input(spark, id):
    got = METRICS[id](tables(spark)).collect()
    assert len(got) == (1 if id in ONE_ROW else 0)


@pytest.mark.parametrize("id", sorted(METRICS))
def test_rows_in_another_order_and_partitioning_change_nothing(shop, id):
    names = ["api_performance", "shopping_cart", "shopping_cart_item", "product_availability", "product_price"]
    plain = {n: shop[n] for n in names}
    moved = {n: shop[n].repartition(5).sortWithinPartitions(shop[n].columns[-1]) for n in names}
    assert sorted(map(repr, METRICS[id](plain).collect())) == sorted(map(repr, METRICS[id](moved).collect()))


def test_totals_agree_between_metrics(shop):
    r = shop.relations
    stats = {x.cart_status: x.carts for x in METRICS["M04"](r).collect()}
    assert stats["all"] == stats["sale"] + stats["failed"]
    sessions = METRICS["M07"](r).collect()[0].total_sessions
    assert sum(x.sessions for x in METRICS["M09"](r).collect()) == sessions
    assert sum(x.sessions for x in METRICS["M14"](r).collect()) == sessions
    shares = METRICS["M17"].build(r, top=10**6).collect()
    assert abs(sum(x.share_of_sessions_pct for x in shares) - 100) < 0.5
    revenue = sum(x.revenue for x in METRICS["M08"](r).collect())
    assert abs(revenue - sum(float(x.cart_value) for x in r.session_cart_values.collect())) < 0.01
