"""Small shop tables written by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tillwork.schemas import EVENT_CORE, PRODUCT_AVAILABILITY, PRODUCT_PRICE, SHOPPING_CART, SHOPPING_CART_ITEM

START = dt.datetime(2024, 1, 1, 10, 0, 0)

CART = "POST /api/v1/cart"


def checkout(code: str) -> str:
    return f"POST /api/v1/auth/cart/{code}/checkout"


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


def tables(spark, events=(), carts=(), items=(), products=(), prices=None):
    """``events``: (session, seconds, endpoint); ``carts``: ids, with code ``c<id>``;
    ``items``: (cart, product, quantity); ``products``: ids with an availability of
    the same id; ``prices``: {product: [amounts]}."""
    event_rows = [(f"e{i:06d}", at(s), endpoint, session) for i, (session, s, endpoint) in enumerate(events)]
    price_rows = [(p * 100 + i, p, money(a)) for p, amounts in (prices or {}).items() for i, a in enumerate(amounts)]
    return {
        "api_performance": spark.createDataFrame(event_rows, EVENT_CORE),
        "shopping_cart": spark.createDataFrame([(c, f"c{c}", 1, 1, START) for c in carts], SHOPPING_CART),
        "shopping_cart_item": spark.createDataFrame(list(items), SHOPPING_CART_ITEM),
        "product_availability": spark.createDataFrame([(p, p, "*", 1) for p in products], PRODUCT_AVAILABILITY),
        "product_price": spark.createDataFrame(price_rows, PRODUCT_PRICE),
    }
