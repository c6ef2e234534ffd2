"""Reading API endpoints such as ``POST /api/v1/cart``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endpoints the metrics look for.
ADD_TO_CART = "POST /api/v1/cart"
CHECKOUT_PREFIX = "POST /api/v1/auth/cart/"
CHECKOUT_PATTERN = "^POST /api/v1/auth/cart/([^/]+)/checkout$"
GUEST_CART_PATHS = "%/api/v1/cart/%"
USER_CART_PATHS = "%/auth/cart/%"
ANY_CHECKOUT = "%checkout%"


def is_add_to_cart(endpoint: str = "endpoint") -> Column:
    return F.col(endpoint) == ADD_TO_CART


def is_checkout(endpoint: str = "endpoint") -> Column:
    """True for a cart checkout.

    The prefix test comes first: it reaches the parquet reader as a pushed
    filter and spares most rows the regular expression.
    """
    return F.col(endpoint).startswith(CHECKOUT_PREFIX) & F.col(endpoint).rlike(CHECKOUT_PATTERN)


def checkout_cart_code(endpoint: str = "endpoint") -> Column:
    return F.nullif(F.regexp_extract(F.col(endpoint), CHECKOUT_PATTERN, 1), F.lit(""))
