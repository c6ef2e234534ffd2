"""Fixed schemas of the inputs, and the check made when a table is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "MONEY": T.DecimalType(18, 2),
}


def _schema(text: str) -> T.StructType:
    pairs = (item.split() for item in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EVENTS = _schema(
    "event_id STRING, request_id STRING, event_timestamp TIMESTAMP, api_name STRING, endpoint STRING, "
    "status_code STRING, error_type STRING, user_id STRING, client_id STRING, session_id STRING, payload STRING"
)

# One row per HTTP request as the web tier hands it over.
RAW_REQUESTS = _schema(
    "event_id STRING, received_at TIMESTAMP, method STRING, uri STRING, query_string STRING, status INT, "
    "header_request_id STRING, header_client_id STRING, header_session_id STRING, header_authorization STRING, "
    "server_session_id STRING, principal STRING, content_type STRING, body STRING"
)

SHOPPING_CART = _schema(
    "SHP_CART_ID BIGINT, SHP_CART_CODE STRING, MERCHANT_ID INT, CUSTOMER_ID BIGINT, DATE_MODIFIED TIMESTAMP"
)
SHOPPING_CART_ITEM = _schema("SHP_CART_ID BIGINT, PRODUCT_ID BIGINT, QUANTITY INT")
PRODUCT_AVAILABILITY = _schema("PRODUCT_AVAIL_ID BIGINT, PRODUCT_ID BIGINT, REGION STRING, QUANTITY INT")
PRODUCT_PRICE = _schema("PRODUCT_PRICE_ID BIGINT, PRODUCT_AVAIL_ID BIGINT, PRODUCT_PRICE_AMOUNT MONEY")

# The event columns the metrics read.
EVENT_CORE = _schema("event_id STRING, event_timestamp TIMESTAMP, endpoint STRING, session_id STRING")

METRIC_TABLES = {
    "api_performance": EVENT_CORE,
    "shopping_cart": SHOPPING_CART,
    "shopping_cart_item": SHOPPING_CART_ITEM,
    "product_availability": PRODUCT_AVAILABILITY,
    "product_price": PRODUCT_PRICE,
}


class SchemaMismatch(ValueError):
    pass


def check(df: DataFrame, expected: T.StructType, table: str = "table") -> DataFrame:
    """Fail early if ``df`` lacks a column or has one of another type.

    Extra columns are allowed: they are pruned by whoever does not ask for them.
    """
    actual = {field.name.lower(): field.dataType for field in df.schema.fields}
    problems = []
    for field in expected.fields:
        found = actual.get(field.name.lower())
        if found is None:
            problems.append(f"{field.name} is missing")
        elif found != field.dataType:
            problems.append(f"{field.name} is {found.simpleString()}, not {field.dataType.simpleString()}")
    if problems:
        raise SchemaMismatch(f"{table}: " + "; ".join(problems))
    return df
