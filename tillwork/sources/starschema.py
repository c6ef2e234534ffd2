"""Shop tables derived from the star-schema parquet files.

The star schema has no shop tables, so each one is given here as a SQL text over
it. Spark runs these texts; the SQL oracle puts the same texts in front of its
own queries. Only the marks between ``@`` differ between the two, see DIALECTS.
Everything downstream of these tables is written twice, independently.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tillwork.operators.relations import Relations

# Schemas of the parquet files. Given, so that no job is run to infer them.
BASE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}
BASE_TABLES = tuple(BASE_SCHEMAS)

DIALECTS = {
    "spark": {
        "@day@": "date_diff(CAST(ts AS DATE), DATE '2024-01-01')",
        "@k@": "CAST(get_json_object(props, '$.k') AS BIGINT)",
        "@base64(": "base64(",
        "@utf8(": "CAST(",
        "@utf8)@": " AS BINARY)",
        "@0to3@": "explode(sequence(0, 3))",
    },
    "duckdb": {
        "@day@": "date_diff('day', TIMESTAMP '2024-01-01', ts)",
        "@k@": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
        "@base64(": "to_base64(",
        "@utf8(": "encode(",
        "@utf8)@": ")",
        "@0to3@": "unnest(range(0, 4))",
    },
}

AS_OF = "2024-02-15 00:00:00"

TABLES: dict[str, str] = {}

# ---------------------------------------------------------------- metric tables

TABLES["api_performance"] = """
SELECT CAST(event_id AS STRING) AS event_id,
       CAST(ts AS TIMESTAMP) AS event_timestamp,
       CASE event_type
         WHEN 'view' THEN 'GET /api/v2/products/category/' || CAST(@k@ % 11 AS STRING)
         WHEN 'click' THEN 'POST /api/v1/cart'
         WHEN 'signup' THEN 'POST /api/v1/customer/register'
         WHEN 'error' THEN 'GET /api/v1/cart/c' || CAST(event_id AS STRING)
         ELSE 'POST /api/v1/auth/cart/c' || CAST(event_id AS STRING) || '/checkout'
       END AS endpoint,
       CASE WHEN event_type <> 'error' THEN '200'
            ELSE CASE event_id % 6 WHEN 0 THEN '400' WHEN 1 THEN '401' WHEN 2 THEN '404'
                                   WHEN 3 THEN '409' WHEN 4 THEN '429' ELSE '500' END
       END AS status_code,
       CAST(user_id AS STRING) AS user_id,
       CAST(user_id AS STRING) || '-' || CAST(CAST(floor(@day@ / (1 + user_id % 7)) AS BIGINT) AS STRING) AS session_id
FROM {events}
"""

TABLES["shopping_cart"] = """
SELECT o_orderkey AS SHP_CART_ID, 'c' || CAST(o_orderkey AS STRING) AS SHP_CART_CODE,
       CAST(1 AS INT) AS MERCHANT_ID, o_custkey AS CUSTOMER_ID,
       CASE WHEN o_orderkey % 4 = 0 THEN 'Test1234' WHEN o_orderkey % 4 = 1 THEN 'OTHER' END AS PROMO_CODE,
       CAST(o_orderdate AS TIMESTAMP) AS DATE_MODIFIED
FROM {orders}
"""

TABLES["shopping_cart_item"] = """
SELECT l_orderkey AS SHP_CART_ID, l_partkey AS PRODUCT_ID,
       CASE WHEN l_quantity = 50 THEN NULL
            ELSE CAST((CAST(l_quantity AS INT) - 1) % 3 + 1 AS INT) END AS QUANTITY
FROM {lineitem}
"""

TABLES["product_availability"] = """
SELECT p_partkey AS PRODUCT_AVAIL_ID, p_partkey AS PRODUCT_ID, '*' AS REGION, p_size AS QUANTITY
FROM {part}
"""

TABLES["product_price"] = """
SELECT p_partkey * 2 AS PRODUCT_PRICE_ID, p_partkey AS PRODUCT_AVAIL_ID,
       CAST(p_retailprice AS DECIMAL(18,2)) AS PRODUCT_PRICE_AMOUNT
FROM {part} WHERE p_partkey % 50 <> 0
UNION ALL
SELECT p_partkey * 2 + 1, p_partkey,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.9 AS DECIMAL(2,1)) AS DECIMAL(18,2))
FROM {part} WHERE p_partkey % 10 = 1 AND p_partkey % 50 <> 0
"""

# -------------------------------------------------------------- raw web requests

TABLES["raw_requests"] = """
SELECT CAST(event_id AS STRING) AS event_id,
       event_timestamp AS received_at,
       method, uri,
       CASE WHEN method = 'GET' AND n % 2 = 0 THEN 'page=' || CAST(n AS STRING) || '&q="a' || chr(92) || 'b"'
            WHEN n % 9 = 1 THEN '  ' END AS query_string,
       CAST(status_code AS INT) AS status,
       CASE n % 3 WHEN 0 THEN 'req-' || CAST(n AS STRING) WHEN 1 THEN ' ' END AS header_request_id,
       CASE WHEN n % 4 = 0 THEN 'web' END AS header_client_id,
       CASE WHEN n % 5 <> 0 THEN session_id END AS header_session_id,
       CASE n % 6 WHEN 0 THEN 'Bearer h.' || jwt_sub || '.s' WHEN 1 THEN 'bearer h.' || jwt_name || '.s'
                  WHEN 2 THEN 'Basic abcdefgh' WHEN 3 THEN 'Bearer nodots' END AS header_authorization,
       CASE WHEN n % 10 = 0 THEN 'S' || session_id END AS server_session_id,
       CASE n % 7 WHEN 0 THEN 'user' || user_id WHEN 1 THEN 'anonymousUser' WHEN 2 THEN '' END AS principal,
       CASE WHEN method = 'POST' THEN 'Application/JSON;charset=UTF-8' END AS content_type,
       CASE WHEN uri LIKE '%/register' THEN
              CASE WHEN n % 2 = 0 THEN '{{"emailAddress": "u' || user_id || '@example.com"}}'
                   ELSE '{{"firstName":"A","username" : "n' || user_id || '","emailAddress":"x"}}' END
            WHEN n % 97 = 0 AND method = 'POST' THEN '{{"note":"' || repeat('0123456789', 2000) || '"}}'
            WHEN method = 'POST' THEN '{{"quantity":1}}' END AS body
FROM (SELECT *, CAST(event_id AS BIGINT) AS n,
             CASE WHEN endpoint LIKE 'GET %' THEN 'GET' ELSE 'POST' END AS method,
             CASE WHEN endpoint LIKE 'GET %' THEN substr(endpoint, 5) ELSE substr(endpoint, 6) END AS uri,
             replace(replace(replace(@base64(@utf8('{{"sub":"u' || user_id || '"}}'@utf8)@), '+', '-'), '/', '_'), '=', '') AS jwt_sub,
             replace(replace(replace(@base64(@utf8('{{"sub":"","user_name":"w' || user_id || '"}}'@utf8)@), '+', '-'), '/', '_'), '=', '') AS jwt_name
      FROM {api_performance}) AS e
"""

# ---------------------------------------------------------------- catalog tables

TABLES["category"] = """
SELECT CAST(1 + r_regionkey AS BIGINT) AS CATEGORY_ID, CAST(NULL AS BIGINT) AS PARENT_ID, 1 AS MERCHANT_ID,
       lower(r_name) AS CODE, r_name AS NAME, 0 AS DEPTH, '/' || CAST(1 + r_regionkey AS STRING) || '/' AS LINEAGE,
       CAST(r_regionkey AS INT) AS SORT_ORDER, true AS VISIBLE, r_regionkey % 2 = 0 AS FEATURED
FROM {region}
UNION ALL
SELECT CAST(101 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), 1, lower(n_name), n_name, 1,
       '/' || CAST(1 + n_regionkey AS STRING) || '/' || CAST(101 + n_nationkey AS STRING) || '/',
       CAST(n_nationkey % 7 AS INT), n_nationkey % 6 <> 0, n_nationkey % 3 = 0
FROM {nation}
"""

TABLES["product"] = """
SELECT p_partkey AS PRODUCT_ID, 'sku' || CAST(p_partkey AS STRING) AS SKU, 1 AS MERCHANT_ID,
       CAST(substr(p_brand, 7) AS BIGINT) AS MANUFACTURER_ID,
       CASE WHEN p_partkey % 5 <> 0 THEN 1 + p_partkey % 2 END AS TAX_CLASS_ID,
       p_partkey % 11 <> 0 AS AVAILABLE,
       CAST(CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2024-01-10 00:00:00' END AS DATE) AS DATE_AVAILABLE,
       p_size % 10 AS SORT_ORDER,
       p_partkey % 13 = 0 AS PRODUCT_VIRTUAL, p_partkey % 17 <> 0 AS PRODUCT_SHIP,
       CASE WHEN p_partkey % 19 <> 0 THEN CAST(2 + p_size % 7 AS DECIMAL(18,2)) END AS LENGTH,
       CASE WHEN p_partkey % 29 <> 0 THEN CAST(1 + p_size % 5 AS DECIMAL(18,2)) END AS WIDTH,
       CASE WHEN p_partkey % 31 <> 0 THEN CAST(1 + p_size % 4 AS DECIMAL(18,2)) END AS HEIGHT,
       CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_size AS DECIMAL(18,2)) END AS WEIGHT
FROM {part}
"""

TABLES["product_description"] = """
SELECT p_partkey * 2 AS DESCRIPTION_ID, p_partkey AS PRODUCT_ID, 'en' AS LANGUAGE, p_name AS NAME,
       replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) AS SEF_URL
FROM {part}
UNION ALL
SELECT p_partkey * 2 + 1, p_partkey, 'fr', 'Le ' || p_name, 'le-' || CAST(p_partkey AS STRING)
FROM {part} WHERE p_partkey % 2 = 0
"""

TABLES["product_category"] = """
SELECT p_partkey AS PRODUCT_ID, 101 + p_partkey % 25 AS CATEGORY_ID FROM {part}
UNION ALL
SELECT p_partkey, 101 + (p_partkey + 7) % 25 FROM {part} WHERE p_partkey % 4 = 1
"""

TABLES["manufacturer"] = """
SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS MANUFACTURER_ID, p_brand AS NAME, 1 AS MERCHANT_ID FROM {part}
"""

TABLES["product_variant"] = """
SELECT p_partkey * 10 + 1 AS VARIANT_ID, p_partkey AS PRODUCT_ID, 'sku' || CAST(p_partkey AS STRING) || '-v1' AS SKU,
       p_partkey % 6 = 0 AS DEFAULT_SELECTION, 'colour' AS OPTION_CODE,
       CASE WHEN p_partkey % 9 = 0 THEN 'red' ELSE 'blue' END AS VALUE_CODE
FROM {part} WHERE p_partkey % 3 = 0
"""

TABLES["inventory"] = """
SELECT p_partkey * 10 AS PRODUCT_AVAIL_ID, p_partkey AS PRODUCT_ID, CAST(NULL AS BIGINT) AS PRODUCT_VARIANT,
       1 AS MERCHANT_ID, CASE WHEN p_partkey % 37 = 0 THEN 'US' ELSE '*' END AS REGION, p_size AS QUANTITY
FROM {part}
UNION ALL
SELECT p_partkey * 10 + 1, p_partkey, NULL, 1, 'CA', p_size * 2 FROM {part} WHERE p_partkey % 8 = 0
UNION ALL
SELECT p_partkey * 10 + 2, p_partkey, p_partkey * 10 + 1, 1, '*', p_size + 3
FROM {part} WHERE p_partkey % 6 = 0 OR p_partkey % 9 = 0
"""

TABLES["price_list"] = """
SELECT p_partkey * 10 AS PRODUCT_PRICE_ID, p_partkey * 10 AS PRODUCT_AVAIL_ID, 'base' AS PRODUCT_PRICE_CODE,
       p_partkey % 41 <> 0 AS DEFAULT_PRICE, 'ONE_TIME' AS PRODUCT_PRICE_TYPE,
       CAST(p_retailprice AS DECIMAL(18,2)) AS PRODUCT_PRICE_AMOUNT,
       CASE WHEN p_partkey % 6 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.8 AS DECIMAL(2,1)) AS DECIMAL(18,2)) END AS SPECIAL_AMOUNT,
       CASE WHEN p_partkey % 6 IN (2, 4) THEN DATE '2024-02-01' WHEN p_partkey % 6 = 5 THEN DATE '2023-02-01' END AS SPECIAL_START,
       CASE WHEN p_partkey % 6 IN (2, 3) THEN DATE '2024-03-01' WHEN p_partkey % 6 = 5 THEN DATE '2023-03-01' END AS SPECIAL_END
FROM {part} WHERE p_partkey % 50 <> 0
UNION ALL
SELECT p_partkey * 10 + 5, p_partkey * 10, 'setup', false, CASE WHEN p_partkey % 20 = 1 THEN 'ONE_TIME' ELSE 'MONTHLY' END,
       CAST(5 + p_partkey % 3 AS DECIMAL(18,2)), NULL, NULL, NULL
FROM {part} WHERE p_partkey % 10 = 1
UNION ALL
SELECT p_partkey * 10 + 1, p_partkey * 10 + 1, 'base', true, 'ONE_TIME', CAST(p_retailprice AS DECIMAL(18,2)), NULL, NULL, NULL
FROM {part} WHERE p_partkey % 8 = 0
UNION ALL
SELECT p_partkey * 10 + 2, p_partkey * 10 + 2, 'base', true, 'ONE_TIME',
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 10 AS DECIMAL(18,2)), NULL, NULL, NULL
FROM {part} WHERE (p_partkey % 6 = 0 OR p_partkey % 9 = 0) AND p_partkey % 12 <> 0
"""

TABLES["product_attribute"] = """
SELECT p_partkey * 2 AS ATTRIBUTE_ID, p_partkey AS PRODUCT_ID, 'type' AS OPTION_CODE, lower(p_type) AS VALUE_CODE,
       lower(p_type) AS VALUE_NAME, CASE WHEN p_partkey % 4 = 0 THEN CAST(1.5 AS DECIMAL(18,2)) END AS PRICE,
       CAST(NULL AS DECIMAL(18,2)) AS WEIGHT, p_partkey % 3 = 0 AS IS_DEFAULT
FROM {part}
UNION ALL
SELECT p_partkey * 2 + 1, p_partkey, 'size', CASE WHEN p_size <= 15 THEN 's' WHEN p_size <= 35 THEN 'm' ELSE 'l' END,
       CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'medium' ELSE 'large' END,
       CAST(CASE WHEN p_size > 35 THEN 2.25 WHEN p_size > 15 THEN 0 ELSE -1 END AS DECIMAL(18,2)),
       CASE WHEN p_size > 35 THEN CAST(0.5 AS DECIMAL(18,2)) END, p_partkey % 6 = 0
FROM {part}
"""

TABLES["product_image"] = """
SELECT p_partkey * 2 AS IMAGE_ID, p_partkey AS PRODUCT_ID, 'p' || CAST(p_partkey AS STRING) || '.png' AS IMAGE, p_partkey % 2 = 0 AS DEFAULT_IMAGE
FROM {part} WHERE p_partkey % 5 <> 2
UNION ALL
SELECT p_partkey * 2 + 1, p_partkey, 'p' || CAST(p_partkey AS STRING) || '-b.png', p_partkey % 2 = 1 FROM {part} WHERE p_partkey % 3 = 0
"""

TABLES["product_relationship"] = """
SELECT p_partkey * 2 AS RELATIONSHIP_ID, 1 + CAST(p_partkey % 2 AS INT) AS STORE_ID,
       CASE WHEN p_partkey % 3 = 0 THEN 'FEATURED_ITEM' ELSE 'RELATED_ITEM' END AS CODE, p_partkey AS PRODUCT_ID,
       (p_partkey * 7 + 3) % 200 AS RELATED_PRODUCT_ID, p_partkey % 4 <> 0 AS ACTIVE
FROM {part}
UNION ALL
SELECT p_partkey * 2 + 1, 1, 'group' || CAST(p_partkey % 5 AS STRING), NULL, p_partkey, true FROM {part} WHERE p_partkey % 2 = 0
"""

# ------------------------------------------------------------------ order tables

TABLES["cart_line"] = """
SELECT SHP_CART_ID AS CART_ID, PRODUCT_ID,
       CASE WHEN PRODUCT_ID % 97 = 0 THEN 'gone' ELSE 'sku' END || CAST(PRODUCT_ID AS STRING) AS SKU,
       CAST(SUM(COALESCE(QUANTITY, 1)) AS BIGINT) AS QUANTITY
FROM {shopping_cart_item} GROUP BY SHP_CART_ID, PRODUCT_ID
"""

TABLES["cart_line_attribute"] = """
SELECT CART_ID, PRODUCT_ID, CASE WHEN (CART_ID + PRODUCT_ID) % 11 = 0 THEN -1 - PRODUCT_ID
                                 ELSE PRODUCT_ID * 2 + (CART_ID + PRODUCT_ID) % 2 END AS ATTRIBUTE_ID
FROM {cart_line} WHERE (CART_ID + PRODUCT_ID) % 3 <> 2
"""

TABLES["shop_order"] = """
SELECT o_orderkey AS ORDER_ID, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS MERCHANT_ID,
       CASE WHEN o_orderstatus = 'F' THEN 'DELIVERED' WHEN o_orderstatus = 'O' THEN 'ORDERED'
            WHEN o_orderkey % 5 = 0 THEN 'REFUNDED' ELSE 'PROCESSED' END AS ORDER_STATUS,
       o_custkey AS CUSTOMER_ID, CAST(o_orderdate AS DATE) AS DATE_PURCHASED,
       CAST(o_totalprice AS DECIMAL(18,2)) AS ORDER_TOTAL,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'stripe' WHEN '2' THEN 'paypal' ELSE 'moneyorder' END AS PAYMENT_MODULE_CODE,
       'c' || CAST(o_custkey AS STRING) || '@example.com' AS CUSTOMER_EMAIL,
       c_mktsegment AS BILLING_FIRST_NAME, c_name AS BILLING_LAST_NAME,
       '555-' || CAST(o_custkey AS STRING) AS BILLING_PHONE, '777-' || CAST(o_orderkey AS STRING) AS DELIVERY_PHONE,
       'N' || CAST(c_nationkey AS STRING) AS BILLING_COUNTRY,
       'N' || CAST((c_nationkey + o_orderkey % 3) % 25 AS STRING) AS DELIVERY_COUNTRY,
       CASE WHEN o_custkey % 2 = 0 THEN 'Z' || CAST(o_custkey % 4 AS STRING) END AS DELIVERY_ZONE,
       CASE WHEN o_custkey % 2 = 1 AND o_custkey % 9 <> 0 THEN 'P' || CAST(o_custkey % 4 AS STRING) END AS DELIVERY_STATE,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 5 + o_orderkey % 20 END AS DECIMAL(18,2)) AS SHIPPING,
       CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2.5 ELSE 0 END AS DECIMAL(18,2)) AS HANDLING,
       o_orderkey % 7 = 0 AS FREE_SHIPPING,
       CASE WHEN o_orderkey % 6 <> 0 THEN CAST((o_orderkey * 13) % 4000 AS DOUBLE) / 4 END AS DISTANCE_KM,
       CASE WHEN o_orderkey % 15 <> 0 THEN 'A1 ' || CAST(o_orderkey % 100 AS STRING) || '-b' END AS POSTAL_CODE
FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey
"""

TABLES["shop_customer"] = """
SELECT c_custkey AS CUSTOMER_ID, CAST(CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS INT) AS MERCHANT_ID,
       c_mktsegment AS FIRST_NAME, c_name AS LAST_NAME, 'c' || CAST(c_custkey AS STRING) || '@example.com' AS EMAIL,
       'N' || CAST(c_nationkey AS STRING) AS COUNTRY
FROM {customer}
"""

TABLES["order_status_history"] = """
SELECT ORDER_ID * 10 AS HISTORY_ID, ORDER_ID, 'ORDERED' AS STATUS, DATE_PURCHASED AS DATE_ADDED FROM {shop_order}
UNION ALL
SELECT ORDER_ID * 10 + 1, ORDER_ID, 'PROCESSED', CAST(DATE_PURCHASED + INTERVAL '1' DAY AS DATE) FROM {shop_order} WHERE ORDER_STATUS <> 'ORDERED'
UNION ALL
SELECT ORDER_ID * 10 + 2, ORDER_ID, ORDER_STATUS, CAST(DATE_PURCHASED + INTERVAL '5' DAY AS DATE) FROM {shop_order}
WHERE ORDER_STATUS IN ('DELIVERED', 'REFUNDED')
"""

TABLES["sm_transaction"] = """
SELECT o_orderkey * 10 AS TRANSACTION_ID, o_orderkey AS ORDER_ID, CAST(o_totalprice AS DECIMAL(18,2)) AS AMOUNT,
       CAST(o_orderdate AS TIMESTAMP) AS TRANSACTION_DATE,
       CASE WHEN o_orderstatus = 'P' THEN 'AUTHORIZECAPTURE' ELSE 'AUTHORIZE' END AS TRANSACTION_TYPE,
       '{{"TRANSACTIONID":"t' || CAST(o_orderkey AS STRING) || '"}}' AS DETAILS
FROM {orders}
UNION ALL
SELECT o_orderkey * 10 + 1, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)), CAST(o_orderdate + INTERVAL '2' DAY AS TIMESTAMP), 'CAPTURE', NULL
FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey * 10 + 2, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)), CAST(o_orderdate + INTERVAL '9' DAY AS TIMESTAMP), 'REFUND', NULL
FROM {orders} WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0
"""

TABLES["product_review"] = """
SELECT l_orderkey * 100 + l_linenumber AS REVIEW_ID, l_partkey AS PRODUCT_ID, o_custkey AS CUSTOMER_ID,
       l_quantity % 5 + 1 AS RATING, CAST(l_shipdate AS TIMESTAMP) AS REVIEW_DATE
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

TABLES["tax_rate"] = """
SELECT CAST(n_nationkey * 100 + n AS BIGINT) AS TAX_RATE_ID, 0 AS PRIORITY, CAST(5 + n_nationkey % 4 AS DECIMAL(7,4)) AS RATE,
       'GST' AS TAX_CODE, false AS PIGGYBACK, 'N' || CAST(n_nationkey AS STRING) AS COUNTRY,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Z' || CAST(n AS STRING) END AS ZONE,
       CASE WHEN n_nationkey % 2 = 1 THEN 'P' || CAST(n AS STRING) END AS STATE
FROM (SELECT *, @0to3@ AS n FROM {nation}) AS four WHERE n_nationkey % 2 = n % 2
UNION ALL
SELECT CAST(n_nationkey * 100 + 50 + n AS BIGINT), 1, CAST(9.975 AS DECIMAL(7,4)),
       CASE WHEN n_nationkey % 5 = 0 THEN 'GST' ELSE 'PST' || CAST(n AS STRING) END, n_nationkey % 3 = 0, 'N' || CAST(n_nationkey AS STRING),
       CASE WHEN n_nationkey % 2 = 0 THEN 'Z' || CAST(n AS STRING) END, CASE WHEN n_nationkey % 2 = 1 THEN 'P' || CAST(n AS STRING) END
FROM (SELECT *, @0to3@ AS n FROM {nation}) AS four WHERE n_nationkey <> 3 AND n_nationkey % 2 = n % 2
UNION ALL
SELECT CAST(n_nationkey * 100 + 90 AS BIGINT), 2, CAST(1.5 AS DECIMAL(7,4)), 'ECO', true, 'N' || CAST(n_nationkey AS STRING), NULL, NULL
FROM {nation} WHERE n_nationkey % 4 = 0
"""

TABLES["shipping_region"] = """
SELECT 'R' || CAST(n_regionkey AS STRING) AS REGION, 'N' || CAST(n_nationkey AS STRING) AS COUNTRY FROM {nation} WHERE n_nationkey <> 24
"""

TABLES["shipping_weight_tier"] = """
SELECT 'R' || CAST(r_regionkey AS STRING) AS REGION, CAST(n AS INT) AS POSITION,
       CAST(CASE n WHEN 0 THEN 60 WHEN 1 THEN 200 WHEN 2 THEN 150 ELSE 900 END AS DECIMAL(18,2)) AS MAX_WEIGHT,
       CAST(4 + r_regionkey + 10 * n AS DECIMAL(18,2)) AS PRICE
FROM (SELECT *, @0to3@ AS n FROM {region}) AS four
"""


def sql_text(name: str, dialect: str) -> str:
    text = TABLES[name]
    for mark, replacement in DIALECTS[dialect].items():
        text = text.replace(mark, replacement)
    return text


class Shop:
    """The shop tables over one folder of parquet files, each built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    @cached_property
    def relations(self) -> Relations:
        """The shared relations over these tables; plans only, nothing is held."""
        return Relations(self)

    def use(self, name: str, df: DataFrame) -> None:
        """Put ``df`` in place of a table, for instance a stream of events."""
        self._known[name] = df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in BASE_TABLES:
                self._known[name] = self.spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
            else:
                text = sql_text(name, "spark")
                needed = {t: self[t] for t in (*BASE_TABLES, *TABLES) if "{" + t + "}" in text}
                self._known[name] = self.spark.sql(text, **needed)
        return self._known[name]
