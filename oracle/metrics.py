"""SQL for the metrics and their shared relations, written for DuckDB.

Independent of the Spark plans: row_number where Spark aggregates, joins where
Spark carries a flag, quantile_cont over every row where Spark counts values.
"""

R2 = "CAST(ROUND(CAST({} AS DECIMAL(28,8)), 2) AS DOUBLE)"
R4 = "CAST(ROUND(CAST({} AS DECIMAL(28,8)), 4) AS DOUBLE)"


def r2(text: str) -> str:
    return R2.format(text)


def r4(text: str) -> str:
    return R4.format(text)


def pct(top: str, bottom: str) -> str:
    return r2(f"100 * (CAST({top} AS DOUBLE) / NULLIF({bottom}, 0))")


def mean(total: str, count: str) -> str:
    return r2(f"CAST({total} AS DOUBLE) / NULLIF({count}, 0)")


def q(value: str, fraction: float) -> str:
    return f"quantile_cont(CAST({value} AS DOUBLE), {fraction})"


PATTERN = r"'^POST /api/v1/auth/cart/([^/]+)/checkout$'"

SHARED = {
    "co": f"""
        SELECT session_id, event_timestamp, regexp_extract(endpoint, {PATTERN}, 1) AS cart_code
        FROM api_performance WHERE regexp_matches(endpoint, {PATTERN})""",
    "steps": f"""
        SELECT session_id, min(event_timestamp) AS first_event, max(event_timestamp) AS last_event, count(*) AS requests,
               min(event_timestamp) FILTER (WHERE endpoint = 'POST /api/v1/cart') AS cart_ts,
               min(event_timestamp) FILTER (WHERE regexp_matches(endpoint, {PATTERN})) AS checkout_ts
        FROM api_performance GROUP BY session_id""",
    "timed": """
        SELECT *, date_sub('second', first_event, last_event) AS seconds FROM steps""",
    "sold": """
        SELECT SHP_CART_ID FROM shopping_cart WHERE SHP_CART_CODE IN (SELECT cart_code FROM co)""",
    "price1": """
        SELECT a.PRODUCT_ID, max(p.PRODUCT_PRICE_AMOUNT) AS price
        FROM product_availability a LEFT JOIN product_price p USING (PRODUCT_AVAIL_ID) GROUP BY a.PRODUCT_ID""",
    "lines": """
        SELECT i.SHP_CART_ID, i.PRODUCT_ID, coalesce(i.QUANTITY, 1) AS units,
               coalesce(p.price, 0) * coalesce(i.QUANTITY, 1) AS amount
        FROM shopping_cart_item i LEFT JOIN price1 p ON p.PRODUCT_ID = i.PRODUCT_ID""",
    "cartval": "SELECT SHP_CART_ID, sum(amount) AS amount FROM lines GROUP BY SHP_CART_ID",
    "soldval": """
        SELECT s.SHP_CART_ID, coalesce(c.amount, 0) AS amount FROM sold s LEFT JOIN cartval c USING (SHP_CART_ID)""",
    "scmap": """
        SELECT DISTINCT co.session_id, c.SHP_CART_ID FROM co JOIN shopping_cart c ON c.SHP_CART_CODE = co.cart_code""",
    "sessval": """
        SELECT session_id, sum(amount) AS amount FROM scmap JOIN soldval USING (SHP_CART_ID) GROUP BY session_id""",
    "stats": """
        SELECT SHP_CART_ID, count(*) AS n_lines, sum(coalesce(QUANTITY, 1)) AS n_units,
               SHP_CART_ID IN (SELECT SHP_CART_ID FROM sold) AS is_sold
        FROM shopping_cart_item GROUP BY SHP_CART_ID""",
    "conv": """
        SELECT t.*, CASE WHEN t.session_id IN (SELECT session_id FROM co) THEN 'converted' ELSE 'not_converted' END AS status
        FROM timed t""",
}

SQL: dict[str, str] = {}

# ------------------------------------------------------------------ relations

SQL["B01"] = "SELECT session_id, event_timestamp, cart_code FROM co"
SQL["B02"] = "SELECT DISTINCT session_id FROM co"
SQL["B03"] = """
    SELECT session_id, first_event AS first_event_ts, cart_ts AS first_cart_ts, checkout_ts AS first_checkout_ts FROM steps"""
SQL["B04"] = "SELECT SHP_CART_ID FROM sold"
SQL["B05"] = "SELECT session_id, SHP_CART_ID FROM scmap"
SQL["B06"] = "SELECT PRODUCT_ID, CAST(price AS DOUBLE) AS product_price_amount FROM price1"
SQL["B07_sold_carts"] = "SELECT SHP_CART_ID, CAST(amount AS DOUBLE) AS cart_value FROM soldval"
SQL["B07_all_carts"] = "SELECT SHP_CART_ID, CAST(amount AS DOUBLE) AS cart_value FROM cartval"
SQL["B07_session_carts"] = """
    SELECT session_id, SHP_CART_ID, CAST(amount AS DOUBLE) AS cart_value FROM scmap JOIN soldval USING (SHP_CART_ID)"""
SQL["B08"] = "SELECT session_id, CAST(amount AS DOUBLE) AS session_value FROM sessval"
SQL["B09"] = "SELECT session_id, requests AS request_count, seconds AS duration_seconds FROM timed"
SQL["B10"] = "SELECT SHP_CART_ID, n_lines AS item_line_count, CAST(n_units AS BIGINT) AS total_item_units FROM stats"

# -------------------------------------------------------------------- metrics

SQL["M01"] = "SELECT CAST(sum(seconds) AS DOUBLE) / count(seconds) / 60 AS average_session_minutes FROM timed"

SQL["M02"] = f"""
    SELECT count(cart_ts) AS sessions_with_cart,
           count(*) FILTER (WHERE checkout_ts >= cart_ts) AS sessions_with_sale,
           {pct("count(*) FILTER (WHERE checkout_ts >= cart_ts)", "count(cart_ts)")} AS cart_to_sale_conversion_rate_pct
    FROM steps"""

SQL["M03"] = f"""
    SELECT count(DISTINCT s.session_id) AS total_sessions, count(DISTINCT v.session_id) AS converted_sessions,
           {mean("sum(v.amount)", "count(v.amount)")} AS avg_session_value_converted_only,
           {mean("sum(coalesce(v.amount, 0))", "count(*)")} AS avg_session_value_all_sessions
    FROM (SELECT DISTINCT session_id FROM api_performance) s LEFT JOIN sessval v USING (session_id)"""

SQL["M04"] = f"""
    SELECT status AS cart_status, count(*) AS carts, {mean("sum(n_lines)", "count(*)")} AS avg_item_count_in_cart,
           {mean("sum(n_units)", "count(*)")} AS weighted_avg_items_in_cart
    FROM (SELECT *, unnest(['all', CASE WHEN is_sold THEN 'sale' ELSE 'failed' END]) AS status FROM stats)
    GROUP BY status"""

SQL["M05"] = f"""
    SELECT {mean("sum(coalesce(l.amount, 0))", "sum(coalesce(l.units, 1))")} AS avg_item_sold_price
    FROM sold s LEFT JOIN lines l USING (SHP_CART_ID)"""

SQL["M06"] = """
    WITH hit AS (SELECT DISTINCT session_id FROM api_performance WHERE contains(endpoint, 'checkout'))
    SELECT count(*) AS total_sessions, count(hit.session_id) AS sale_sessions,
           CAST(count(hit.session_id) AS DOUBLE) / NULLIF(count(*), 0) AS conversion_rate
    FROM (SELECT DISTINCT session_id FROM api_performance) s LEFT JOIN hit USING (session_id)"""

_BOUGHT = "count(*) FILTER (WHERE checkout_ts >= cart_ts)"
SQL["M07"] = f"""
    SELECT count(*) AS total_sessions, count(cart_ts) AS sessions_with_cart, {_BOUGHT} AS sessions_with_checkout,
           {pct("count(cart_ts)", "count(*)")} AS visit_to_cart_rate_pct,
           {pct(_BOUGHT, "count(cart_ts)")} AS cart_to_checkout_rate_pct,
           {pct(_BOUGHT, "count(*)")} AS visit_to_checkout_rate_pct
    FROM steps"""

SQL["M08"] = f"""
    WITH sale AS (SELECT DISTINCT co.session_id, co.event_timestamp, c.SHP_CART_ID
                  FROM co JOIN shopping_cart c ON c.SHP_CART_CODE = co.cart_code)
    SELECT date_trunc('hour', event_timestamp) AS checkout_hour, count(DISTINCT session_id) AS sale_sessions,
           count(DISTINCT SHP_CART_ID) AS sold_carts, {r2("sum(amount)")} AS revenue,
           {mean("sum(amount)", "count(*)")} AS avg_cart_value
    FROM sale JOIN soldval USING (SHP_CART_ID) GROUP BY 1"""

SQL["M09"] = f"""
    WITH v AS (SELECT t.*, coalesce(s.amount, 0) AS amount,
                      CASE WHEN requests <= 5 THEN '1-5 requests' WHEN requests <= 10 THEN '6-10 requests'
                           WHEN requests <= 20 THEN '11-20 requests' WHEN requests <= 50 THEN '21-50 requests'
                           ELSE '50+ requests' END AS bucket
               FROM timed t LEFT JOIN sessval s USING (session_id))
    SELECT bucket AS request_count_bucket, count(*) AS sessions, count(*) FILTER (WHERE amount > 0) AS converted_sessions,
           {pct("count(*) FILTER (WHERE amount > 0)", "count(*)")} AS conversion_rate_pct,
           {mean("sum(amount)", "count(*)")} AS avg_session_value_all_sessions,
           {mean("sum(amount) FILTER (WHERE amount > 0)", "count(*) FILTER (WHERE amount > 0)")} AS avg_session_value_converted_only,
           {r2("CAST(sum(seconds) AS DOUBLE) / count(*) / 60")} AS avg_session_duration_minutes
    FROM v GROUP BY bucket"""

SQL["M10"] = f"""
    SELECT l.PRODUCT_ID, CAST(sum(coalesce(l.units, 1)) AS BIGINT) AS units_sold, {r2("sum(coalesce(l.amount, 0))")} AS product_revenue,
           count(DISTINCT l.SHP_CART_ID) AS sold_carts_containing_product
    FROM sold s LEFT JOIN lines l ON l.SHP_CART_ID = s.SHP_CART_ID
    GROUP BY l.PRODUCT_ID ORDER BY sum(coalesce(l.amount, 0)) DESC, l.PRODUCT_ID ASC NULLS LAST LIMIT 20"""

SQL["M11"] = f"""
    SELECT CASE WHEN n_units = 1 THEN '1 item' WHEN n_units = 2 THEN '2 items' WHEN n_units IN (3, 4, 5) THEN '3-5 items'
                WHEN n_units >= 6 AND n_units <= 10 THEN '6-10 items' ELSE '10+ items' END AS cart_size_bucket,
           count(*) AS carts, count(*) FILTER (WHERE is_sold) AS sold_carts, count(*) FILTER (WHERE NOT is_sold) AS failed_carts,
           {pct("count(*) FILTER (WHERE is_sold)", "count(*)")} AS cart_conversion_rate_pct
    FROM stats GROUP BY 1"""

SQL["M12"] = f"""
    SELECT count(*) AS successful_sessions, CAST(sum(n) AS BIGINT) AS total_successful_carts,
           {mean("sum(n)", "count(*)")} AS avg_successful_carts_per_successful_session,
           min(n) AS min_successful_carts_per_successful_session, max(n) AS max_successful_carts_per_successful_session
    FROM (SELECT session_id, count(*) AS n FROM scmap GROUP BY session_id)"""

SQL["M13"] = f"""
    SELECT CASE WHEN SHP_CART_ID IN (SELECT SHP_CART_ID FROM sold) THEN 'sale' ELSE 'abandoned' END AS cart_status,
           count(*) AS carts, {r2("sum(amount)")} AS total_cart_value, {mean("sum(amount)", "count(*)")} AS avg_cart_value,
           {r4(q("amount", 0.5))} AS median_cart_value
    FROM cartval GROUP BY 1"""

SQL["M14"] = f"""
    SELECT status AS session_status, count(*) AS sessions,
           {r2("CAST(sum(seconds) AS DOUBLE) / count(*) / 60")} AS avg_session_duration_minutes,
           {r2(q("seconds", 0.5) + " / 60")} AS median_session_duration_minutes,
           {r2(q("seconds", 0.95) + " / 60")} AS p95_session_duration_minutes
    FROM conv GROUP BY status"""

SQL["M15"] = f"""
    SELECT status AS session_status, count(*) AS sessions, {mean("sum(requests)", "count(*)")} AS avg_requests_per_session,
           {r4(q("requests", 0.5))} AS median_requests_per_session, {r4(q("requests", 0.95))} AS p95_requests_per_session
    FROM conv GROUP BY status"""

SQL["M16"] = """
    SELECT CASE WHEN session_id IN (SELECT session_id FROM co) THEN 'converted' ELSE 'not_converted' END AS session_status,
           endpoint, count(*) AS request_count, count(DISTINCT session_id) AS sessions_using_endpoint
    FROM api_performance
    WHERE NOT contains(endpoint, '/api/v1/cart/') AND NOT contains(endpoint, '/auth/cart/')
    GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2 LIMIT 10"""

SQL["M16_per_status"] = """
    SELECT session_status, endpoint, request_count, sessions_using_endpoint FROM (
      SELECT CASE WHEN session_id IN (SELECT session_id FROM co) THEN 'converted' ELSE 'not_converted' END AS session_status,
             endpoint, count(*) AS request_count, count(DISTINCT session_id) AS sessions_using_endpoint
      FROM api_performance
      WHERE NOT contains(endpoint, '/api/v1/cart/') AND NOT contains(endpoint, '/auth/cart/') GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY session_status ORDER BY request_count DESC, endpoint) <= 10"""

SQL["M17"] = f"""
    WITH f AS (SELECT endpoint FROM api_performance
               QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_timestamp, event_id) = 1)
    SELECT endpoint AS first_endpoint, count(*) AS sessions, {pct("count(*)", "sum(count(*)) OVER ()")} AS share_of_sessions_pct
    FROM f GROUP BY endpoint ORDER BY 2 DESC, 1 LIMIT 10"""

SQL["M18"] = f"""
    WITH f AS (SELECT endpoint FROM api_performance WHERE session_id NOT IN (SELECT session_id FROM co)
               QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_timestamp DESC, event_id DESC) = 1)
    SELECT endpoint AS last_endpoint_before_abandonment, count(*) AS abandoned_sessions,
           {pct("count(*)", "sum(count(*)) OVER ()")} AS share_of_abandoned_sessions_pct
    FROM f GROUP BY endpoint ORDER BY 2 DESC, 1 LIMIT 10"""

SQL["M19"] = """
    SELECT CAST(sum(n) AS DOUBLE) / count(n) AS avg_item_lines_per_cart
    FROM (SELECT count(PRODUCT_ID) AS n FROM shopping_cart_item GROUP BY SHP_CART_ID)"""

SQL["M20"] = """
    SELECT CAST(sum(n) AS DOUBLE) / count(n) AS avg_units_per_cart
    FROM (SELECT sum(QUANTITY) AS n FROM shopping_cart_item GROUP BY SHP_CART_ID)"""

SQL["M21"] = f"""
    WITH w AS (SELECT date_sub('second', cart_ts, checkout_ts) AS s FROM steps WHERE checkout_ts >= cart_ts)
    SELECT count(*) AS converted_sessions, {r2("CAST(sum(s) AS DOUBLE) / count(*) / 60")} AS avg_minutes_from_cart_to_checkout,
           {r4(q("s", 0.5))} AS median_seconds_from_cart_to_checkout, {r4(q("s", 0.95))} AS p95_seconds_from_cart_to_checkout
    FROM w"""

_LOST = "count(*) FILTER (WHERE cart_ts IS NOT NULL AND checkout_ts IS NULL)"
SQL["M22"] = f"""
    SELECT count(cart_ts) AS cart_sessions, {_LOST} AS abandoned_cart_sessions,
           {pct(_LOST, "count(cart_ts)")} AS cart_abandonment_rate_pct
    FROM steps"""

SQL["M23"] = f"""
    SELECT count(*) AS sold_carts, {mean("sum(amount)", "count(*)")} AS avg_cart_value, {r2("min(amount)")} AS min_cart_value,
           {r2("max(amount)")} AS max_cart_value, {r4(q("amount", 0.5))} AS median_cart_value,
           {r4(q("amount", 0.75))} AS p75_cart_value, {r4(q("amount", 0.9))} AS p90_cart_value,
           {r4(q("amount", 0.95))} AS p95_cart_value
    FROM soldval"""
