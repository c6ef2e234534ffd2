"""SQL for the mirror, the trace events and the metric runs."""

from oracle import metrics as m

SHARED = {
    "req_session": """
        SELECT *, CASE WHEN trim(header_session_id) <> '' THEN header_session_id
                       ELSE coalesce(server_session_id, '') END AS sid
        FROM raw_requests""",
    "req_claims": r"""
        SELECT *, CASE WHEN lower(header_authorization) LIKE 'bearer %.%' THEN
                 decode(from_base64(rpad(tok, CAST(ceil(length(tok) / 4.0) * 4 AS INT), '='))) END AS claims
        FROM (SELECT *, translate(split_part(substr(header_authorization, 8), '.', 2), '-_', '+/') AS tok FROM req_session)""",
    "req_user": r"""
        SELECT event_id,
               CASE WHEN principal <> 'anonymousUser' AND trim(principal) <> '' THEN principal
                    WHEN json_extract_string(claims, '$.sub') <> '' THEN json_extract_string(claims, '$.sub')
                    WHEN json_extract_string(claims, '$.user_name') <> '' THEN json_extract_string(claims, '$.user_name')
                    WHEN (contains(uri, '/customer/login') OR contains(uri, '/customer/register') OR contains(uri, '/private/login'))
                         AND coalesce(json_extract_string(body, '$.username'), json_extract_string(body, '$.emailAddress')) <> ''
                      THEN coalesce(json_extract_string(body, '$.username'), json_extract_string(body, '$.emailAddress'))
                    WHEN sid <> '' THEN 'anon:' || sid
                    ELSE 'anonymous' END AS user_id
        FROM req_claims""",
    "req_all": r"""
        SELECT r.event_id,
               CASE WHEN trim(header_request_id) <> '' THEN header_request_id
                    ELSE regexp_replace(md5('request:' || r.event_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') END AS request_id,
               received_at AS event_timestamp,
               coalesce((SELECT upper(x[1]) || substr(x, 2) || 'Api'
                         FROM (SELECT nullif(regexp_extract(uri, '/api/v[0-9]+/(private/|auth/)?([^/?]+)', 2), '') AS x)), 'UnknownApi') AS api_name,
               method || ' ' || uri AS endpoint, CAST(status AS VARCHAR) AS status_code,
               CASE status WHEN 200 THEN '' WHEN 400 THEN 'BAD_REQUEST' WHEN 401 THEN 'UNAUTHORIZED' WHEN 404 THEN 'NOT_FOUND'
                           WHEN 409 THEN 'CONFLICT' WHEN 429 THEN 'TOO_MANY_REQUESTS' WHEN 500 THEN 'SERVER_ERROR' END AS error_type,
               u.user_id,
               coalesce(header_client_id, '') AS client_id, sid AS session_id,
               CASE WHEN lower(content_type) LIKE '%json%' AND length(body) > 0 THEN substr(body, 1, 16384)
                    WHEN trim(query_string) <> '' THEN
                      '{"query":"' || replace(replace(query_string, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}'
                    ELSE '' END AS payload
        FROM req_session r JOIN req_user u ON u.event_id = r.event_id""",
    "cart_batch": """
        SELECT * REPLACE ('new' AS PROMO_CODE) FROM shopping_cart WHERE DATE_MODIFIED >= TIMESTAMP '1998-06-01'
        UNION ALL
        SELECT * REPLACE ('late' AS PROMO_CODE, DATE_MODIFIED - INTERVAL 1000 DAY AS DATE_MODIFIED) FROM shopping_cart WHERE SHP_CART_ID % 7 = 0
        UNION ALL
        SELECT * REPLACE ('undated' AS PROMO_CODE, CAST(NULL AS TIMESTAMP) AS DATE_MODIFIED) FROM shopping_cart WHERE SHP_CART_ID % 11 = 0""",
    "cart_merged": """
        SELECT * EXCLUDE (origin) FROM (
          SELECT *, 0 AS origin FROM shopping_cart WHERE DATE_MODIFIED < TIMESTAMP '1999-01-01'
          UNION ALL SELECT *, 1 FROM cart_batch)
        QUALIFY row_number() OVER (PARTITION BY SHP_CART_ID ORDER BY DATE_MODIFIED DESC NULLS LAST, origin DESC) = 1""",
}

SQL = {
    "E01": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "E02": "SELECT * FROM shopping_cart WHERE DATE_MODIFIED >= TIMESTAMP '1999-01-01'",
    "E02_next_cursor": "SELECT max(DATE_MODIFIED) AS cursor_value FROM shopping_cart",
    "E03": "SELECT * FROM cart_merged",
    "E03_stored": "SELECT * FROM cart_merged",
    "E04": "SELECT * FROM shopping_cart",
    "E05": "SELECT * FROM shopping_cart UNION ALL SELECT * FROM shopping_cart WHERE DATE_MODIFIED < TIMESTAMP '1999-01-01'",
    "E06": """SELECT * FROM shopping_cart WHERE DATE_MODIFIED >= TIMESTAMP '1997-01-01' AND DATE_MODIFIED < TIMESTAMP '1998-01-01'
              ORDER BY DATE_MODIFIED DESC, SHP_CART_ID LIMIT 10""",
    "E07": """SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS as_float,
                     '["' || c_name || '","' || c_mktsegment || '"]' AS as_array FROM customer""",
    "E08": """SELECT target, table_name, count(*) AS row_count, CAST(sum(key) AS BIGINT) AS key_sum FROM (
                SELECT unnest(['first', 'second']) AS target, 'customer' AS table_name, CUSTOMER_ID AS key FROM shop_customer
                UNION ALL SELECT unnest(['first', 'second']), 'cart', SHP_CART_ID FROM shopping_cart) GROUP BY 1, 2""",
    "E09": "SELECT * FROM customer",
    "T01": "SELECT * FROM req_all",
    "T02": "SELECT event_id, api_name FROM req_all",
    "T03": "SELECT event_id, error_type FROM req_all",
    "T04": "SELECT event_id, user_id FROM req_all",
    "T05": "SELECT event_id, request_id, client_id, session_id FROM req_all",
    "T06": "SELECT event_id, payload FROM req_all",
    "T07": "SELECT * FROM req_all",
    "T08": "SELECT * FROM req_all",
    "T08_batch": "SELECT * FROM api_performance",
    "B03_stream": """SELECT session_id, first_event AS first_event_ts, cart_ts AS first_cart_ts, checkout_ts AS first_checkout_ts,
                            requests AS request_count, seconds AS duration_seconds FROM timed""",
    "M08_stream": m.SQL["M08"],
    "M08_windows": m.SQL["M08"],
    "R02": m.SQL["M08"],
    "R03": """SELECT max(event_timestamp) AS latest_data_used_at,
                     ROUND(greatest(0, (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(max(event_timestamp))) / 1000000), 3) AS data_latency_seconds
              FROM api_performance""",
    "R04": "SELECT 'newest' AS candidate, count(*) AS row_count, max(event_timestamp) AS latest FROM api_performance",
}

SQL["B03_stream_compacted"] = SQL["B03_stream"]

_GROUPS = {
    "operational_dashboard": {
        "M01": "average_session_duration", "M02": "cart_to_sale_conversion_rate", "M03": "average_session_value_session_ltv",
        "M06": "visit_to_purchase_conversion_rate", "M08": "revenue_by_hour",
    },
    "business_dashboard": {
        "M07": "funnel_stage_distribution", "M09": "revenue_by_session_intensity_bucket",
        "M10": "top_products_by_sold_quantity_and_revenue", "M11": "cart_abandonment_by_cart_size",
        "M12": "successful_carts_per_successful_session",
    },
    "behavioral_analytics": {
        "M14": "session_duration_by_conversion_status", "M15": "request_count_by_conversion_status",
        "M16": "endpoint_popularity_by_conversion_status", "M17": "first_endpoint_entry_point_analysis",
        "M18": "last_endpoint_before_abandoned_session",
    },
    "daily_reporting": {"M04": "average_cart_statistics", "M05": "average_item_sold_price", "M13": "estimated_abandoned_cart_value"},
}

SQL["R01"] = " UNION ALL ".join(
    f"SELECT '{group}' AS group_name, '{id}' AS metric, '{slug}' AS slug, count(*) AS row_count FROM ({m.SQL[id].strip()})"
    for group, ids in _GROUPS.items()
    for id, slug in ids.items()
)

SQL["R05"] = " UNION ALL ".join(
    f"SELECT '{group}' AS group_name, '{id}' AS metric, count(*) AS row_count FROM ({m.SQL[id].strip()})"
    for group, ids in _GROUPS.items()
    for id in ids
)

#: The numbers of each metric of a group.
_NUMBERS = {
    "M01": "average_session_minutes",
    "M02": "sessions_with_cart sessions_with_sale cart_to_sale_conversion_rate_pct",
    "M03": "total_sessions converted_sessions avg_session_value_converted_only avg_session_value_all_sessions",
    "M04": "carts avg_item_count_in_cart weighted_avg_items_in_cart",
    "M05": "avg_item_sold_price",
    "M06": "total_sessions sale_sessions conversion_rate",
    "M07": "total_sessions sessions_with_cart sessions_with_checkout visit_to_cart_rate_pct cart_to_checkout_rate_pct visit_to_checkout_rate_pct",
    "M08": "sale_sessions sold_carts revenue avg_cart_value",
    "M09": "sessions converted_sessions conversion_rate_pct avg_session_value_all_sessions avg_session_value_converted_only avg_session_duration_minutes",
    "M10": "PRODUCT_ID units_sold product_revenue sold_carts_containing_product",
    "M11": "carts sold_carts failed_carts cart_conversion_rate_pct",
    "M12": "successful_sessions total_successful_carts avg_successful_carts_per_successful_session min_successful_carts_per_successful_session max_successful_carts_per_successful_session",
    "M13": "carts total_cart_value avg_cart_value median_cart_value",
    "M14": "sessions avg_session_duration_minutes median_session_duration_minutes p95_session_duration_minutes",
    "M15": "sessions avg_requests_per_session median_requests_per_session p95_requests_per_session",
    "M16": "request_count sessions_using_endpoint",
    "M17": "sessions share_of_sessions_pct",
    "M18": "abandoned_sessions share_of_abandoned_sessions_pct",
}
SQL["R01_values"] = " UNION ALL ".join(
    f"SELECT '{id}' AS metric, '{number}' AS number, ROUND(sum(CAST({number} AS DOUBLE)), 2) AS total FROM ({m.SQL[id].strip()})"
    for id, numbers in _NUMBERS.items()
    for number in numbers.split()
)
