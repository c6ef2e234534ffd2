"""SQL for the catalog, order and customer operators, written for DuckDB."""

NOW = "TIMESTAMP '2024-02-15 00:00:00'"
LIVE = f"AVAILABLE AND CAST(DATE_AVAILABLE AS TIMESTAMP) <= {NOW}"


def d(*names: str) -> str:
    """Amounts as doubles, under their own names."""
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


SHARED = {
    "fp": f"""
        SELECT *, CASE WHEN on_sale THEN SPECIAL_AMOUNT ELSE PRODUCT_PRICE_AMOUNT END AS FINAL_PRICE,
               CASE WHEN on_sale THEN SPECIAL_AMOUNT END AS DISCOUNTED_PRICE
        FROM (SELECT *, SPECIAL_AMOUNT IS NOT NULL AND CASE
                     WHEN SPECIAL_START IS NULL AND SPECIAL_END IS NULL THEN SPECIAL_AMOUNT > 0
                     WHEN SPECIAL_END IS NULL THEN false
                     WHEN SPECIAL_START IS NULL THEN CAST(SPECIAL_END AS TIMESTAMP) > {NOW}
                     ELSE CAST(SPECIAL_START AS TIMESTAMP) < {NOW} AND CAST(SPECIAL_END AS TIMESTAMP) > {NOW} END AS on_sale
              FROM price_list)""",
    "cand": """
        SELECT * FROM (
          SELECT i.PRODUCT_ID, i.REGION, fp.*,
                 CASE WHEN i.PRODUCT_VARIANT IS NULL THEN 1
                      WHEN i.PRODUCT_VARIANT IN (SELECT VARIANT_ID FROM product_variant WHERE DEFAULT_SELECTION) THEN 2 END AS src
          FROM inventory i JOIN fp ON fp.PRODUCT_AVAIL_ID = i.PRODUCT_AVAIL_ID)
        WHERE src IS NOT NULL QUALIFY src = max(src) OVER (PARTITION BY PRODUCT_ID)""",
    "eff": """
        SELECT * FROM cand WHERE REGION = '*'
        QUALIFY row_number() OVER (PARTITION BY PRODUCT_ID ORDER BY DEFAULT_PRICE DESC, PRODUCT_PRICE_ID) = 1""",
    "extra_price": """
        SELECT * FROM cand c WHERE REGION = '*' AND NOT DEFAULT_PRICE
          AND EXISTS (SELECT 1 FROM eff e WHERE e.PRODUCT_ID = c.PRODUCT_ID AND e.DEFAULT_PRICE)""",
    "effattr": """
        SELECT e.PRODUCT_ID, e.FINAL_PRICE + coalesce(a.extra, 0) AS FINAL_PRICE,
               e.PRODUCT_PRICE_AMOUNT + coalesce(a.extra, 0) AS ORIGINAL_PRICE, e.DISCOUNTED_PRICE, e.on_sale
        FROM eff e LEFT JOIN (SELECT PRODUCT_ID, sum(PRICE) AS extra FROM product_attribute
                              WHERE IS_DEFAULT AND PRICE > 0 GROUP BY PRODUCT_ID) a ON a.PRODUCT_ID = e.PRODUCT_ID""",
    "vareff": """
        SELECT i.PRODUCT_VARIANT AS VARIANT_ID, fp.* FROM inventory i JOIN fp ON fp.PRODUCT_AVAIL_ID = i.PRODUCT_AVAIL_ID
        WHERE i.PRODUCT_VARIANT IS NOT NULL AND i.REGION = '*'
        QUALIFY row_number() OVER (PARTITION BY i.PRODUCT_VARIANT ORDER BY DEFAULT_PRICE DESC, PRODUCT_PRICE_ID) = 1""",
    "pstock": """
        SELECT p.PRODUCT_ID, p.SKU, i.QUANTITY, e.FINAL_PRICE, e.DISCOUNTED_PRICE, e.on_sale
        FROM product p
        JOIN (SELECT * FROM inventory WHERE PRODUCT_VARIANT IS NULL
              QUALIFY row_number() OVER (PARTITION BY PRODUCT_ID ORDER BY REGION <> '*', PRODUCT_AVAIL_ID) = 1) i ON i.PRODUCT_ID = p.PRODUCT_ID
        LEFT JOIN effattr e ON e.PRODUCT_ID = p.PRODUCT_ID""",
    "vstock": """
        SELECT v.VARIANT_ID, v.PRODUCT_ID, v.SKU, coalesce(i.QUANTITY, p.QUANTITY) AS QUANTITY,
               CASE WHEN e.VARIANT_ID IS NOT NULL THEN e.FINAL_PRICE ELSE p.FINAL_PRICE END AS FINAL_PRICE,
               CASE WHEN e.VARIANT_ID IS NOT NULL THEN e.DISCOUNTED_PRICE ELSE p.DISCOUNTED_PRICE END AS DISCOUNTED_PRICE,
               CASE WHEN e.VARIANT_ID IS NOT NULL THEN e.on_sale ELSE p.on_sale END AS on_sale
        FROM product_variant v
        LEFT JOIN (SELECT * FROM inventory WHERE PRODUCT_VARIANT IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY PRODUCT_VARIANT ORDER BY REGION <> '*', PRODUCT_AVAIL_ID) = 1) i ON i.PRODUCT_VARIANT = v.VARIANT_ID
        LEFT JOIN vareff e ON e.VARIANT_ID = v.VARIANT_ID
        LEFT JOIN pstock p ON p.PRODUCT_ID = v.PRODUCT_ID""",
    "below": """
        SELECT DISTINCT a.CATEGORY_ID AS ROOT_ID, pc.PRODUCT_ID, pc.CATEGORY_ID
        FROM product_category pc JOIN category c ON c.CATEGORY_ID = pc.CATEGORY_ID
        JOIN category a ON c.LINEAGE LIKE a.LINEAGE || '%'""",
    "oline": """
        SELECT l.CART_ID AS ORDER_ID, l.PRODUCT_ID, l.QUANTITY, e.FINAL_PRICE AS ITEM_PRICE, p.TAX_CLASS_ID, p.AVAILABLE
        FROM cart_line l LEFT JOIN eff e ON e.PRODUCT_ID = l.PRODUCT_ID LEFT JOIN product p ON p.PRODUCT_ID = l.PRODUCT_ID""",
    "oline_cart": "SELECT * FROM oline WHERE AVAILABLE",
    "order_head": "SELECT * FROM shop_order",
    "order_head_cart": "SELECT * REPLACE (CAST(NULL AS DECIMAL(18,2)) AS SHIPPING) FROM shop_order",
    "pricedline": """
        SELECT l.CART_ID, l.SKU, p.PRODUCT_ID, l.QUANTITY, p.PRODUCT_ID IS NULL AS OBSOLETE, coalesce(a.n, 0) AS KEPT_ATTRIBUTES,
               e.FINAL_PRICE + coalesce(a.extra, 0) AS ITEM_PRICE, e.PRODUCT_PRICE_AMOUNT + coalesce(a.extra, 0) AS ORIGINAL_PRICE,
               e.DISCOUNTED_PRICE + coalesce(a.extra, 0) AS DISCOUNTED_PRICE,
               (e.FINAL_PRICE + coalesce(a.extra, 0)) * l.QUANTITY AS SUB_TOTAL
        FROM cart_line l
        LEFT JOIN (SELECT SKU, PRODUCT_ID FROM product UNION ALL SELECT SKU, PRODUCT_ID FROM product_variant) p ON p.SKU = l.SKU
        LEFT JOIN eff e ON e.PRODUCT_ID = p.PRODUCT_ID
        LEFT JOIN (SELECT x.CART_ID, x.PRODUCT_ID, count(*) AS n, sum(pa.PRICE) FILTER (WHERE pa.PRICE > 0) AS extra
                   FROM cart_line_attribute x JOIN product_attribute pa
                     ON pa.ATTRIBUTE_ID = x.ATTRIBUTE_ID AND pa.PRODUCT_ID = x.PRODUCT_ID
                   GROUP BY x.CART_ID, x.PRODUCT_ID) a ON a.CART_ID = l.CART_ID AND a.PRODUCT_ID = p.PRODUCT_ID""",
    "cutline": f"""
        SELECT l.CART_ID, l.PRODUCT_ID, 'Test1234' AS PROMO_CODE,
               CAST(e.FINAL_PRICE * CAST(0.1 AS DECIMAL(5,4)) * l.QUANTITY AS DECIMAL(28,6)) AS VALUE
        FROM cart_line l JOIN shopping_cart c ON c.SHP_CART_ID = l.CART_ID JOIN effattr e ON e.PRODUCT_ID = l.PRODUCT_ID
        WHERE c.PROMO_CODE = 'Test1234' AND CAST(c.DATE_MODIFIED AS DATE) <= CAST({NOW} AS DATE) AND {NOW} < TIMESTAMP '2025-10-31'""",
    "cutline_cart": "SELECT * FROM cutline WHERE PRODUCT_ID IN (SELECT PRODUCT_ID FROM product WHERE AVAILABLE)",
    "mline": """
        SELECT l.CART_ID AS ORDER_ID, l.PRODUCT_ID, l.QUANTITY,
               CAST(coalesce(p.WEIGHT, 1) + coalesce(a.extra, 0) AS DECIMAL(18,2)) AS WEIGHT, CAST(coalesce(p.HEIGHT, 4) AS DECIMAL(18,2)) AS HEIGHT,
               CAST(coalesce(p.LENGTH, 4) AS DECIMAL(18,2)) AS LENGTH, CAST(coalesce(p.WIDTH, 4) AS DECIMAL(18,2)) AS WIDTH
        FROM cart_line l JOIN product p ON p.PRODUCT_ID = l.PRODUCT_ID
        LEFT JOIN (SELECT PRODUCT_ID, sum(WEIGHT) AS extra FROM product_attribute GROUP BY PRODUCT_ID) a ON a.PRODUCT_ID = l.PRODUCT_ID
        WHERE NOT p.PRODUCT_VIRTUAL AND p.PRODUCT_SHIP""",
    "parcel": "SELECT ORDER_ID, PRODUCT_ID, unnest(range(1, QUANTITY + 1)) AS UNIT, WEIGHT, HEIGHT, LENGTH, WIDTH FROM mline",
    "wquote": """
        SELECT o.ORDER_ID, r.REGION, w.weight AS WEIGHT, t.PRICE
        FROM shop_order o JOIN (SELECT ORDER_ID, sum(WEIGHT) AS weight FROM parcel GROUP BY ORDER_ID) w ON w.ORDER_ID = o.ORDER_ID
        JOIN shipping_region r ON r.COUNTRY = o.DELIVERY_COUNTRY
        JOIN shipping_weight_tier t ON t.REGION = r.REGION AND w.weight <= t.MAX_WEIGHT
        WHERE trim(o.POSTAL_CODE) <> ''
        QUALIFY row_number() OVER (PARTITION BY o.ORDER_ID ORDER BY t.POSITION) = 1""",
    "rquote": """
        SELECT ORDER_ID,
               CASE WHEN post AND km <= 530 THEN 75 WHEN post AND km <= 3550 THEN 140 END AS DISTANCE_PRICE,
               CASE WHEN post THEN CASE WHEN km <= 40 THEN 75 WHEN km <= 80 THEN 120 WHEN km <= 2550 THEN 140 END END AS SHORT_DISTANCE_PRICE,
               CASE WHEN post AND DISTANCE_KM <= 150 THEN DISTANCE_KM * CASE WHEN DISTANCE_KM <= 20 THEN 2 ELSE 3 END END AS KM_PRICE,
               CAST(1.5 AS DOUBLE) AS PICKUP_PRICE, 'storePickUp_' || coalesce(DELIVERY_ZONE, DELIVERY_STATE, 'null') AS PICKUP_OPTION
        FROM (SELECT *, coalesce(trunc(DISTANCE_KM), 0) AS km, coalesce(trim(POSTAL_CODE) <> '', false) AS post FROM shop_order)""",
    "ship_option": """
        SELECT ORDER_ID, 'customWeight' AS OPTION_CODE, 0 AS POSITION, CAST(PRICE AS DOUBLE) AS PRICE FROM wquote
        UNION ALL SELECT ORDER_ID, 'priceByDistance', 1, KM_PRICE FROM rquote WHERE KM_PRICE IS NOT NULL
        UNION ALL SELECT ORDER_ID, 'storePickUp', 2, PICKUP_PRICE FROM rquote""",
    "taxbase": """
        SELECT ORDER_ID, cls, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM (
          SELECT ORDER_ID, coalesce(TAX_CLASS_ID, 1) AS cls, coalesce(ITEM_PRICE * QUANTITY, 0) AS amount FROM oline
          UNION ALL
          SELECT ORDER_ID, 1, CASE WHEN SHIPPING > 0 THEN SHIPPING + CASE WHEN HANDLING > 0 THEN HANDLING ELSE 0 END ELSE 0 END FROM order_head)
        GROUP BY ORDER_ID, cls""",
    "taxplan": """
        SELECT b.ORDER_ID, b.cls, b.amount, t.RATE, t.TAX_CODE, t.PIGGYBACK,
               row_number() OVER (PARTITION BY b.ORDER_ID, b.cls ORDER BY t.PRIORITY, t.TAX_RATE_ID) AS place
        FROM taxbase b JOIN shop_order o ON o.ORDER_ID = b.ORDER_ID
        JOIN tax_rate t ON t.COUNTRY = o.DELIVERY_COUNTRY
          AND CASE WHEN o.DELIVERY_ZONE IS NOT NULL THEN t.ZONE = o.DELIVERY_ZONE OR t.ZONE IS NULL ELSE t.STATE = o.DELIVERY_STATE END""",
    "taxstep": """
        WITH RECURSIVE step AS (
          SELECT ORDER_ID, cls, place, TAX_CODE, amount AS base,
                 CAST(ROUND(CAST(amount AS DECIMAL(20,2)) * RATE * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(28,2)) AS tax
          FROM taxplan WHERE place = 1
          UNION ALL
          SELECT p.ORDER_ID, p.cls, p.place, p.TAX_CODE,
                 CASE WHEN p.PIGGYBACK AND s.base + s.tax > 0 THEN CAST(s.base + s.tax AS DECIMAL(28,2)) ELSE s.base END,
                 CAST(ROUND(CAST(CASE WHEN p.PIGGYBACK AND s.base + s.tax > 0 THEN s.base + s.tax ELSE s.base END AS DECIMAL(20,2))
                            * p.RATE * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(28,2))
          FROM step s JOIN taxplan p ON p.ORDER_ID = s.ORDER_ID AND p.cls = s.cls AND p.place = s.place + 1)
        SELECT * FROM step""",
    "tax_rows": "SELECT ORDER_ID, TAX_CODE, sum(tax) AS VALUE FROM taxstep GROUP BY ORDER_ID, TAX_CODE",
    "name_word": r"""
        SELECT *, unnest(regexp_split_to_array(lower(name), '[^\p{L}\p{Nd}]+')) AS w FROM (
          SELECT PRODUCT_ID AS id, LANGUAGE AS language, NAME AS name FROM product_description)""",
    "name_term": "SELECT DISTINCT id, language, substr(w, 1, n) AS term FROM (SELECT *, unnest(range(3, least(length(w), 10) + 1)) AS n FROM name_word WHERE length(w) >= 3)",
    "ask_text": "SELECT DISTINCT p_name AS text FROM part UNION SELECT DISTINCT c_mktsegment FROM customer",
    "askterm": r"""
        SELECT DISTINCT text, substr(w, 1, n) AS term FROM (
          SELECT text, w, unnest(range(3, least(length(w), 10) + 1)) AS n
          FROM (SELECT text, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+')) AS w FROM ask_text) WHERE length(w) >= 3)""",
    "hit_rows": """
        SELECT a.text AS request_id, t.id, count(*) AS matched_terms FROM askterm a JOIN name_term t ON t.term = a.term AND t.language = 'en'
        GROUP BY 1, 2""",
    "review_latest": """
        SELECT PRODUCT_ID, CUSTOMER_ID, RATING FROM product_review
        QUALIFY row_number() OVER (PARTITION BY PRODUCT_ID, CUSTOMER_ID ORDER BY REVIEW_DATE DESC, REVIEW_ID DESC, RATING DESC) = 1""",
    "sku_owner": """
        SELECT SKU, PRODUCT_ID, NULL AS VARIANT_ID FROM product UNION ALL SELECT SKU, PRODUCT_ID, VARIANT_ID FROM product_variant""",
    "asked_sku": "SELECT SKU FROM cart_line UNION SELECT SKU FROM product_variant",
}

# Taxes of carts: the same steps over their lines, without shipping.
for _name in ("taxbase", "taxplan", "taxstep", "tax_rows"):
    _text = SHARED[_name]
    for _word in ("oline", "order_head", "taxbase", "taxplan", "taxstep"):
        _text = _text.replace(f" {_word}", f" {_word}_cart")
    SHARED[f"{_name}_cart"] = _text

SQL: dict[str, str] = {}


def paged(source: str, order: str, page: int, size: int) -> str:
    return f"""
        SELECT *, (SELECT count(*) FROM ({source})) AS total_count,
               CAST(ceil((SELECT count(*) FROM ({source})) / {size}.0) AS BIGINT) AS total_pages
        FROM ({source}) ORDER BY {order} LIMIT {size} OFFSET {page * size}"""


# ------------------------------------------------------------------- products

_LIST = "SELECT p.PRODUCT_ID, p.SKU, p.MANUFACTURER_ID, p.SORT_ORDER FROM product p"
_NAMED = "SELECT x.*, n.NAME FROM ({}) x LEFT JOIN product_description n ON n.PRODUCT_ID = x.PRODUCT_ID AND n.LANGUAGE = '{}'"

SQL["C01"] = _NAMED.format(
    paged(
        f"""{_LIST} WHERE p.MERCHANT_ID = 1 AND {LIVE}
            AND EXISTS (SELECT 1 FROM product_description x WHERE x.PRODUCT_ID = p.PRODUCT_ID AND x.LANGUAGE = 'en')
            AND EXISTS (SELECT 1 FROM product_category x WHERE x.PRODUCT_ID = p.PRODUCT_ID AND x.CATEGORY_ID BETWEEN 101 AND 110)""",
        "SORT_ORDER, PRODUCT_ID", 1, 10,
    ), "en",
)
SQL["C01_by_options"] = _NAMED.format(
    paged(
        f"""{_LIST} WHERE p.MERCHANT_ID = 1
            AND EXISTS (SELECT 1 FROM product_description x WHERE x.PRODUCT_ID = p.PRODUCT_ID AND x.LANGUAGE = 'fr')
            AND EXISTS (SELECT 1 FROM product_attribute x WHERE x.PRODUCT_ID = p.PRODUCT_ID AND x.OPTION_CODE = 'type' AND x.VALUE_NAME LIKE '%e%')
            AND EXISTS (SELECT 1 FROM product_attribute x WHERE x.PRODUCT_ID = p.PRODUCT_ID AND x.OPTION_CODE = 'size' AND x.VALUE_NAME LIKE '%medium%')
            AND EXISTS (SELECT 1 FROM product_attribute x WHERE x.PRODUCT_ID = p.PRODUCT_ID AND x.VALUE_CODE IN ('m', 'l'))""",
        "SORT_ORDER, PRODUCT_ID", 0, 25,
    ), "fr",
)
SQL["C01_by_text"] = paged(
    f"""{_LIST} WHERE p.MERCHANT_ID = 1 AND NOT ({LIVE}) AND lower(p.SKU) LIKE '%1%'
        AND EXISTS (SELECT 1 FROM product_description x WHERE x.PRODUCT_ID = p.PRODUCT_ID AND lower(x.NAME) LIKE '%ring%')""",
    "SORT_ORDER, PRODUCT_ID", 0, 50,
)
SQL["C01_by_manufacturer"] = "SELECT PRODUCT_ID, SKU FROM product WHERE MANUFACTURER_ID = 17 AND MERCHANT_ID = 1"
SQL["C02"] = "SELECT DISTINCT p.PRODUCT_ID, p.SKU, p.SORT_ORDER FROM product p JOIN below b ON b.PRODUCT_ID = p.PRODUCT_ID WHERE b.ROOT_ID = 2 AND p.MERCHANT_ID = 1"
SQL["C03"] = f"""
    SELECT DISTINCT p.PRODUCT_ID, p.SKU, p.SORT_ORDER FROM product p
    JOIN inventory i ON i.PRODUCT_ID = p.PRODUCT_ID AND i.REGION IN ('*', 'CA')
    JOIN product_category c ON c.PRODUCT_ID = p.PRODUCT_ID AND c.CATEGORY_ID IN (101, 102, 103, 104, 105)
    WHERE {LIVE}"""
SQL["C03_by_id"] = f"""
    SELECT DISTINCT p.PRODUCT_ID, p.SKU FROM product p JOIN inventory i ON i.PRODUCT_ID = p.PRODUCT_ID AND i.REGION = '*'
    WHERE p.PRODUCT_ID IN (1, 2, 3, 37, 74, 111) AND {LIVE}"""
SQL["C03_tax_class"] = "SELECT PRODUCT_ID, SKU FROM product WHERE TAX_CLASS_ID = 2"
SQL["C04"] = """
    SELECT a.SKU, o.PRODUCT_ID, o.VARIANT_ID, o.PRODUCT_ID IS NOT NULL AS FOUND FROM asked_sku a LEFT JOIN sku_owner o ON o.SKU = a.SKU"""
SQL["C04_availability"] = """
    SELECT DISTINCT a.SKU, i.PRODUCT_AVAIL_ID, i.PRODUCT_ID, i.REGION, i.QUANTITY FROM asked_sku a JOIN sku_owner o ON o.SKU = a.SKU
    JOIN inventory i ON (o.VARIANT_ID IS NULL AND i.PRODUCT_ID = o.PRODUCT_ID) OR (o.VARIANT_ID IS NOT NULL AND i.PRODUCT_VARIANT = o.VARIANT_ID)"""

_PRICE = """PRODUCT_PRICE_ID, CAST(FINAL_PRICE AS DOUBLE) AS FINAL_PRICE, CAST(PRODUCT_PRICE_AMOUNT AS DOUBLE) AS ORIGINAL_PRICE,
    on_sale AS DISCOUNTED,
    CASE WHEN on_sale THEN CAST(trunc(CAST(100 - CAST(SPECIAL_AMOUNT AS DOUBLE) / CAST(PRODUCT_PRICE_AMOUNT AS DOUBLE) * 100 AS FLOAT)) AS INT) END AS DISCOUNT_PERCENT,
    CAST(DISCOUNTED_PRICE AS DOUBLE) AS DISCOUNTED_PRICE, CASE WHEN on_sale THEN SPECIAL_END END AS DISCOUNT_END"""
SQL["C05"] = f"SELECT PRODUCT_ID, PRODUCT_PRICE_CODE, {_PRICE} FROM eff"
SQL["C05_additional"] = f"SELECT PRODUCT_ID, PRODUCT_PRICE_ID, PRODUCT_PRICE_CODE, PRODUCT_PRICE_TYPE, {d('FINAL_PRICE')} FROM extra_price"
SQL["C05_variant"] = f"SELECT VARIANT_ID, PRODUCT_PRICE_ID, {d('FINAL_PRICE')} FROM vareff"
SQL["C05_availability"] = f"""
    SELECT PRODUCT_AVAIL_ID, PRODUCT_PRICE_ID, {d('FINAL_PRICE')} FROM fp
    QUALIFY row_number() OVER (PARTITION BY PRODUCT_AVAIL_ID ORDER BY DEFAULT_PRICE DESC, PRODUCT_PRICE_ID) = 1"""
SQL["C06"] = f"SELECT PRODUCT_AVAIL_ID, {_PRICE} FROM fp"
SQL["C06_has_discount"] = f"""
    SELECT PRODUCT_PRICE_ID, coalesce(SPECIAL_START < CAST({NOW} AS DATE) AND SPECIAL_END > CAST({NOW} AS DATE), false) AS HAS_DISCOUNT FROM price_list"""
SQL["C07"] = f"SELECT PRODUCT_ID, {d('FINAL_PRICE', 'ORIGINAL_PRICE', 'DISCOUNTED_PRICE')} FROM effattr"
SQL["C08"] = f"SELECT PRODUCT_ID, SKU, QUANTITY, {d('FINAL_PRICE')} FROM pstock"
SQL["C08_variant"] = f"SELECT VARIANT_ID, SKU, QUANTITY, {d('FINAL_PRICE')} FROM vstock"
SQL["C09"] = """
    SELECT i.PRODUCT_AVAIL_ID, i.PRODUCT_ID, CAST(i.QUANTITY - coalesce(t.taken, 0) AS BIGINT) AS QUANTITY, i.QUANTITY - coalesce(t.taken, 0) < 0 AS SHORT
    FROM inventory i LEFT JOIN (SELECT p.PRODUCT_ID, sum(l.QUANTITY) AS taken FROM cart_line l JOIN product p ON p.SKU = l.SKU GROUP BY p.PRODUCT_ID) t
      ON t.PRODUCT_ID = i.PRODUCT_ID"""

# ---------------------------------------------------------------------- carts

SQL["C10"] = f"""
    SELECT CART_ID, SKU, PRODUCT_ID, QUANTITY, OBSOLETE, KEPT_ATTRIBUTES, {d('ITEM_PRICE', 'ORIGINAL_PRICE', 'DISCOUNTED_PRICE', 'SUB_TOTAL')} FROM pricedline"""
SQL["C10_carts"] = """
    SELECT c.SHP_CART_ID AS CART_ID, count(l.CART_ID) = 0 OR coalesce(bool_or(l.OBSOLETE), true) AS OBSOLETE, count(l.CART_ID) AS LINE_COUNT,
           CAST(sum(l.SUB_TOTAL) AS DOUBLE) AS SUB_TOTAL
    FROM shopping_cart c LEFT JOIN pricedline l ON l.CART_ID = c.SHP_CART_ID GROUP BY c.SHP_CART_ID"""
SQL["C11"] = """
    WITH akey AS (SELECT CART_ID, PRODUCT_ID, string_agg(CAST(ATTRIBUTE_ID AS VARCHAR), ',' ORDER BY ATTRIBUTE_ID) AS k
                  FROM (SELECT DISTINCT * FROM cart_line_attribute) GROUP BY CART_ID, PRODUCT_ID),
    line AS (SELECT l.CART_ID, l.PRODUCT_ID, l.QUANTITY, coalesce(a.k, '') AS ATTRIBUTES
             FROM cart_line l LEFT JOIN akey a ON a.CART_ID = l.CART_ID AND a.PRODUCT_ID = l.PRODUCT_ID),
    pair AS (SELECT s.SHP_CART_ID AS s, u.SHP_CART_ID AS u,
                    CASE WHEN s.SHP_CART_ID % 4 = 1 THEN s.CUSTOMER_ID END AS sc,
                    CASE WHEN u.SHP_CART_ID % 16 = 0 THEN CASE WHEN s.SHP_CART_ID % 4 = 1 THEN s.CUSTOMER_ID END ELSE u.CUSTOMER_ID END AS uc
             FROM shopping_cart s JOIN shopping_cart u ON u.SHP_CART_ID = s.SHP_CART_ID - 1 WHERE s.SHP_CART_ID % 2 = 1),
    target AS (SELECT l.*, p.u FROM pair p JOIN line l ON l.CART_ID = p.u
               UNION ALL
               SELECT l.*, p.u FROM pair p JOIN line l ON l.CART_ID = p.s
               WHERE NOT (coalesce(p.sc = p.uc, false) AND EXISTS (SELECT 1 FROM line x WHERE x.CART_ID = p.u)))
    SELECT u AS CART_ID, PRODUCT_ID, ATTRIBUTES, CAST(sum(QUANTITY) AS BIGINT) AS QUANTITY FROM target GROUP BY 1, 2, 3"""
SQL["C12"] = """
    SELECT l.CART_ID, l.PRODUCT_ID, l.SKU, l.QUANTITY FROM cart_line l JOIN product p ON p.PRODUCT_ID = l.PRODUCT_ID
    WHERE NOT p.PRODUCT_VIRTUAL AND p.PRODUCT_SHIP"""
SQL["C12_carts"] = """
    SELECT l.CART_ID, bool_or(NOT p.PRODUCT_VIRTUAL AND p.PRODUCT_SHIP) AS REQUIRES_SHIPPING
    FROM cart_line l JOIN product p ON p.PRODUCT_ID = l.PRODUCT_ID GROUP BY l.CART_ID"""

_TOTAL = "CAST(CAST({} AS DECIMAL(15,4)) AS DOUBLE)"


def _totals(suffix: str = "") -> str:
    """Totals of orders, or with ``_cart`` those of carts: each from its own lines, promotions and taxes."""
    total = _TOTAL.format
    return f"""
    WITH items AS (SELECT ORDER_ID, sum(CAST(ITEM_PRICE * QUANTITY AS DECIMAL(28,4))) AS v, count(*) FILTER (ITEM_PRICE IS NULL) AS unpriced
                   FROM oline{suffix} GROUP BY ORDER_ID),
    off AS (SELECT CART_ID AS ORDER_ID, sum(CAST(VALUE AS DECIMAL(15,4))) AS v FROM cutline{suffix} GROUP BY CART_ID),
    taxed AS (SELECT ORDER_ID, sum(VALUE) AS v FROM tax_rows{suffix} GROUP BY ORDER_ID),
    base AS (SELECT o.ORDER_ID, coalesce(i.v, 0) - coalesce(f.v, 0) AS subtotal, CASE WHEN o.SHIPPING IS NOT NULL AND o.FREE_SHIPPING THEN 0 ELSE o.SHIPPING END AS shipping,
                    CASE WHEN o.SHIPPING IS NOT NULL AND o.HANDLING > 0 THEN o.HANDLING END AS handling, coalesce(t.v, 0) AS taxes, coalesce(i.unpriced, 0) AS unpriced
             FROM order_head{suffix} o LEFT JOIN items i ON i.ORDER_ID = o.ORDER_ID LEFT JOIN off f ON f.ORDER_ID = o.ORDER_ID LEFT JOIN taxed t ON t.ORDER_ID = o.ORDER_ID)
    SELECT ORDER_ID, 'order.total.subtotal' AS CODE, 'SUBTOTAL' AS ORDER_TOTAL_TYPE, CAST(5 AS BIGINT) AS SORT_ORDER, {total('subtotal')} AS VALUE, CAST(NULL AS BIGINT) AS UNPRICED_LINES FROM base
    UNION ALL SELECT ORDER_ID, 'order.total.shipping', 'SHIPPING', 100, {total('shipping')}, NULL FROM base WHERE shipping IS NOT NULL
    UNION ALL SELECT ORDER_ID, 'order.total.handling', 'HANDLING', 120, {total('handling')}, NULL FROM base WHERE handling IS NOT NULL
    UNION ALL SELECT ORDER_ID, 'order.total.total', 'TOTAL', 500, {total('subtotal + coalesce(shipping, 0) + coalesce(handling, 0) + taxes')}, unpriced FROM base
    UNION ALL SELECT CART_ID, 'order.total.discount', 'SUBTOTAL', 9 + row_number() OVER (PARTITION BY CART_ID ORDER BY PRODUCT_ID, VALUE), {total('VALUE')}, NULL FROM cutline{suffix}
    UNION ALL SELECT ORDER_ID, TAX_CODE, 'TAX', 199 + row_number() OVER (PARTITION BY ORDER_ID ORDER BY TAX_CODE), {total('VALUE')}, NULL FROM tax_rows{suffix}
    UNION ALL SELECT l.ORDER_ID, e.PRODUCT_PRICE_CODE, 'PRODUCT', 0, {total('sum(e.FINAL_PRICE)')}, NULL
              FROM oline{suffix} l JOIN extra_price e ON e.PRODUCT_ID = l.PRODUCT_ID GROUP BY l.ORDER_ID, e.PRODUCT_PRICE_CODE"""


SQL["C13"] = _totals()
SQL["C13_cart"] = _totals("_cart")

# ----------------------------------------------------------------- categories

_TREE = """
    WITH RECURSIVE tree AS (
      SELECT CATEGORY_ID, PARENT_ID, 0 AS DEPTH, '/' || CATEGORY_ID || '/' AS LINEAGE FROM {src} WHERE PARENT_ID IS NULL
      UNION ALL
      SELECT c.CATEGORY_ID, c.PARENT_ID, t.DEPTH + 1, t.LINEAGE || c.CATEGORY_ID || '/' FROM {src} c JOIN tree t ON t.CATEGORY_ID = c.PARENT_ID)
    SELECT CATEGORY_ID, PARENT_ID, DEPTH, LINEAGE FROM tree"""
SHARED["tree_now"] = _TREE.format(src="category")
SHARED["moved_category"] = "SELECT CATEGORY_ID, CASE WHEN CATEGORY_ID = 3 THEN 101 ELSE PARENT_ID END AS PARENT_ID FROM category"
SHARED["tree_moved"] = _TREE.format(src="moved_category")
SQL["C14"] = "SELECT *, CAST(NULL AS VARCHAR) AS ERROR FROM tree_now"
SQL["C14_move"] = "SELECT *, CAST(NULL AS VARCHAR) AS ERROR FROM tree_moved"
SQL["C15"] = "SELECT c.CATEGORY_ID, a.CATEGORY_ID AS ANCESTOR_ID FROM category c JOIN category a ON contains(c.LINEAGE, '/' || a.CATEGORY_ID || '/')"
SQL["C15_subtree"] = """
    SELECT a.CATEGORY_ID AS ROOT_ID, c.CATEGORY_ID, c.LINEAGE, c.SORT_ORDER FROM category a JOIN category c ON c.LINEAGE LIKE a.LINEAGE || '%'
    WHERE a.PARENT_ID IS NULL"""
SQL["C15_listing"] = "SELECT CATEGORY_ID, NAME, LINEAGE FROM category WHERE DEPTH >= 1 AND FEATURED AND VISIBLE AND NAME LIKE '%1%'"
SQL["C16"] = f"""
    SELECT c.CATEGORY_ID, count(*) AS product_count FROM product_category c JOIN product p ON p.PRODUCT_ID = c.PRODUCT_ID WHERE {LIVE} GROUP BY 1"""
SQL["C16_subtree"] = f"""
    SELECT b.ROOT_ID AS CATEGORY_ID, count(DISTINCT p.PRODUCT_ID) AS product_count FROM below b JOIN product p ON p.PRODUCT_ID = b.PRODUCT_ID WHERE {LIVE} GROUP BY 1"""
SQL["C16_manufacturer"] = "SELECT MANUFACTURER_ID, count(DISTINCT PRODUCT_ID) AS product_count FROM product GROUP BY 1"
SQL["C16_totals"] = """
    SELECT 1 AS MERCHANT_ID, (SELECT count(*) FROM category) AS category_count, (SELECT count(*) FROM manufacturer) AS manufacturer_count"""
SQL["C17"] = """
    SELECT DISTINCT b.ROOT_ID AS CATEGORY_ID, a.OPTION_CODE, a.VALUE_CODE, a.VALUE_NAME FROM below b JOIN product_attribute a ON a.PRODUCT_ID = b.PRODUCT_ID"""
SQL["C18"] = """
    SELECT DISTINCT b.ROOT_ID AS CATEGORY_ID, m.MANUFACTURER_ID, m.NAME FROM below b JOIN product p ON p.PRODUCT_ID = b.PRODUCT_ID
    JOIN manufacturer m ON m.MANUFACTURER_ID = p.MANUFACTURER_ID"""
SQL["C19"] = """
    SELECT DISTINCT b.ROOT_ID AS CATEGORY_ID, b.PRODUCT_ID,
           CASE WHEN EXISTS (SELECT 1 FROM product_category x WHERE x.PRODUCT_ID = b.PRODUCT_ID
                             AND x.CATEGORY_ID NOT IN (SELECT y.CATEGORY_ID FROM below y WHERE y.ROOT_ID = b.ROOT_ID))
                THEN 'detached' ELSE 'deleted' END AS outcome
    FROM below b"""

# ------------------------------------------------------------------- shipping

SQL["C20"] = f"SELECT ORDER_ID, REGION, {d('WEIGHT', 'PRICE')} FROM wquote"
SQL["C21"] = f"SELECT ORDER_ID, {d('DISTANCE_PRICE', 'SHORT_DISTANCE_PRICE', 'KM_PRICE', 'PICKUP_PRICE')}, PICKUP_OPTION FROM rquote"
SQL["C22"] = """
    WITH t AS (SELECT ORDER_ID, CAST(trunc(sum(WEIGHT)) AS BIGINT) AS w, CAST(trunc(max(greatest(HEIGHT, LENGTH, WIDTH))) AS BIGINT) AS s FROM parcel GROUP BY ORDER_ID),
    o AS (SELECT ORDER_ID, DELIVERY_COUNTRY IN ('N0', 'N1', 'N2', 'N3', 'N4') AS home, coalesce(DELIVERY_ZONE = 'Z0', false) AS qc FROM shop_order)
    SELECT o.ORDER_ID, coalesce(t.w, 0) AS WEIGHT, coalesce(t.s, 0) AS SIZE,
           CASE WHEN NOT home THEN NULL WHEN coalesce(t.w, 0) < 62 AND coalesce(t.s, 0) < 66 THEN 'canadapost'
                WHEN qc AND (t.w > 62 OR t.s > 66) THEN 'priceByDistance' END AS CARRIER
    FROM o LEFT JOIN t ON t.ORDER_ID = o.ORDER_ID"""
SQL["C23"] = """
    WITH a AS (SELECT ORDER_ID, sum(ITEM_PRICE * QUANTITY) AS v FROM oline GROUP BY ORDER_ID),
    x AS (SELECT o.ORDER_ID, o.DELIVERY_COUNTRY AS c, coalesce(a.v, 0) AS v, o.MERCHANT_ID AS m,
                 CASE o.MERCHANT_ID WHEN 1 THEN CAST(substr(o.DELIVERY_COUNTRY, 2) AS INT) % 3 <> 0 ELSE o.DELIVERY_COUNTRY = 'N2' END AS ok
          FROM shop_order o LEFT JOIN a ON a.ORDER_ID = o.ORDER_ID)
    SELECT ORDER_ID, ok AS CAN_SHIP, CASE WHEN NOT ok THEN 'NO_SHIPPING_TO_SELECTED_COUNTRY ' || c END AS RETURN_CODE,
           ok AND CASE m WHEN 1 THEN v > 3000 AND c = 'N1' ELSE v > 1000 END AS FREE_SHIPPING
    FROM x"""
_PICK = "row_number() OVER (PARTITION BY ORDER_ID ORDER BY {} , POSITION) = 1"
SQL["C23_least"] = f"SELECT ORDER_ID, OPTION_CODE, POSITION, PRICE FROM ship_option QUALIFY {_PICK.format('trunc(PRICE)')}"
SQL["C23_highest"] = f"SELECT ORDER_ID, OPTION_CODE, POSITION, PRICE FROM ship_option QUALIFY {_PICK.format('trunc(PRICE) DESC')}"
SQL["C23_all"] = f"SELECT ORDER_ID, OPTION_CODE, POSITION, PRICE, {_PICK.format('trunc(PRICE)')} AS SELECTED FROM ship_option"
SQL["C24"] = f"SELECT ORDER_ID, PRODUCT_ID, CAST(UNIT AS INT) AS UNIT, {d('WEIGHT', 'HEIGHT', 'LENGTH', 'WIDTH')} FROM parcel"
SQL["C25"] = """
    WITH RECURSIVE bad AS (SELECT DISTINCT ORDER_ID FROM mline WHERE WIDTH > 6 OR HEIGHT > 6 OR LENGTH > 10 OR WEIGHT > 60 OR WIDTH * HEIGHT * LENGTH = 0),
    unit AS (SELECT ORDER_ID, CAST(WIDTH * HEIGHT * LENGTH AS DOUBLE) AS v, CAST(WEIGHT AS DOUBLE) AS w,
                    row_number() OVER (PARTITION BY ORDER_ID ORDER BY PRODUCT_ID, UNIT) AS n
             FROM parcel WHERE ORDER_ID NOT IN (SELECT ORDER_ID FROM bad)),
    pack AS (
      SELECT DISTINCT ORDER_ID, CAST(0 AS BIGINT) AS n, [CAST(360 AS DOUBLE)] AS vl, [CAST(60 AS DOUBLE)] AS wl, [CAST(0 AS BIGINT)] AS items FROM unit
      UNION ALL
      SELECT ORDER_ID, n,
             CASE WHEN pos IS NULL THEN list_append(vl, 360 - v) ELSE [CASE WHEN i = pos THEN vl[i] - v ELSE vl[i] END FOR i IN range(1, len(vl) + 1)] END,
             CASE WHEN pos IS NULL THEN list_append(wl, 60 - w) ELSE [CASE WHEN i = pos THEN wl[i] - w ELSE wl[i] END FOR i IN range(1, len(wl) + 1)] END,
             CASE WHEN pos IS NULL THEN list_append(items, 1) ELSE [CASE WHEN i = pos THEN items[i] + 1 ELSE items[i] END FOR i IN range(1, len(items) + 1)] END
      FROM (SELECT p.ORDER_ID, u.n, u.v, u.w, p.vl, p.wl, p.items,
                   [i FOR i IN range(1, len(p.vl) + 1) IF p.vl[i] * 0.75 >= u.v AND p.wl[i] >= u.w][1] AS pos
            FROM pack p JOIN unit u ON u.ORDER_ID = p.ORDER_ID AND u.n = p.n + 1)),
    last AS (SELECT * FROM pack QUALIFY row_number() OVER (PARTITION BY ORDER_ID ORDER BY n DESC) = 1)
    SELECT ORDER_ID, CAST(i AS INT) AS BOX_NO, items[i] AS ITEMS, 0.5 + 60 - wl[i] AS WEIGHT
    FROM (SELECT *, unnest(range(1, len(vl) + 1)) AS i FROM last)"""
SQL["C25_errors"] = """
    SELECT ORDER_ID, CASE WHEN WIDTH > 5 OR HEIGHT > 4 OR LENGTH > 8 THEN 'larger than the box' WHEN WEIGHT > 45 THEN 'heavier than the box allows' ELSE 'no volume' END AS ERROR
    FROM mline WHERE WIDTH > 5 OR HEIGHT > 4 OR LENGTH > 8 OR WEIGHT > 45 OR WIDTH * HEIGHT * LENGTH = 0
    QUALIFY row_number() OVER (PARTITION BY ORDER_ID ORDER BY PRODUCT_ID) = 1"""

# ----------------------------------------------------------- money and people

SQL["C26"] = """
    SELECT ORDER_ID,
           count(*) FILTER (WHERE TRANSACTION_TYPE = 'AUTHORIZE') > 0 AND count(*) FILTER (WHERE TRANSACTION_TYPE IN ('CAPTURE', 'AUTHORIZECAPTURE', 'REFUND')) = 0 AS CAPTURABLE,
           CASE WHEN count(*) FILTER (WHERE TRANSACTION_TYPE IN ('CAPTURE', 'REFUND')) = 0
                THEN max(TRANSACTION_ID) FILTER (WHERE TRANSACTION_TYPE = 'AUTHORIZE' AND trim(DETAILS) <> '') END AS CAPTURABLE_TRANSACTION,
           coalesce(max(TRANSACTION_ID) FILTER (WHERE TRANSACTION_TYPE = 'CAPTURE'), max(TRANSACTION_ID) FILTER (WHERE TRANSACTION_TYPE = 'AUTHORIZECAPTURE')) AS REFUNDABLE_TRANSACTION,
           last(TRANSACTION_TYPE ORDER BY TRANSACTION_DATE, TRANSACTION_ID) AS LAST_TYPE
    FROM sm_transaction GROUP BY ORDER_ID"""
SQL["C26_in_range"] = """
    WITH t AS (SELECT * FROM sm_transaction WHERE TRANSACTION_DATE BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01')
    SELECT DISTINCT ORDER_ID FROM t WHERE TRANSACTION_TYPE = 'AUTHORIZE'
      AND ORDER_ID NOT IN (SELECT ORDER_ID FROM t WHERE TRANSACTION_TYPE IN ('CAPTURE', 'AUTHORIZECAPTURE', 'REFUND'))"""
SQL["C26_details"] = "SELECT TRANSACTION_ID, json_extract_string(DETAILS, '$.TRANSACTIONID') AS DETAIL FROM sm_transaction"
SQL["C27"] = f"SELECT ORDER_ID, TAX_CODE, {d('VALUE')} FROM tax_rows"
SQL["C27_first_per_code"] = """
    SELECT ORDER_ID, TAX_CODE, CAST(tax AS DOUBLE) AS VALUE FROM taxstep QUALIFY row_number() OVER (PARTITION BY ORDER_ID, TAX_CODE ORDER BY cls, place) = 1"""
SQL["C27_province"] = """
    SELECT ORDER_ID, DELIVERY_COUNTRY AS COUNTRY, DELIVERY_ZONE AS ZONE, DELIVERY_STATE AS STATE FROM shop_order
    WHERE (DELIVERY_ZONE IS NULL OR DELIVERY_ZONE = 'Z2') AND (DELIVERY_STATE IS NULL OR DELIVERY_STATE = 'P1') AND coalesce(DELIVERY_ZONE, DELIVERY_STATE) IS NOT NULL"""
SQL["C27_stores"] = """
    WITH RECURSIVE base AS (
      SELECT ORDER_ID, cls, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM (
        SELECT l.ORDER_ID, coalesce(TAX_CLASS_ID, o.MERCHANT_ID) AS cls, coalesce(ITEM_PRICE * QUANTITY, 0) AS amount
        FROM oline l JOIN shop_order o ON o.ORDER_ID = l.ORDER_ID
        UNION ALL SELECT ORDER_ID, MERCHANT_ID, CASE WHEN SHIPPING > 0 THEN SHIPPING + CASE WHEN HANDLING > 0 THEN HANDLING ELSE 0 END ELSE 0 END
        FROM shop_order) GROUP BY ORDER_ID, cls),
    rate AS (
      SELECT 1 AS m, * FROM tax_rate
      UNION ALL SELECT 2, * REPLACE (CAST(RATE + 1 AS DECIMAL(7,4)) AS RATE) FROM tax_rate WHERE TAX_RATE_ID % 3 <> 0),
    place AS (
      SELECT ORDER_ID, MERCHANT_ID AS m, CASE MERCHANT_ID WHEN 1 THEN DELIVERY_COUNTRY ELSE 'N4' END AS c,
             CASE MERCHANT_ID WHEN 1 THEN DELIVERY_ZONE ELSE 'Z2' END AS z, CASE MERCHANT_ID WHEN 1 THEN DELIVERY_STATE END AS s FROM shop_order),
    plan AS (
      SELECT b.*, t.RATE, t.TAX_CODE, t.PIGGYBACK, row_number() OVER (PARTITION BY b.ORDER_ID, b.cls ORDER BY t.PRIORITY, t.TAX_RATE_ID) AS n
      FROM base b JOIN place p ON p.ORDER_ID = b.ORDER_ID
      JOIN rate t ON t.m = p.m AND t.COUNTRY = p.c AND CASE WHEN p.z IS NOT NULL THEN t.ZONE = p.z OR t.ZONE IS NULL ELSE t.STATE = p.s END),
    step AS (
      SELECT ORDER_ID, cls, n, TAX_CODE, amount AS start, CAST(ROUND(CAST(amount AS DECIMAL(20,2)) * RATE * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(28,2)) AS tax
      FROM plan WHERE n = 1
      UNION ALL
      SELECT p.ORDER_ID, p.cls, p.n, p.TAX_CODE, CASE WHEN p.PIGGYBACK AND s.start + s.tax > 0 THEN CAST(s.start + s.tax AS DECIMAL(28,2)) ELSE s.start END,
             CAST(ROUND(CAST(CASE WHEN p.PIGGYBACK AND s.start + s.tax > 0 THEN s.start + s.tax ELSE s.start END AS DECIMAL(20,2)) * p.RATE * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(28,2))
      FROM step s JOIN plan p ON p.ORDER_ID = s.ORDER_ID AND p.cls = s.cls AND p.n = s.n + 1)
    SELECT ORDER_ID, TAX_CODE, CAST(sum(tax) AS DOUBLE) AS VALUE FROM step GROUP BY 1, 2"""
SQL["C28"] = f"SELECT CART_ID, PRODUCT_ID, PROMO_CODE, {d('VALUE')} FROM cutline"
SQL["C29"] = "SELECT PRODUCT_ID, sum(RATING) / count(RATING) AS REVIEW_AVG, count(*) AS REVIEW_COUNT FROM review_latest GROUP BY 1"
SQL["C29_by_customer"] = "SELECT CUSTOMER_ID, sum(RATING) / count(RATING) AS REVIEW_AVG, count(*) AS REVIEW_COUNT FROM review_latest GROUP BY 1"
SQL["C30"] = """
    SELECT r.RELATIONSHIP_ID, r.PRODUCT_ID, r.RELATED_PRODUCT_ID, n.NAME AS RELATED_NAME FROM product_relationship r
    JOIN product p ON p.PRODUCT_ID = r.RELATED_PRODUCT_ID JOIN product_description n ON n.PRODUCT_ID = p.PRODUCT_ID
    WHERE r.STORE_ID = 1 AND r.CODE = 'RELATED_ITEM' AND p.AVAILABLE AND n.LANGUAGE = 'en'"""
SQL["C30_groups"] = "SELECT CODE, count(*) AS member_count FROM product_relationship WHERE STORE_ID = 1 AND PRODUCT_ID IS NULL GROUP BY 1"
SQL["C30_of_product"] = """
    SELECT DISTINCT p.PRODUCT_ID AS ANY_PRODUCT_ID, r.RELATIONSHIP_ID, r.CODE FROM product p JOIN product_relationship r ON p.PRODUCT_ID = r.PRODUCT_ID
    UNION SELECT DISTINCT p.PRODUCT_ID, r.RELATIONSHIP_ID, r.CODE FROM product p JOIN product_relationship r ON p.PRODUCT_ID = r.RELATED_PRODUCT_ID"""

_ORDER = f"SELECT ORDER_ID, ORDER_STATUS, CUSTOMER_ID, BILLING_LAST_NAME, {d('ORDER_TOTAL')} FROM shop_order WHERE MERCHANT_ID = 1"
SQL["C31"] = paged(
    f"""{_ORDER} AND (contains(BILLING_FIRST_NAME, 'MACH') OR contains(BILLING_LAST_NAME, 'MACH')) AND ORDER_STATUS = 'DELIVERED'
        AND PAYMENT_MODULE_CODE LIKE '%strip%' AND (BILLING_PHONE LIKE '%5%' OR DELIVERY_PHONE LIKE '%5%')""",
    "ORDER_ID DESC", 1, 15,
)
SQL["C31_by_id"] = paged(f"{_ORDER} AND CAST(ORDER_ID AS VARCHAR) LIKE '%77%' AND CUSTOMER_EMAIL LIKE '%@example%'", "ORDER_ID", 0, 20)
SQL["C31_by_customer"] = "SELECT ORDER_ID, ORDER_STATUS FROM shop_order WHERE MERCHANT_ID = 1 AND CUSTOMER_ID = 7"
SQL["C32"] = paged(
    """SELECT CUSTOMER_ID, FIRST_NAME, LAST_NAME, EMAIL, COUNTRY FROM shop_customer WHERE MERCHANT_ID = 1
       AND (FIRST_NAME LIKE '%000%' OR LAST_NAME LIKE '%000%') AND FIRST_NAME LIKE '%E%' AND LAST_NAME LIKE '%1%' AND EMAIL LIKE '%@%' AND COUNTRY LIKE '%N1%'""",
    "CUSTOMER_ID", 0, 30,
)
SQL["C33"] = "SELECT ORDER_ID, HISTORY_ID, STATUS, DATE_ADDED FROM order_status_history"
SQL["C33_current"] = """
    SELECT o.ORDER_ID, coalesce(h.STATUS, 'ORDERED') AS STATUS, coalesce(h.DATE_ADDED, o.DATE_PURCHASED) AS SINCE, coalesce(h.n, 0) AS CHANGES
    FROM shop_order o LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY ORDER_ID) AS n FROM order_status_history
      QUALIFY row_number() OVER (PARTITION BY ORDER_ID ORDER BY DATE_ADDED DESC, HISTORY_ID DESC) = 1) h ON h.ORDER_ID = o.ORDER_ID"""
_SPAN = """
    SELECT x.*, (SELECT count(*) FROM price_list p WHERE p.PRODUCT_AVAIL_ID = x.PRODUCT_AVAIL_ID) AS price_count,
           CAST((SELECT min(PRODUCT_PRICE_AMOUNT) FROM price_list p WHERE p.PRODUCT_AVAIL_ID = x.PRODUCT_AVAIL_ID) AS DOUBLE) AS lowest_price,
           CAST((SELECT max(PRODUCT_PRICE_AMOUNT) FROM price_list p WHERE p.PRODUCT_AVAIL_ID = x.PRODUCT_AVAIL_ID) AS DOUBLE) AS highest_price
    FROM ({}) x"""
_STOCK = "SELECT PRODUCT_AVAIL_ID, PRODUCT_ID, PRODUCT_VARIANT, REGION, QUANTITY FROM inventory WHERE MERCHANT_ID = 1"
SQL["C34"] = _SPAN.format(paged(_STOCK, "PRODUCT_AVAIL_ID", 2, 25))
SQL["C34_by_sku"] = _SPAN.format(
    paged(_STOCK + " AND PRODUCT_VARIANT IN (SELECT VARIANT_ID FROM product_variant WHERE SKU = 'sku24-v1')", "PRODUCT_AVAIL_ID", 0, 20)
)

# --------------------------------------------------------------------- search

_MONEY = "CASE WHEN {0} IS NULL THEN '' ELSE format('{{:,.2f}}', CAST({0} AS DOUBLE)) END"
_STOCKTEXT = (
    "CASE WHEN on_sale THEN 'discountPrice=' || " + _MONEY.format("DISCOUNTED_PRICE") + " || ';' ELSE '' END || 'price=' || "
    + _MONEY.format("FINAL_PRICE") + " || ';qty=' || QUANTITY || ';sku=' || SKU"
)
SQL["C35"] = f"""
    WITH st AS (SELECT PRODUCT_ID, string_agg(t, '|' ORDER BY place) AS inventory FROM (
                  SELECT PRODUCT_ID, 0 AS place, {_STOCKTEXT} AS t FROM pstock UNION ALL SELECT PRODUCT_ID, VARIANT_ID, {_STOCKTEXT} FROM vstock) GROUP BY 1),
    att AS (SELECT PRODUCT_ID, string_agg(OPTION_CODE || '=' || VALUE_NAME, ';' ORDER BY OPTION_CODE) AS attributes FROM product_attribute GROUP BY 1),
    va AS (SELECT PRODUCT_ID, string_agg(OPTION_CODE || '=' || VALUE_CODE || ';vsku=' || SKU, '|' ORDER BY VARIANT_ID) AS variants FROM product_variant GROUP BY 1),
    im AS (SELECT * FROM product_image QUALIFY row_number() OVER (PARTITION BY PRODUCT_ID ORDER BY DEFAULT_IMAGE DESC, IMAGE_ID) = 1),
    ca AS (SELECT pc.PRODUCT_ID, c.NAME FROM product_category pc JOIN category c ON c.CATEGORY_ID = pc.CATEGORY_ID
           QUALIFY row_number() OVER (PARTITION BY pc.PRODUCT_ID ORDER BY pc.CATEGORY_ID) = 1),
    rv AS (SELECT PRODUCT_ID, sum(RATING) / count(RATING) AS r FROM review_latest GROUP BY 1)
    SELECT p.PRODUCT_ID AS id, 'default' AS store, n.LANGUAGE AS language, n.NAME AS name, n.SEF_URL AS link, m.NAME AS brand, ca.NAME AS category,
           att.attributes, st.inventory, va.variants, im.IMAGE AS image, rv.r AS reviews
    FROM product p JOIN product_description n ON n.PRODUCT_ID = p.PRODUCT_ID LEFT JOIN manufacturer m ON m.MANUFACTURER_ID = p.MANUFACTURER_ID
    LEFT JOIN ca ON ca.PRODUCT_ID = p.PRODUCT_ID LEFT JOIN att ON att.PRODUCT_ID = p.PRODUCT_ID LEFT JOIN st ON st.PRODUCT_ID = p.PRODUCT_ID
    LEFT JOIN va ON va.PRODUCT_ID = p.PRODUCT_ID LEFT JOIN im ON im.PRODUCT_ID = p.PRODUCT_ID LEFT JOIN rv ON rv.PRODUCT_ID = p.PRODUCT_ID"""
SQL["C36_terms"] = "SELECT 'default' AS store, language, id, term FROM name_term"
SQL["C36"] = "SELECT request_id, id, matched_terms FROM hit_rows"
SQL["C36_page"] = """
    SELECT request_id, id, matched_terms, place FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY matched_terms DESC, id) - 1 AS place FROM hit_rows)
    WHERE place >= length(request_id) % 3 * 4 AND place < length(request_id) % 3 * 4 + 3 + length(request_id) % 9"""
SQL["C36_suggest"] = """
    SELECT DISTINCT a.text AS request_id, n.NAME AS suggestion FROM ask_text a JOIN product_description n ON n.LANGUAGE = 'en'
      AND contains(lower(n.NAME), lower(a.text)) AND regexp_matches(lower(n.NAME), '(^|[^a-z0-9])' || split_part(lower(a.text), ' ', 1))"""
SQL["C36_suggest_some"] = f"SELECT * FROM ({SQL['C36_suggest']}) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY suggestion) <= 15"
SQL["C37"] = """
    SELECT h.request_id, c.CATEGORY_ID, count(*) AS hit_count FROM hit_rows h JOIN (SELECT DISTINCT PRODUCT_ID, CATEGORY_ID FROM product_category) c ON c.PRODUCT_ID = h.id
    GROUP BY 1, 2"""

SQL["F01_postal_code"] = "SELECT ORDER_ID, regexp_replace(POSTAL_CODE, '[^a-zA-Z0-9]', '', 'g') AS POSTAL_CODE FROM shop_order"
_DEC = "CAST(ROUND(CAST({} AS DECIMAL(28,8)), 2) AS DOUBLE)"
SQL["F02_units"] = f"""
    SELECT PRODUCT_ID, {_DEC.format('WEIGHT * 2.2')} AS POUNDS, {_DEC.format('CAST(WEIGHT AS DOUBLE) / 2.2')} AS KILOGRAMS, CAST(WEIGHT AS DOUBLE) AS SAME,
           {_DEC.format('LENGTH * 2.54')} AS INCHES_ASKED, {_DEC.format('LENGTH * 0.39')} AS CENTIMETRES_ASKED FROM product"""
SQL["F03_money_text"] = "SELECT PRODUCT_PRICE_ID, format('{:,.2f}', CAST(PRODUCT_PRICE_AMOUNT AS DOUBLE)) AS AMOUNT_TEXT FROM price_list"
