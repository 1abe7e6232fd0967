"""Oracle SQL for the validation checks."""

from souklens.oracle.base import r
from souklens.oracle.enrich import E_ORDERS
from souklens.plans.quality import V1_CHECKS, V49_CHECKS

W = "WITH " + E_ORDERS + ",\n"


def n(x: str) -> str:
    return f"format('{{:,}}', {x})"


def m2(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


def row(name: str, passed: str, detail: str, src: str) -> str:
    name = name.replace("'", "''")
    return f"SELECT '{name}' AS \"check\", CASE WHEN {passed} THEN 'PASS' ELSE 'FAIL' END AS status, {detail} AS detail FROM ({src}) z"


def uniq(table: str, key: str, name: str, rows_only: bool = False) -> str:
    det = f"'Rows: ' || {n('rows')}" if rows_only else f"{n('u')} || ' unique / ' || {n('rows')} || ' rows'"
    return row(name, "rows = u", det, f"SELECT count(*) AS rows, count(DISTINCT {key}) AS u FROM {table}")


def orphans(child: str, parent: str, key: str, name: str, fmt: str) -> str:
    src = f"SELECT count(*) AS k FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"
    return row(name, "k = 0", fmt.replace("%s", "' || " + n('k') + " || '").join(["'", "'"]), src)


V1 = [
    uniq("cl_customers", "customer_id", V1_CHECKS[0]),
    uniq("cl_orders", "order_id", V1_CHECKS[1]),
    uniq("cl_products", "product_id", V1_CHECKS[2]),
    uniq("cl_sellers", "seller_id", V1_CHECKS[3]),
    row(V1_CHECKS[4], "u = rows", f"{n('u')} || ' unique order_id / ' || {n('rows')} || ' rows'",
        "SELECT count(DISTINCT order_id) AS u, count(*) AS rows FROM cl_reviews"),
    orphans("cl_orders", "cl_customers", "customer_id", V1_CHECKS[5], "%s orphan orders"),
    orphans("cl_items", "cl_orders", "order_id", V1_CHECKS[6], "%s orphan items"),
    orphans("cl_items", "cl_products", "product_id", V1_CHECKS[7], "%s orphan items (product)"),
    orphans("cl_items", "cl_sellers", "seller_id", V1_CHECKS[8], "%s orphan items (seller)"),
    orphans("cl_payments", "cl_orders", "order_id", V1_CHECKS[9], "%s orphan payments"),
    uniq("e_oe", "order_id", V1_CHECKS[10]),
    row(V1_CHECKS[11], "a = b", f"'items_enriched=' || {n('a')} || ', order_items=' || {n('b')}",
        "SELECT (SELECT count(*) FROM e_items) AS a, (SELECT count(*) FROM cl_items) AS b"),
    row(V1_CHECKS[12], "abs(a - b) < 1.0",
        f"'order_items sum=R$' || {m2('a')} || ', enriched sum=R$' || {m2('b')} || ', diff=R$' || {m2('abs(a - b)')}",
        "SELECT coalesce(sum(price), 0) + coalesce(sum(freight_value), 0) AS a, "
        "(SELECT coalesce(sum(total_order_revenue), 0) FROM e_oe) AS b FROM cl_items"),
    row(V1_CHECKS[13], "true", "'timestamp_ntz'", "SELECT 1"),
    row(V1_CHECKS[14], "k = 0", f"{n('k')} || ' orders with negative delivery days'",
        "SELECT count(*) FILTER (WHERE delivery_seconds < 0) AS k FROM e_oe"),
]

DLV = "SELECT * FROM fact_orders WHERE order_status = 'delivered'"
V49 = [
    uniq("cl_customers", "customer_id", V49_CHECKS[0], True),
    uniq("cl_orders", "order_id", V49_CHECKS[1], True),
    uniq("cl_products", "product_id", V49_CHECKS[2], True),
    uniq("cl_sellers", "seller_id", V49_CHECKS[3], True),
    uniq("fact_orders", "order_id", V49_CHECKS[4], True),
    uniq("fact_sales", "(order_id, order_item_id)", V49_CHECKS[5], True),
    orphans("cl_items", "cl_orders", "order_id", V49_CHECKS[6], "Orphan rows: %s"),
    orphans("cl_payments", "cl_orders", "order_id", V49_CHECKS[7], "Orphan rows: %s"),
    orphans("cl_reviews", "cl_orders", "order_id", V49_CHECKS[8], "Orphan rows: %s"),
    orphans("fact_sales", "fact_orders", "order_id", V49_CHECKS[9], "Orphan rows: %s"),
    orphans("fact_orders", "dim_customer", "customer_id", V49_CHECKS[10], "Orphan rows: %s"),
    row(V49_CHECKS[11], "abs(a - b) < 0.01",
        f"'fact_orders=R$' || {m2('a')} || ', fact_sales=R$' || {m2('b')} || ', diff=R$' || {m2('abs(a - b)')}",
        f"SELECT (SELECT coalesce(sum(order_revenue), 0) FROM ({DLV}) d) AS a, "
        "(SELECT coalesce(sum(item_revenue), 0) FROM fact_sales WHERE order_status = 'delivered') AS b"),
    row(V49_CHECKS[12], "k = 0", f"'Mismatched delivered orders: ' || {n('k')}",
        f"SELECT count(*) FILTER (WHERE abs(coalesce(si, 0) - order_revenue) > 0.01) AS k FROM ({DLV}) d LEFT JOIN "
        "(SELECT order_id AS oid, sum(item_revenue) AS si FROM fact_sales WHERE order_status = 'delivered' GROUP BY 1) s ON s.oid = d.order_id"),
    row(V49_CHECKS[13], "abs(a - b) < 0.01", f"'fact_orders=R$' || {m2('a')} || ', order_payments=R$' || {m2('b')}",
        "SELECT (SELECT coalesce(sum(payment_total), 0) FROM fact_orders) AS a, (SELECT coalesce(sum(payment_value), 0) "
        "FROM cl_payments WHERE order_id IN (SELECT order_id FROM fact_orders)) AS b"),
]
CU = (f"SELECT count(*) AS n, CAST(count(*) FILTER (WHERE k > 1) AS DOUBLE) * 100.0 / NULLIF(CAST(count(*) AS DOUBLE), 0) AS rate FROM "
      f"(SELECT dc.customer_unique_id, count(DISTINCT d.order_id) AS k FROM ({DLV}) d JOIN dim_customer dc ON dc.customer_id = d.customer_id GROUP BY 1) x")
K = ("SELECT count(*) AS n, CAST(sum(delivery_seconds) AS DOUBLE) / (count(delivery_seconds) * 86400.0) AS days, "
     f"count(*) FILTER (WHERE is_delayed = 1) AS late, coalesce(sum(order_revenue), 0) AS rev FROM ({DLV}) d")
V49 += [
    row(V49_CHECKS[14], "n > 0", f"'Customers: ' || {n('n')}", CU),
    row(V49_CHECKS[15], "coalesce(rate >= 0 AND rate <= 100, false)",
        f"'Repeat rate: ' || format('{{:.2f}}', {r('coalesce(rate, 0.0)')}) || '%'", CU),
    row(V49_CHECKS[16], "n > 0", f"'Delivered orders: ' || {n('n')}", K),
    row(V49_CHECKS[17], "coalesce(days >= 0, false)",
        f"'Average delivery: ' || format('{{:.2f}}', {r('coalesce(days, 0.0)')}) || ' days'", K),
    row(V49_CHECKS[18], "late >= 0 AND late <= n", f"'Delayed: ' || {n('late')}", K),
    row(V49_CHECKS[19], "bad = 0", "'Distinct quarters: ' || CAST(nq AS VARCHAR)",
        f"SELECT count(*) FILTER (WHERE quarter(order_purchase_timestamp) NOT BETWEEN 1 AND 4) AS bad, "
        f"count(DISTINCT quarter(order_purchase_timestamp)) AS nq FROM ({DLV}) d"),
    row(V49_CHECKS[20], "n > 0", n('n'), K),
    row(V49_CHECKS[21], "rev > 0", f"'R$ ' || {m2('rev')}", K),
    row(V49_CHECKS[22], "coalesce(rev / n > 0, false)", f"'R$ ' || {m2(r('coalesce(CAST(rev AS DOUBLE) / n, 0.0)'))}", K),
]

TABLES = {"customers": "cl_customers", "orders": "cl_orders", "order_items": "cl_items", "order_payments": "cl_payments",
          "order_reviews": "cl_reviews", "products": "cl_products", "sellers": "cl_sellers", "geolocation": "cl_geo",
          "geolocation_zip": "cl_geo_zip", "category_translation": "cl_translation", "fact_orders": "fact_orders",
          "fact_sales": "fact_sales", "dim_customer": "dim_customer", "dim_product": "dim_product", "dim_seller": "dim_seller",
          "dim_date": "dim_date", "dim_geography": "dim_geography"}
EXTRA = """cl_geo_zip AS (SELECT geolocation_zip_code_prefix, avg(geolocation_lat) AS geolocation_lat, avg(geolocation_lng) AS geolocation_lng,
  min(geolocation_city) AS geolocation_city, min(geolocation_state) AS geolocation_state FROM cl_geo
  WHERE geolocation_zip_code_prefix IS NOT NULL GROUP BY 1),
dim_date AS (SELECT DISTINCT CAST(order_purchase_timestamp AS DATE) AS date FROM cl_orders WHERE order_purchase_timestamp IS NOT NULL),
dim_geography AS (SELECT customer_zip_code_prefix AS zip_code_prefix, customer_city AS city, customer_state AS state FROM cl_customers
  UNION SELECT seller_zip_code_prefix, seller_city, seller_state FROM cl_sellers)
"""
COLS = {"customers": 5, "orders": 8, "order_items": 7, "order_payments": 6, "order_reviews": 8, "products": 9, "sellers": 4,
        "geolocation": 5, "geolocation_zip": 5, "category_translation": 2, "fact_orders": 27, "fact_sales": 22, "dim_customer": 8,
        "dim_product": 10, "dim_seller": 9, "dim_date": 6, "dim_geography": 3}

RAW_COLS = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
               "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"],
    "order_payments": ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"],
    "order_reviews": ["review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
                      "review_creation_date", "review_answer_timestamp"],
    "products": ["product_id", "product_category_name", "product_name_lenght", "product_description_lenght", "product_photos_qty",
                 "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"],
    "category_translation": ["product_category_name", "product_category_name_english"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state"],
}

QUALITY_SQL = {
    "v01_post_clean_validation": W + "q AS (" + "\nUNION ALL ".join(V1) + ") SELECT * FROM q",
    "v04_v09_warehouse_checks": "WITH q AS (" + "\nUNION ALL ".join(V49) + ") SELECT * FROM q",
    "v02_v03_table_checks": "WITH " + EXTRA + "\nSELECT * FROM (" + "\nUNION ALL ".join(
        f"SELECT 'Table exists: {t}' AS \"check\", 'PASS' AS status, 'found' AS detail UNION ALL SELECT 'Row count: {t}', "
        f"if(count(*) > 0, 'PASS', 'FAIL'), count(*) || ' rows, expected at least 1' FROM {v}" for t, v in TABLES.items()) + ") z",
    "v11_table_inventory": "WITH " + EXTRA + "\nSELECT * FROM (" + "\nUNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, {COLS[t]} AS columns, CAST(NULL AS BIGINT) AS bytes FROM {v}" for t, v in TABLES.items()) + ") z",
    "v14_orders_without_children": """SELECT o.order_status, count(*) AS orders,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM fx_order_items i WHERE i.order_id = o.order_id)) AS without_items,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM fx_order_payments p WHERE p.order_id = o.order_id)) AS without_payments,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM fx_order_reviews r WHERE r.order_id = o.order_id)) AS without_reviews
FROM fx_orders o GROUP BY 1""",
    "v14_null_counts": "SELECT * FROM (" + "\nUNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows FROM fx_{t}"
        for t, cols in RAW_COLS.items() for c in cols) + ") z",
}


def _spot() -> str:
    from souklens.oracle.base import avg_, pct as _pct

    items = [
        ("total_orders", "(SELECT count(*) FROM e_oe)"),
        ("delivered_orders", "(SELECT count(*) FILTER (WHERE order_status = 'delivered') FROM e_oe)"),
        ("unique_customers", "(SELECT count(DISTINCT customer_unique_id) FROM e_cust)"),
        ("repeat_buyers", "(SELECT count(*) FILTER (WHERE is_repeat_buyer) FROM e_cust)"),
        ("repeat_pct", "(SELECT " + r(_pct("count(*) FILTER (WHERE is_repeat_buyer)", "count(*)")) + " FROM e_cust)"),
        ("total_revenue_all_items", "(SELECT round(sum(item_revenue), 2) FROM e_items)"),
        ("revenue_delivered", "(SELECT round(sum(item_revenue) FILTER (WHERE order_status = 'delivered'), 2) FROM e_items)"),
        ("avg_order_value", "(SELECT " + r(avg_("CASE WHEN order_status = 'delivered' THEN total_order_revenue END")) + " FROM e_oe)"),
        ("avg_review_score", "(SELECT " + r(avg_("review_score"), 4) + " FROM cl_reviews)"),
        ("avg_delivery_days", "(SELECT " + r("CAST(sum(delivery_seconds) AS DOUBLE) / (count(delivery_seconds) * 86400.0)") + " FROM e_oe)"),
        ("late_rate_pct", "(SELECT " + r(_pct("count(*) FILTER (WHERE is_delayed = 1)", "count(is_delayed)")) + " FROM e_oe)"),
        ("dup_orders_enriched", "(SELECT count(*) - count(DISTINCT order_id) FROM e_oe)"),
        ("dup_customer_analytics", "(SELECT count(*) - count(DISTINCT customer_unique_id) FROM e_cust)"),
        ("dup_product_analytics", "(SELECT count(*) - count(DISTINCT product_id) FROM e_prod)"),
        ("dup_seller_analytics", "(SELECT count(*) - count(DISTINCT seller_id) FROM e_sell)"),
        ("dup_order_reviews", "(SELECT count(*) - count(DISTINCT order_id) FROM cl_reviews)"),
        ("double_count_diff", "(SELECT round(abs(coalesce((SELECT sum(total_order_revenue) FROM e_oe), 0) "
                              "- coalesce((SELECT sum(item_revenue) FROM e_items), 0)), 2))"),
    ]
    return W + "q AS (" + "\nUNION ALL ".join(f"SELECT '{n}' AS \"check\", CAST({e} AS DOUBLE) AS value" for n, e in items) + ") SELECT * FROM q"


QUALITY_SQL["v12_spot_checks"] = _spot()


def _repeats(name: str, table: str, cols: list[str]) -> str:
    return (f"SELECT '{name}' AS what, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) - count(*) AS BIGINT) AS repeats, "
            f"count(*) FILTER (WHERE n > 1) AS repeated_values, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_involved "
            f"FROM (SELECT count(*) AS n FROM fx_{table} GROUP BY {', '.join(cols)}) z")


QUALITY_SQL["v14_duplicates"] = "SELECT * FROM (" + " UNION ALL ".join(
    [_repeats(t, t, cols) for t, cols in RAW_COLS.items()]
    + [_repeats(f"order_reviews.{c}", "order_reviews", [c]) for c in ("review_id", "order_id")]) + ") z"

NUMERIC = {"customers": ["customer_zip_code_prefix"], "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"],
           "order_items": ["order_item_id", "price", "freight_value"],
           "order_payments": ["payment_sequential", "payment_installments", "payment_value"], "order_reviews": ["review_score"],
           "products": [c for c in RAW_COLS["products"] if c.startswith("product_") and c not in ("product_id", "product_category_name")],
           "sellers": ["seller_zip_code_prefix"]}
QUALITY_SQL["v14_outliers"] = "WITH v AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS tab, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM fx_{t} WHERE {c} IS NOT NULL" for t, cols in NUMERIC.items() for c in cols
) + f"""), q AS (SELECT tab, col, {r('quantile_cont(v, 0.25)', 6)} AS q1, {r('quantile_cont(v, 0.5)', 6)} AS median, {r('quantile_cont(v, 0.75)', 6)} AS q3
  FROM v GROUP BY ALL),
f AS (SELECT *, {r('q1 - 1.5 * (q3 - q1)', 6)} AS low_fence, {r('q3 + 1.5 * (q3 - q1)', 6)} AS high_fence FROM q)
SELECT tab AS "table", col AS "column", q1, median, q3, low_fence, high_fence, count(*) AS n,
  count(*) FILTER (WHERE {r('v', 6)} < low_fence) AS below, count(*) FILTER (WHERE {r('v', 6)} > high_fence) AS above
FROM v JOIN f USING (tab, col) GROUP BY ALL"""


def _lists() -> str:
    from souklens.oracle.base import m, pct as _pct

    def gap(name: str, expr: str, table: str) -> str:
        return f"SELECT 'enriched tables' AS list, '{name}' AS key, CAST(({expr}) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS share FROM {table}"

    return W + f"""c AS (SELECT product_category_name_english AS key, sum(item_revenue) AS v FROM e_items WHERE order_status = 'delivered'
  AND product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY v DESC, key LIMIT 5),
st AS (SELECT customer_state AS key, coalesce(sum(total_order_revenue), 0) AS v FROM e_oe WHERE order_status = 'delivered'
  AND customer_state IS NOT NULL GROUP BY 1 ORDER BY v DESC, key LIMIT 5),
p AS (SELECT payment_type AS key, count(*) AS n FROM cl_payments WHERE payment_type IS NOT NULL GROUP BY 1),
q AS (SELECT 'top categories' AS list, key, {m('v')} AS value, CAST(NULL AS DOUBLE) AS share FROM c
UNION ALL SELECT 'top states', key, {m('v')}, NULL FROM st
UNION ALL SELECT 'payment mix', key, CAST(n AS DOUBLE), {r(_pct('n', '(SELECT sum(n) FROM p)'), 1)} FROM p
UNION ALL """ + " UNION ALL ".join([
        gap("first purchase", "epoch(min(order_purchase_timestamp))", "e_oe"), gap("last purchase", "epoch(max(order_purchase_timestamp))", "e_oe"),
        gap("least delivery days", r("min(delivery_days)"), "e_oe"), gap("most delivery days", r("max(delivery_days)"), "e_oe"),
        gap("negative delivery days", "count(*) FILTER (WHERE delivery_days < 0)", "e_oe"),
        gap("orders without revenue", "count(*) FILTER (WHERE total_order_revenue IS NULL)", "e_oe"),
        gap("items without category", "count(*) FILTER (WHERE product_category_name_english IS NULL)", "e_items"),
        gap("items uncategorised", "count(*) FILTER (WHERE product_category_name_english = 'Unknown / Uncategorized')", "e_items")]) + ") SELECT * FROM q"


QUALITY_SQL["v12_spot_lists"] = _lists()
