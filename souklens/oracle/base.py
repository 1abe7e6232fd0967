"""DuckDB oracle: the model rebuilt in plain SQL, independent of the jobs.

``compose(q)`` prefixes a query with the CTE chain fixture views → cleaned
tables (``cl_*``) → warehouse (``o_*`` facts and dims) → enriched tables
(``e_*``).  A query may start with its own ``WITH``; its CTEs are appended.
Only CTEs a query references are evaluated by DuckDB.
"""

from __future__ import annotations

from souklens.sources.fixtures import duckdb_fixture_ctes


def r(x: str, n: int = 2) -> str:
    """Round half-up on the decimal value; DOUBLE result."""
    return f"CAST(ROUND(CAST(CAST(({x}) AS DOUBLE) AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def m(x: str) -> str:
    """DECIMAL money to DOUBLE cents."""
    return f"CAST(ROUND(({x}), 2) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(CAST(({a}) AS DOUBLE) / NULLIF(CAST(({b}) AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return div(f"CAST(({a}) AS DOUBLE) * 100.0", b)


def avg_(x: str) -> str:
    return div(f"sum({x})", f"count({x})")


def avg_days(sec: str) -> str:
    return div(f"sum({sec})", f"count({sec}) * 86400")


def share(cond: str) -> str:
    return pct(f"count(*) FILTER (WHERE {cond})", "count(*)")


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def secs(a: str, b: str) -> str:
    return f"date_diff('second', {a}, {b})"


CLEAN_CTES = """
cl_customers AS (SELECT customer_id, customer_unique_id, customer_zip_code_prefix,
  lower(trim(customer_city)) AS customer_city, upper(trim(customer_state)) AS customer_state FROM fx_customers),
cl_orders AS (SELECT * FROM fx_orders),
cl_items AS (SELECT * FROM fx_order_items),
cl_payments AS (SELECT order_id, payment_sequential,
  CASE WHEN payment_type = 'not_defined' THEN 'unknown' ELSE payment_type END AS payment_type,
  CASE WHEN payment_type = 'credit_card' AND payment_installments = 0 THEN 1 ELSE payment_installments END AS payment_installments,
  payment_value, coalesce(payment_value = 0, false) AS is_zero_payment FROM fx_order_payments),
rv_ranked AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY review_answer_timestamp DESC NULLS LAST, review_id) AS rn
  FROM fx_order_reviews),
cl_reviews AS (SELECT review_id, order_id, review_score, coalesce(review_comment_title, '') AS review_comment_title,
  coalesce(review_comment_message, '') AS review_comment_message, review_creation_date, review_answer_timestamp,
  length(coalesce(review_comment_message, '')) > 0 AS has_comment FROM rv_ranked WHERE rn = 1),
cl_products AS (SELECT product_id, coalesce(product_category_name, 'unknown') AS product_category_name,
  product_name_lenght AS product_name_length, product_description_lenght AS product_description_length, product_photos_qty,
  CASE WHEN product_weight_g = 0 THEN NULL ELSE product_weight_g END AS product_weight_g,
  product_length_cm, product_height_cm, product_width_cm FROM fx_products),
cl_sellers AS (SELECT seller_id, seller_zip_code_prefix, lower(trim(seller_city)) AS seller_city,
  upper(trim(seller_state)) AS seller_state FROM fx_sellers),
cl_translation AS (SELECT product_category_name, product_category_name_english FROM fx_category_translation
  UNION ALL SELECT * FROM (VALUES ('pc_gamer', 'PC Gamer'),
   ('portateis_cozinha_e_preparadores_de_alimentos', 'Portable Kitchen & Food Preparers'),
   ('unknown', 'Unknown / Uncategorized')) v(product_category_name, product_category_name_english)),
cl_geo AS (SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, lower(trim(geolocation_city)) AS geolocation_city,
  upper(trim(geolocation_state)) AS geolocation_state FROM (SELECT DISTINCT * FROM fx_geolocation)
  WHERE NOT coalesce(geolocation_lat < -35.0 OR geolocation_lat > 5.5 OR geolocation_lng < -74.0 OR geolocation_lng > -28.0, false))
"""

STAR_CTES = """
o_orders AS (SELECT *, delivery_seconds / 86400.0 AS delivery_days, estimated_seconds / 86400.0 AS estimated_delivery_days,
  delay_seconds / 86400.0 AS delivery_delay_days, CASE WHEN delay_seconds > 0 THEN 1 ELSE 0 END AS is_delayed,
  CAST(year(order_purchase_timestamp) AS INTEGER) AS order_year, strftime(order_purchase_timestamp, '%Y-%m') AS order_year_month
  FROM (SELECT *, date_diff('second', order_purchase_timestamp, order_delivered_customer_date) AS delivery_seconds,
    date_diff('second', order_purchase_timestamp, order_estimated_delivery_date) AS estimated_seconds,
    date_diff('second', order_estimated_delivery_date, order_delivered_customer_date) AS delay_seconds FROM cl_orders) x),
o_pay AS (SELECT order_id, sum(payment_value) AS payment_total, count(payment_value) AS payment_rows,
  max(payment_installments) AS installment_max, string_agg(DISTINCT payment_type, ', ' ORDER BY payment_type) AS payment_methods
  FROM cl_payments GROUP BY order_id),
o_pay_type AS (SELECT order_id, payment_type AS primary_payment_type FROM (
  SELECT order_id, payment_type, row_number() OVER (PARTITION BY order_id ORDER BY sum(payment_value) DESC NULLS LAST, payment_type) AS rn
  FROM cl_payments WHERE payment_type IS NOT NULL GROUP BY order_id, payment_type) t WHERE rn = 1),
o_items AS (SELECT order_id, count(order_item_id) AS item_count, sum(price) AS product_revenue, sum(freight_value) AS freight_revenue,
  sum(price) + sum(freight_value) AS order_revenue FROM cl_items GROUP BY order_id),
fact_orders AS (SELECT o.*, coalesce(i.item_count, 0) AS item_count, coalesce(i.product_revenue, 0) AS product_revenue,
  coalesce(i.freight_revenue, 0) AS freight_revenue, coalesce(i.order_revenue, 0) AS order_revenue,
  coalesce(p.payment_total, 0) AS payment_total, coalesce(p.payment_rows, 0) AS payment_rows,
  coalesce(p.installment_max, 0) AS installment_max, p.payment_methods, t.primary_payment_type, rv.review_score
  FROM o_orders o LEFT JOIN o_items i ON i.order_id = o.order_id LEFT JOIN o_pay p ON p.order_id = o.order_id
  LEFT JOIN o_pay_type t ON t.order_id = o.order_id LEFT JOIN cl_reviews rv ON rv.order_id = o.order_id),
fact_sales AS (SELECT it.*, o.customer_id, o.order_status, o.order_purchase_timestamp, o.order_delivered_customer_date,
  o.order_estimated_delivery_date, o.delivery_seconds, o.estimated_seconds, o.delay_seconds, o.delivery_days,
  o.estimated_delivery_days, o.delivery_delay_days, o.is_delayed, o.order_year, o.order_year_month,
  it.price + it.freight_value AS item_revenue FROM cl_items it LEFT JOIN o_orders o ON o.order_id = it.order_id),
dim_customer AS (SELECT c.*, x.order_count, x.first_order_date, x.last_order_date FROM cl_customers c LEFT JOIN
  (SELECT customer_id, count(DISTINCT order_id) AS order_count, min(order_purchase_timestamp) AS first_order_date,
   max(order_purchase_timestamp) AS last_order_date FROM cl_orders GROUP BY customer_id) x ON x.customer_id = c.customer_id),
dim_product AS (SELECT p.*, t.product_category_name_english FROM cl_products p
  LEFT JOIN cl_translation t ON t.product_category_name = p.product_category_name),
dim_seller AS (SELECT s.*, x.item_count, x.product_revenue, x.freight_revenue, x.order_count, x.gross_sales FROM cl_sellers s LEFT JOIN
  (SELECT seller_id, count(order_item_id) AS item_count, sum(price) AS product_revenue, sum(freight_value) AS freight_revenue,
   count(DISTINCT order_id) AS order_count, sum(price) + sum(freight_value) AS gross_sales FROM cl_items GROUP BY seller_id) x
  ON x.seller_id = s.seller_id)
"""


def compose(q: str) -> str:
    """Full oracle text for a query body."""
    head = "WITH " + duckdb_fixture_ctes() + ",\n" + CLEAN_CTES + ",\n" + STAR_CTES
    body = q.strip()
    if body[:4].upper() == "WITH":
        return head + ",\n" + body[4:]
    return head + "\n" + body
