"""Oracle SQL for the enriched tables E1-E5, plus the shared ``e_*`` CTEs the
analysis oracles build on."""

from souklens.oracle.base import avg_

E_ORDERS = """
e_pay AS (SELECT order_id, sum(payment_value) AS total_payment_value,
  string_agg(DISTINCT payment_type, '|' ORDER BY payment_type) AS payment_methods,
  max(payment_installments) AS max_installments, count(payment_sequential) AS n_payment_rows FROM cl_payments GROUP BY order_id),
e_it AS (SELECT order_id, count(order_item_id) AS item_count, sum(price) AS product_revenue, sum(freight_value) AS freight_revenue
  FROM cl_items GROUP BY order_id),
e_orders AS (SELECT o.*, c.customer_unique_id, c.customer_state, c.customer_city, c.customer_zip_code_prefix,
  pay.total_payment_value, pay.payment_methods, pay.max_installments, pay.n_payment_rows,
  it.item_count, it.product_revenue, it.freight_revenue, it.product_revenue + it.freight_revenue AS total_order_revenue,
  CAST(year(o.order_purchase_timestamp) AS INTEGER) AS order_year, CAST(month(o.order_purchase_timestamp) AS INTEGER) AS order_month,
  strftime(o.order_purchase_timestamp, '%Y-%m') AS order_year_month,
  CAST(year(o.order_purchase_timestamp) AS VARCHAR) || 'Q' || CAST(quarter(o.order_purchase_timestamp) AS VARCHAR) AS order_quarter,
  dayname(o.order_purchase_timestamp) AS order_day_of_week, CAST(weekofyear(o.order_purchase_timestamp) AS INTEGER) AS order_week,
  date_diff('second', o.order_purchase_timestamp, o.order_delivered_customer_date) AS delivery_seconds,
  date_diff('second', o.order_purchase_timestamp, o.order_estimated_delivery_date) AS estimated_seconds,
  date_diff('second', o.order_estimated_delivery_date, o.order_delivered_customer_date) AS delay_seconds,
  date_diff('second', o.order_purchase_timestamp, o.order_approved_at) AS approval_seconds
  FROM cl_orders o LEFT JOIN cl_customers c ON c.customer_id = o.customer_id LEFT JOIN e_pay pay ON pay.order_id = o.order_id
  LEFT JOIN e_it it ON it.order_id = o.order_id),
e_oe AS (SELECT *, delivery_seconds / 86400.0 AS delivery_days, estimated_seconds / 86400.0 AS estimated_delivery_days,
  delay_seconds / 86400.0 AS delivery_delay_days,
  CASE WHEN delay_seconds IS NULL THEN NULL WHEN delay_seconds > 0 THEN 1 ELSE 0 END AS is_delayed,
  approval_seconds / 3600.0 AS approval_hours FROM e_orders),
e_items AS (SELECT it.*, o.order_status, o.order_purchase_timestamp, o.order_delivered_customer_date, o.order_estimated_delivery_date,
  o.customer_id, p.product_category_name, p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm,
  t.product_category_name_english, s.seller_state, s.seller_city, it.price + it.freight_value AS item_revenue,
  strftime(o.order_purchase_timestamp, '%Y-%m') AS order_year_month
  FROM cl_items it LEFT JOIN cl_orders o ON o.order_id = it.order_id LEFT JOIN cl_products p ON p.product_id = it.product_id
  LEFT JOIN cl_translation t ON t.product_category_name = p.product_category_name LEFT JOIN cl_sellers s ON s.seller_id = it.seller_id),
e_oc AS (SELECT o.order_id, o.order_status, o.order_purchase_timestamp, c.customer_unique_id, c.customer_state, c.customer_city,
  pay.total_payment_value AS v, it.item_count AS n, rv.review_score
  FROM cl_orders o LEFT JOIN cl_customers c ON c.customer_id = o.customer_id LEFT JOIN e_pay pay ON pay.order_id = o.order_id
  LEFT JOIN e_it it ON it.order_id = o.order_id LEFT JOIN cl_reviews rv ON rv.order_id = o.order_id
  WHERE c.customer_unique_id IS NOT NULL),
e_place AS (SELECT customer_unique_id, customer_state, customer_city FROM (SELECT *, row_number() OVER (
  PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp NULLS LAST, order_id NULLS LAST) AS rn FROM e_oc) x WHERE rn = 1),
e_cust AS (SELECT a.*, pl.customer_state, pl.customer_city, a.total_orders >= 2 AS is_repeat_buyer,
  CAST(a.total_spend_payment AS DOUBLE) / a.total_orders AS avg_order_value FROM (
  SELECT customer_unique_id, count(order_id) AS total_orders, count(*) FILTER (WHERE order_status = 'delivered') AS delivered_orders,
  min(order_purchase_timestamp) AS first_order_date, max(order_purchase_timestamp) AS last_order_date,
  coalesce(sum(v), 0) AS total_spend_payment, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_items_bought,
  """ + avg_("review_score") + """ AS avg_review_score FROM e_oc GROUP BY customer_unique_id) a
  LEFT JOIN e_place pl ON pl.customer_unique_id = a.customer_unique_id),
e_dir AS (SELECT it.*, rv.review_score FROM cl_items it LEFT JOIN cl_reviews rv ON rv.order_id = it.order_id
  WHERE it.order_id IN (SELECT order_id FROM cl_orders WHERE order_status = 'delivered')),
e_prod AS (SELECT a.*, a.total_product_revenue + a.total_freight_revenue AS total_revenue, p.product_category_name, p.product_weight_g,
  p.product_length_cm, p.product_height_cm, p.product_width_cm, t.product_category_name_english FROM (
  SELECT product_id, count(order_item_id) AS units_sold, sum(price) AS total_product_revenue, sum(freight_value) AS total_freight_revenue,
  """ + avg_("price") + """ AS avg_unit_price, """ + avg_("freight_value") + """ AS avg_freight,
  """ + avg_("review_score") + """ AS avg_review_score, count(DISTINCT order_id) AS n_unique_orders FROM e_dir GROUP BY product_id) a
  LEFT JOIN cl_products p ON p.product_id = a.product_id LEFT JOIN cl_translation t ON t.product_category_name = p.product_category_name),
e_sx AS (SELECT d.*, t.product_category_name_english FROM e_dir d LEFT JOIN cl_products p ON p.product_id = d.product_id
  LEFT JOIN cl_translation t ON t.product_category_name = p.product_category_name),
e_smode AS (SELECT seller_id, cat FROM (SELECT seller_id, product_category_name_english AS cat,
  row_number() OVER (PARTITION BY seller_id ORDER BY count(*) DESC, product_category_name_english) AS rn
  FROM e_sx WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2) x WHERE rn = 1),
e_sell AS (SELECT a.*, coalesce(md.cat, 'unknown') AS top_category, a.total_product_revenue + a.total_freight_revenue AS total_revenue,
  s.seller_state, s.seller_city FROM (
  SELECT seller_id, count(order_item_id) AS total_items_sold, sum(price) AS total_product_revenue, sum(freight_value) AS total_freight_revenue,
  """ + avg_("price") + """ AS avg_item_price, """ + avg_("freight_value") + """ AS avg_freight_value,
  """ + avg_("review_score") + """ AS avg_review_score, count(DISTINCT order_id) AS n_unique_orders,
  count(DISTINCT product_id) AS n_unique_products FROM e_sx GROUP BY seller_id) a
  LEFT JOIN e_smode md ON md.seller_id = a.seller_id LEFT JOIN cl_sellers s ON s.seller_id = a.seller_id)
"""

E1_COLS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
           "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
           "customer_unique_id", "customer_state", "customer_city", "customer_zip_code_prefix", "total_payment_value",
           "payment_methods", "max_installments", "n_payment_rows", "item_count", "product_revenue", "freight_revenue",
           "total_order_revenue", "order_year", "order_month", "order_year_month", "order_quarter", "order_day_of_week",
           "order_week", "delivery_days", "estimated_delivery_days", "delivery_delay_days", "is_delayed", "approval_hours"]
E2_COLS = ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value",
           "order_status", "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date",
           "customer_id", "product_category_name", "product_weight_g", "product_length_cm", "product_height_cm",
           "product_width_cm", "product_category_name_english", "seller_state", "seller_city", "item_revenue",
           "order_year_month"]
E3_COLS = ["customer_unique_id", "customer_state", "customer_city", "total_orders", "delivered_orders", "first_order_date",
           "last_order_date", "total_spend_payment", "total_items_bought", "avg_review_score", "is_repeat_buyer",
           "avg_order_value"]
E4_COLS = ["product_id", "units_sold", "total_product_revenue", "total_freight_revenue", "avg_unit_price", "avg_freight",
           "avg_review_score", "n_unique_orders", "total_revenue", "product_category_name", "product_weight_g",
           "product_length_cm", "product_height_cm", "product_width_cm", "product_category_name_english"]
E5_COLS = ["seller_id", "total_items_sold", "total_product_revenue", "total_freight_revenue", "avg_item_price",
           "avg_freight_value", "avg_review_score", "n_unique_orders", "n_unique_products", "top_category",
           "total_revenue", "seller_state", "seller_city"]

MONEY_COLS = {"total_payment_value", "product_revenue", "freight_revenue", "total_order_revenue", "price", "freight_value",
              "item_revenue", "total_spend_payment", "total_product_revenue", "total_freight_revenue", "total_revenue"}


def _sel(cols, table):
    return "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY_COLS else c for c in cols) + f" FROM {table}"


ENRICH_SQL = {
    "e1_orders_enriched": "WITH " + E_ORDERS + _sel(E1_COLS, "e_oe"),
    "e2_order_items_enriched": "WITH " + E_ORDERS + _sel(E2_COLS, "e_items"),
    "e3_customer_analytics": "WITH " + E_ORDERS + _sel(E3_COLS, "e_cust"),
    "e4_product_analytics": "WITH " + E_ORDERS + _sel(E4_COLS, "e_prod"),
    "e5_seller_analytics": "WITH " + E_ORDERS + _sel(E5_COLS, "e_sell"),
}
ENRICH_COLS = {"e1_orders_enriched": ("orders_enriched", E1_COLS), "e2_order_items_enriched": ("order_items_enriched", E2_COLS),
               "e3_customer_analytics": ("customer_analytics", E3_COLS), "e4_product_analytics": ("product_analytics", E4_COLS),
               "e5_seller_analytics": ("seller_analytics", E5_COLS)}
