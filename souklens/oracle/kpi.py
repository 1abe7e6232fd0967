"""Oracle SQL for K1-K5 and L1-L12."""

from souklens.oracle.base import avg_, avg_days, cnt, m, pct, r, share

CAT = "COALESCE(p.product_category_name_english, p.product_category_name, 'Unknown')"
DLV = "order_status = 'delivered'"

KPI_SQL = {
    "k1_kpi_summary": f"""
WITH d AS (SELECT * FROM fact_orders WHERE {DLV}),
co AS (SELECT dc.customer_unique_id, count(DISTINCT d.order_id) AS order_count FROM d
  JOIN dim_customer dc ON d.customer_id = dc.customer_id GROUP BY dc.customer_unique_id)
SELECT (SELECT count(*) FROM d) AS delivered_orders,
  (SELECT {m('sum(order_revenue)')} FROM d) AS total_revenue,
  (SELECT {r(avg_('order_revenue'))} FROM d) AS average_order_value,
  (SELECT count(*) FROM co) AS unique_customers,
  (SELECT count(*) FROM co WHERE order_count > 1) AS repeat_customers,
  (SELECT {r(pct(cnt('order_count > 1'), 'count(*)'))} FROM co) AS repeat_customer_rate,
  (SELECT {r(avg_days('delivery_seconds'))} FROM d) AS average_delivery_days,
  (SELECT {r(avg_days('estimated_seconds'))} FROM d) AS average_estimated_delivery_days,
  (SELECT {r(avg_days('delay_seconds'))} FROM d) AS average_delivery_delay_days,
  (SELECT count(*) FROM d WHERE is_delayed = 1) AS delayed_orders,
  (SELECT {r(share('is_delayed = 1'))} FROM d) AS delayed_order_rate""",

    "k2_monthly_performance": f"""
SELECT order_year_month, count(*) AS orders, {m('sum(order_revenue)')} AS revenue,
  {r(avg_('order_revenue'))} AS average_order_value FROM fact_orders WHERE {DLV} GROUP BY order_year_month""",

    "k3_category_performance": f"""
SELECT {CAT} AS category, count(DISTINCT fs.order_id) AS orders, count(*) AS items_sold, {m('sum(fs.item_revenue)')} AS revenue
FROM fact_sales fs LEFT JOIN dim_product p ON fs.product_id = p.product_id WHERE fs.{DLV} GROUP BY 1""",

    "k4_state_performance": f"""
SELECT dc.customer_state, count(DISTINCT fo.order_id) AS orders, {m('sum(fo.order_revenue)')} AS revenue,
  {r(avg_('fo.order_revenue'))} AS average_order_value
FROM fact_orders fo JOIN dim_customer dc ON fo.customer_id = dc.customer_id WHERE fo.{DLV} GROUP BY dc.customer_state""",

    "k5_payment_performance": f"""
SELECT primary_payment_type AS payment_type, count(*) AS orders, {m('sum(payment_total)')} AS payment_value,
  {r(avg_('payment_total'))} AS average_payment_value FROM fact_orders WHERE {DLV} GROUP BY primary_payment_type""",

    "l01_validate_database": """
SELECT (SELECT count(*) FROM fact_orders) AS fact_orders, (SELECT count(*) FROM fact_sales) AS fact_sales,
  (SELECT count(*) FROM dim_customer) AS customers, (SELECT count(*) FROM dim_product) AS products,
  (SELECT count(*) FROM dim_seller) AS sellers""",

    "l02_kpis": f"""
SELECT count(*) AS total_orders, count(CASE WHEN {DLV} THEN 1 END) AS delivered_orders,
  {m(f'sum(CASE WHEN {DLV} THEN order_revenue ELSE 0 END)')} AS total_revenue,
  {r(avg_(f'CASE WHEN {DLV} THEN order_revenue END'))} AS average_order_value,
  {r(avg_days(f'CASE WHEN {DLV} THEN delivery_seconds END'))} AS average_delivery_days,
  sum(CASE WHEN {DLV} AND is_delayed = 1 THEN 1 ELSE 0 END)::BIGINT AS delayed_orders,
  {r(pct(f'sum(CASE WHEN {DLV} AND is_delayed = 1 THEN 1 ELSE 0 END)', f'count(CASE WHEN {DLV} THEN 1 END)'))} AS delayed_rate
FROM fact_orders""",

    "l03_monthly_revenue": f"""
SELECT order_year_month, count(*) AS orders, {m(f'sum(CASE WHEN {DLV} THEN order_revenue ELSE 0 END)')} AS revenue,
  {r(avg_(f'CASE WHEN {DLV} THEN order_revenue END'))} AS average_order_value
FROM fact_orders GROUP BY order_year_month""",

    "l04_category_revenue": f"""
SELECT {CAT} AS category, count(DISTINCT s.order_id) AS orders, count(*) AS items, {m('sum(s.item_revenue)')} AS revenue
FROM fact_sales s LEFT JOIN dim_product p ON s.product_id = p.product_id WHERE s.{DLV}
GROUP BY 1 ORDER BY sum(s.item_revenue) DESC, category LIMIT 20""",

    "l05_state_revenue": f"""
SELECT dc.customer_state AS state, count(DISTINCT fo.order_id) AS orders,
  {m(f'sum(CASE WHEN fo.{DLV} THEN fo.order_revenue ELSE 0 END)')} AS revenue,
  {r(avg_(f'CASE WHEN fo.{DLV} THEN fo.order_revenue END'))} AS average_order_value
FROM fact_orders fo LEFT JOIN dim_customer dc ON fo.customer_id = dc.customer_id GROUP BY dc.customer_state""",

    "l06_payment_performance": f"""
SELECT op.payment_type, count(DISTINCT op.order_id) AS orders, {m('sum(op.payment_value)')} AS revenue,
  {r(avg_('op.payment_value'))} AS average_payment_value
FROM cl_payments op JOIN fact_orders fo ON op.order_id = fo.order_id WHERE fo.{DLV} GROUP BY op.payment_type""",

    "l07_delivery_performance": f"""
SELECT count(CASE WHEN {DLV} THEN 1 END) AS delivered_orders,
  {r(avg_days(f'CASE WHEN {DLV} THEN delivery_seconds END'))} AS average_delivery_days,
  {r(avg_days(f'CASE WHEN {DLV} THEN estimated_seconds END'))} AS average_estimated_days,
  {r(avg_days(f'CASE WHEN {DLV} THEN delay_seconds END'))} AS average_delay_days,
  sum(CASE WHEN {DLV} AND is_delayed = 1 THEN 1 ELSE 0 END)::BIGINT AS delayed_orders,
  {r(pct(f'sum(CASE WHEN {DLV} AND is_delayed = 1 THEN 1 ELSE 0 END)', f'count(CASE WHEN {DLV} THEN 1 END)'))} AS delayed_rate
FROM fact_orders""",

    "l08_customer_metrics": f"""
WITH co AS (SELECT dc.customer_unique_id, count(DISTINCT fo.order_id) AS order_count,
  sum(CASE WHEN fo.{DLV} THEN fo.order_revenue ELSE 0 END) AS revenue
  FROM fact_orders fo JOIN dim_customer dc ON fo.customer_id = dc.customer_id GROUP BY dc.customer_unique_id)
SELECT count(*) AS total_customers, sum(CASE WHEN order_count = 1 THEN 1 ELSE 0 END)::BIGINT AS one_time_customers,
  sum(CASE WHEN order_count > 1 THEN 1 ELSE 0 END)::BIGINT AS repeat_customers,
  {r(pct('sum(CASE WHEN order_count > 1 THEN 1 ELSE 0 END)', 'count(*)'))} AS repeat_customer_rate,
  {m('sum(revenue)')} AS customer_revenue FROM co""",

    "l09_seller_performance": f"""
SELECT seller_id, count(DISTINCT order_id) AS orders, count(*) AS items, {m('sum(item_revenue)')} AS revenue
FROM fact_sales WHERE {DLV} GROUP BY seller_id ORDER BY sum(item_revenue) DESC, seller_id LIMIT 20""",

    "l10_product_performance": f"""
SELECT fs.product_id, {CAT} AS category, count(DISTINCT fs.order_id) AS orders, count(*) AS items,
  {m('sum(fs.item_revenue)')} AS revenue
FROM fact_sales fs LEFT JOIN dim_product p ON fs.product_id = p.product_id WHERE fs.{DLV}
GROUP BY fs.product_id, 2 ORDER BY sum(fs.item_revenue) DESC, fs.product_id, category LIMIT 20""",

    "l11_review_performance": """
SELECT review_score, count(*) AS reviews FROM fact_orders WHERE review_score IS NOT NULL GROUP BY review_score""",

    "l12_filter_options": f"""
SELECT DISTINCT 'state' AS option, customer_state AS value FROM dim_customer WHERE customer_state IS NOT NULL
UNION SELECT DISTINCT 'category', {CAT} FROM dim_product p
UNION SELECT DISTINCT 'payment_type', primary_payment_type FROM fact_orders WHERE primary_payment_type IS NOT NULL
UNION SELECT DISTINCT 'year', CAST(order_year AS VARCHAR) FROM fact_orders WHERE order_year IS NOT NULL""",
}
