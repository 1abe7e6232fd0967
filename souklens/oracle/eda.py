"""Oracle SQL for the exploratory analysis (A1-A24), over the ``e_*`` CTEs."""

from souklens.oracle.base import avg_, avg_days, div, m, pct, r
from souklens.oracle.enrich import E_ORDERS
from souklens.plans.eda import (DELAY_EDGES, DELAY_LABELS, DELIVERY_BIN_EDGES, DELIVERY_BIN_LABELS, FREIGHT_EDGES, FREIGHT_LABELS,
                                SEGMENT_LABELS)

W = "WITH " + E_ORDERS + ",\n"
DLV = "order_status = 'delivered'"


def bucket_sql(x: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'" for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {parts} END"


def hist_sql(src: str, bins: int, name: str) -> str:
    return f"""SELECT '{name}' AS histogram, bin, {r(f'lo + bin * (hi - lo) / {bins}', 4)} AS bin_start,
  {r(f'lo + (bin + 1) * (hi - lo) / {bins}', 4)} AS bin_end, count AS count FROM (
  SELECT CAST(least(floor((v - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, lo, hi, count(*) AS count
  FROM (SELECT x AS v FROM ({src}) s WHERE x IS NOT NULL) t CROSS JOIN (
    SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
           CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM ({src}) s2 WHERE x IS NOT NULL) rg
  GROUP BY 1, 2, 3) h"""


DEL_DAYS = f"SELECT * FROM e_oe WHERE {DLV} AND delivery_seconds IS NOT NULL"
DEL_ITEMS = f"SELECT * FROM e_items WHERE {DLV}"
DEL_REVIEWED = f"SELECT d.*, rv.review_score FROM ({DEL_DAYS}) d JOIN cl_reviews rv ON rv.order_id = d.order_id"
ITEMS_REVIEWED = f"SELECT i.*, rv.review_score FROM ({DEL_ITEMS}) i JOIN cl_reviews rv ON rv.order_id = i.order_id"

DELAY, FREIGHT, DBIN = (DELAY_EDGES, DELAY_LABELS), (FREIGHT_EDGES, FREIGHT_LABELS), (DELIVERY_BIN_EDGES, DELIVERY_BIN_LABELS)
CORR = ["delivery_days", "delivery_delay_days", "total_order_revenue", "item_count", "freight_revenue", "review_score"]
_MANY, _TWO, _HIGH, _ONE = SEGMENT_LABELS
SEG = f"""CASE WHEN total_orders >= 3 THEN '{_MANY}' WHEN total_orders = 2 THEN '{_TWO}'
  WHEN total_spend_payment >= 500 THEN '{_HIGH}' ELSE '{_ONE}' END"""


def _corr_sql() -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CORR)
    src = f"SELECT {cols} FROM ({DEL_REVIEWED}) z WHERE total_order_revenue IS NOT NULL"
    rows = []
    for i, a in enumerate(CORR):
        for b in CORR[i:]:
            rows.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {r(f'corr({a}, {b})', 4)} AS r FROM cs")
            if a != b:
                rows.append(f"SELECT '{b}', '{a}', {r(f'corr({a}, {b})', 4)} FROM cs")
    return W + f"cs AS ({src})\n" + "\nUNION ALL ".join(rows)


def _score_bucket(src: str, bucket: str, n: str) -> str:
    return f"""SELECT bucket, {r(avg_('review_score'), 3)} AS avg_score, count(review_score) AS {n}
FROM (SELECT *, {bucket} AS bucket FROM ({src}) s) t WHERE bucket IS NOT NULL GROUP BY bucket"""


EDA_SQL = {
    "a01_descriptive": W + f"""
o AS (SELECT count(*) AS total_orders, count(*) FILTER (WHERE {DLV}) AS delivered_orders,
  count(*) FILTER (WHERE order_status = 'canceled') AS canceled_orders, min(order_purchase_timestamp) AS mn,
  max(order_purchase_timestamp) AS mx FROM e_oe),
c AS (SELECT count(DISTINCT customer_unique_id) AS total_unique_customers, count(*) FILTER (WHERE is_repeat_buyer) AS repeat_buyers FROM e_cust)
SELECT total_orders, delivered_orders, canceled_orders, total_unique_customers, repeat_buyers,
  {r(pct('repeat_buyers', 'total_unique_customers'))} AS repeat_buyer_rate_pct,
  (SELECT count(*) FROM e_prod) AS total_products_in_analytics, (SELECT count(*) FROM e_sell) AS total_active_sellers,
  strftime(mn, '%Y-%m-%d') AS date_min, CAST(floor(date_diff('second', mn, mx) / 86400) AS BIGINT) AS date_span_days
FROM o CROSS JOIN c""",

    "a02_status_distribution": W + f"""
c AS (SELECT order_status, count(*) AS orders FROM e_oe WHERE order_status IS NOT NULL GROUP BY 1)
SELECT order_status, orders, {r(pct('orders', '(SELECT sum(orders) FROM c)'))} AS pct_of_orders FROM c""",

    "a03_payment_types": f"""
WITH c AS (SELECT payment_type, count(*) AS payment_rows, {r(avg_('payment_value'))} AS avg_payment_value
  FROM cl_payments WHERE payment_type IS NOT NULL GROUP BY 1)
SELECT payment_type, payment_rows, avg_payment_value, {r(pct('payment_rows', '(SELECT sum(payment_rows) FROM c)'))} AS pct_of_rows FROM c""",

    "a04_review_distribution": f"""
WITH c AS (SELECT review_score, count(*) AS reviews FROM cl_reviews WHERE review_score IS NOT NULL GROUP BY 1)
SELECT review_score, reviews, {r(pct('reviews', '(SELECT sum(reviews) FROM c)'))} AS pct_of_reviews,
  (SELECT {r(avg_('review_score'), 4)} FROM cl_reviews) AS avg_review_score FROM c""",

    "a05_business_kpis": W + f"""
di AS (SELECT sum(item_revenue) AS rev, sum(price) AS prod, sum(freight_value) AS fr, {r(avg_('freight_value'))} AS avg_freight_per_item
  FROM e_items WHERE {DLV}),
oa AS (SELECT count(*) AS total_orders, count(*) FILTER (WHERE {DLV}) AS delivered_orders,
  {r(avg_(f'CASE WHEN {DLV} THEN total_order_revenue END'))} AS avg_order_value,
  {r(avg_(f'CASE WHEN {DLV} THEN item_count END'), 4)} AS avg_items_per_order,
  {r(pct("count(*) FILTER (WHERE order_status = 'canceled')", 'count(*)'))} AS cancellation_rate_pct,
  {r(avg_days(f'CASE WHEN {DLV} AND delivery_seconds IS NOT NULL THEN delivery_seconds END'))} AS avg_delivery_days,
  {pct(f'count(*) FILTER (WHERE {DLV} AND delivery_seconds IS NOT NULL AND is_delayed = 1)', f'count(*) FILTER (WHERE {DLV} AND delivery_seconds IS NOT NULL AND is_delayed IS NOT NULL)')} AS late,
  {r(avg_days(f'CASE WHEN {DLV} AND delivery_seconds IS NOT NULL AND is_delayed = 1 THEN delay_seconds END'))} AS avg_delay_when_late_days
  FROM e_oe)
SELECT total_orders, delivered_orders, {m('rev')} AS total_revenue_brl, {m('prod')} AS product_revenue_brl, {m('fr')} AS freight_revenue_brl,
  {r(pct('fr', 'rev'))} AS freight_pct_of_revenue, avg_order_value, avg_items_per_order, avg_freight_per_item, cancellation_rate_pct,
  (SELECT {r(pct('count(*) FILTER (WHERE is_repeat_buyer)', 'count(*)'))} FROM e_cust) AS repeat_buyer_rate_pct,
  (SELECT {r(avg_('review_score'), 4)} FROM cl_reviews) AS avg_review_score, avg_delivery_days,
  {r('100.0 - late')} AS on_time_delivery_rate, {r('late')} AS late_delivery_rate, avg_delay_when_late_days,
  (SELECT count(*) FROM e_cust) AS total_unique_customers, (SELECT count(*) FROM e_sell) AS active_sellers
FROM di CROSS JOIN oa""",

    "a06_monthly_revenue": W + f"""
rv AS (SELECT order_year_month, sum(item_revenue) AS revenue FROM e_items WHERE {DLV} GROUP BY 1),
n AS (SELECT order_year_month, count(order_id) AS n_orders FROM e_oe WHERE {DLV} GROUP BY 1)
SELECT coalesce(rv.order_year_month, n.order_year_month) AS year_month, {m('rv.revenue')} AS revenue, n.n_orders,
  {r(div('rv.revenue', 'n.n_orders'))} AS aov
FROM rv FULL OUTER JOIN n ON rv.order_year_month = n.order_year_month
WHERE coalesce(rv.order_year_month, n.order_year_month) IS NOT NULL""",

    "a06_monthly_summary": W + f"""
rv AS (SELECT order_year_month, sum(item_revenue) AS revenue FROM e_items WHERE {DLV} GROUP BY 1),
n AS (SELECT order_year_month, count(order_id) AS n_orders FROM e_oe WHERE {DLV} GROUP BY 1),
mm AS (SELECT coalesce(rv.order_year_month, n.order_year_month) AS ym, rv.revenue, n.n_orders
  FROM rv FULL OUTER JOIN n ON rv.order_year_month = n.order_year_month WHERE coalesce(rv.order_year_month, n.order_year_month) IS NOT NULL)
SELECT (SELECT ym FROM mm WHERE revenue IS NOT NULL ORDER BY revenue DESC, ym LIMIT 1) AS peak_revenue_month,
  (SELECT {m('max(revenue)')} FROM mm) AS peak_revenue_value,
  (SELECT ym FROM mm WHERE n_orders IS NOT NULL ORDER BY n_orders DESC, ym LIMIT 1) AS peak_orders_month,
  (SELECT max(n_orders) FROM mm) AS peak_orders_value,
  (SELECT {r(avg_('revenue'))} FROM mm) AS avg_monthly_revenue, (SELECT {r(avg_('n_orders'))} FROM mm) AS avg_monthly_orders""",

    "a07_top_categories_revenue": W + f"""
x AS (SELECT product_category_name_english AS category, sum(item_revenue) AS v FROM e_items
  WHERE {DLV} AND product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY v DESC, category LIMIT 15)
SELECT category, {m('v')} AS revenue FROM x""",

    "a08_top_categories_volume": W + f"""
x AS (SELECT product_category_name_english AS category, count(order_id) AS items_sold FROM e_items
  WHERE {DLV} AND product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY items_sold DESC, category LIMIT 15)
SELECT * FROM x""",

    "a09_seller_concentration": W + f"""
t AS (SELECT sum(total_revenue) AS top FROM (SELECT total_revenue FROM e_sell ORDER BY total_revenue DESC, seller_id LIMIT 10) z)
SELECT count(*) AS total_active_sellers, {m('max(total_revenue)')} AS top_seller_revenue,
  {r('median(CAST(total_revenue AS DOUBLE))')} AS median_seller_revenue,
  {r(pct('(SELECT top FROM t)', 'sum(total_revenue)'))} AS top_10_sellers_pct_of_total_revenue,
  count(DISTINCT seller_state) AS states_with_sellers FROM e_sell""",

    "a09_top_sellers": W + """
a AS (SELECT 'revenue' AS ranking, seller_id, seller_state, CAST(total_revenue AS DOUBLE) AS value FROM e_sell
  ORDER BY total_revenue DESC, seller_id LIMIT 15),
b AS (SELECT 'orders' AS ranking, seller_id, seller_state, CAST(n_unique_orders AS DOUBLE) AS value FROM e_sell
  ORDER BY n_unique_orders DESC, seller_id LIMIT 15)
SELECT * FROM a UNION ALL SELECT * FROM b""",

    "a10_revenue_by_seller_state": W + f"""
x AS (SELECT seller_state, {m('sum(total_revenue)')} AS total_revenue FROM e_sell WHERE seller_state IS NOT NULL GROUP BY 1)
SELECT * FROM x""",

    "a11_customers_by_state": W + f"""
c AS (SELECT customer_state, count(customer_unique_id) AS n_customers, {r(avg_('total_spend_payment'))} AS avg_spend
  FROM e_cust WHERE customer_state IS NOT NULL GROUP BY 1),
rv AS (SELECT customer_state, {m('sum(total_order_revenue)')} AS total_revenue FROM e_oe
  WHERE {DLV} AND customer_state IS NOT NULL GROUP BY 1)
SELECT c.*, rv.total_revenue FROM c LEFT JOIN rv ON rv.customer_state = c.customer_state""",

    "a12_order_frequency": W + f"""
c AS (SELECT total_orders, count(*) AS customers FROM e_cust GROUP BY 1)
SELECT total_orders, customers, {r(pct('customers', '(SELECT sum(customers) FROM c)'))} AS pct_of_customers FROM c""",

    "a13_customer_segments": W + f"""
x AS (SELECT {SEG} AS segment, count(customer_unique_id) AS n_customers, {r(avg_('total_spend_payment'))} AS avg_spend,
  {r(avg_('total_orders'), 4)} AS avg_orders FROM e_cust GROUP BY 1)
SELECT * FROM x""",

    "a14_logistics": W + f"""
d AS ({DEL_DAYS}),
o AS (SELECT {r(avg_days('delivery_seconds'))} AS avg_delivery_days,
  {r('quantile_cont(delivery_seconds, 0.5) / 86400.0')} AS median_delivery_days,
  {r('quantile_cont(delivery_seconds, 0.9) / 86400.0')} AS p90_delivery_days,
  {r(pct('count(*) FILTER (WHERE is_delayed = 1)', 'count(*)'))} AS late_rate_pct,
  {r(avg_days('CASE WHEN is_delayed = 1 THEN delay_seconds END'))} AS avg_delay_when_late FROM d),
i AS (SELECT {r(avg_('freight_value'))} AS avg_freight_per_item, {r('median(CAST(freight_value AS DOUBLE))')} AS median_freight
  FROM e_items WHERE {DLV})
SELECT * FROM o CROSS JOIN i""",

    "a15_delivery_by_state": W + f"""
x AS (SELECT customer_state AS state, {r(avg_days('delivery_seconds'))} AS avg_days, count(*) AS n_orders
  FROM ({DEL_DAYS}) d WHERE customer_state IS NOT NULL GROUP BY 1)
SELECT * FROM x WHERE n_orders >= 200""",

    "a16_freight_pct_by_category": W + f"""
x AS (SELECT product_category_name_english AS category, median({pct('freight_value', 'price')}) AS md
  FROM e_items WHERE {DLV} AND product_category_name_english IS NOT NULL GROUP BY 1)
SELECT category, {r('md')} AS median_freight_pct FROM x WHERE md IS NOT NULL ORDER BY md DESC, category LIMIT 12""",

    "a17_freight_price_corr": W + f"""
x AS (SELECT {r('corr(CAST(price AS DOUBLE), CAST(freight_value AS DOUBLE))', 4)} AS freight_price_correlation FROM e_items WHERE {DLV})
SELECT * FROM x""",

    "a17_freight_price_sample": W + f"""
x AS (SELECT order_id, order_item_id, CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value FROM e_items
  WHERE {DLV} AND price <= 1000
  ORDER BY md5(CAST(order_id AS VARCHAR) || '|' || CAST(order_item_id AS VARCHAR) || '|42'), order_id, order_item_id LIMIT 8000)
SELECT * FROM x""",

    "a18_review_by_category": W + f"""
c AS (SELECT product_category_name_english AS category, {avg_('review_score')} AS s, count(DISTINCT order_id) AS n_orders
  FROM ({ITEMS_REVIEWED}) z WHERE product_category_name_english IS NOT NULL GROUP BY 1 HAVING count(DISTINCT order_id) >= 200),
lo AS (SELECT 'lowest' AS position, category, {r('s', 3)} AS avg_score, n_orders FROM c ORDER BY s, category LIMIT 5),
hi AS (SELECT 'highest' AS position, category, {r('s', 3)} AS avg_score, n_orders FROM c ORDER BY s DESC, category DESC LIMIT 5)
SELECT * FROM lo UNION ALL SELECT * FROM hi""",

    "a19_review_by_delay_bucket": W + "q AS (" + _score_bucket(DEL_REVIEWED, bucket_sql('delivery_delay_days', *DELAY), 'n_orders') + ") SELECT * FROM q",

    "a20_ontime_vs_late": W + f"""
d AS (SELECT *, CASE WHEN is_delayed = 1 THEN 'late' ELSE 'on_time' END AS delivery FROM ({DEL_REVIEWED}) z
  WHERE is_delayed IS NOT NULL AND review_score IS NOT NULL),
c AS (SELECT delivery, review_score, count(*) AS orders FROM d GROUP BY 1, 2),
t AS (SELECT delivery, count(*) AS tt, {avg_('review_score')} AS mm FROM d GROUP BY 1),
dl AS (SELECT {avg_('CASE WHEN is_delayed = 1 THEN review_score END')} - {avg_('CASE WHEN is_delayed = 0 THEN review_score END')} AS dd FROM d)
SELECT c.delivery, c.review_score, c.orders, {r(pct('c.orders', 't.tt'))} AS pct_of_group, {r('t.mm', 4)} AS avg_score,
  {r('dl.dd', 4)} AS score_delta_late_vs_ontime FROM c JOIN t ON t.delivery = c.delivery CROSS JOIN dl""",

    "a21_review_by_freight_bucket": W + "q AS (" + _score_bucket(ITEMS_REVIEWED, bucket_sql('freight_value', *FREIGHT), 'n_items') + ") SELECT * FROM q",

    "a22_correlation_matrix": _corr_sql(),

    "a23_review_by_delivery_bin": W + "q AS (" + _score_bucket(DEL_REVIEWED, bucket_sql('delivery_days', *DBIN), 'n_orders') + ") SELECT * FROM q",

    "a24_histograms": W + "h1 AS (" + hist_sql(f"SELECT least(delivery_days, 60.0) AS x FROM ({DEL_DAYS}) a", 50, "delivery_days")
    + "), h2 AS (" + hist_sql(f"SELECT least(CAST(freight_value AS DOUBLE), 80.0) AS x FROM ({DEL_ITEMS}) b", 60, "freight_value")
    + ") SELECT * FROM h1 UNION ALL SELECT * FROM h2",
}
