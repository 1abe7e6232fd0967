"""Oracle SQL for the delivery analytics."""

from souklens.oracle.base import avg_days, pct, r
from souklens.oracle.eda import bucket_sql, hist_sql
from souklens.oracle.enrich import E_ORDERS

W = "WITH " + E_ORDERS + ",\n"
HD = "hd AS (SELECT * FROM e_oe WHERE order_status = 'delivered' AND delivery_seconds IS NOT NULL),\nhy AS (SELECT * FROM hd WHERE is_delayed IS NOT NULL),\n"
IWD = ("iwd AS (SELECT i.order_id, i.seller_state, i.product_category_name_english, d.delivery_seconds, d.is_delayed "
       "FROM e_items i LEFT JOIN hd d ON d.order_id = i.order_id WHERE i.order_status = 'delivered'),\n")
LATE = "count(*) FILTER (WHERE is_delayed = 1)"
PAGE = ([-300, -14, -7, -3, 0, 3, 7, 14, 300],
        ["Early >14d", "Early 8-14d", "Early 3-7d", "Early ≤3d", "Late ≤3d", "Late 3-7d", "Late 7-14d", "Late >14d"])
SD = ("sd AS (SELECT customer_state AS state, " + avg_days("delivery_seconds") + " AS d, count(*) AS orders FROM hd "
      "WHERE customer_state IS NOT NULL GROUP BY 1 HAVING count(*) >= 100)\n")

DELIVERY_SQL = {
    "x10_delivery_kpis": W + HD + f"""k AS (SELECT {pct(LATE, 'count(*)')} AS late,
  {r(avg_days('CASE WHEN is_delayed = 1 THEN delay_seconds END'))} AS avg_delay_when_late FROM hy)
SELECT (SELECT {r(avg_days('delivery_seconds'))} FROM hd) AS avg_delivery_days,
  (SELECT {r('quantile_cont(delivery_seconds, 0.5) / 86400.0')} FROM hd) AS median_delivery_days,
  (SELECT {r('quantile_cont(delivery_seconds, 0.9) / 86400.0')} FROM hd) AS p90_delivery_days,
  {r('late')} AS late_rate_pct, {r('100.0 - late')} AS on_time_rate_pct, avg_delay_when_late FROM k""",
    "x11_delivery_by_state": W + HD + SD + f"SELECT state, {r('d')} AS avg_days, orders FROM sd",
    "x11_delivery_gap": W + HD + SD + f""", f AS (SELECT * FROM sd ORDER BY d, state LIMIT 1), s AS (SELECT * FROM sd ORDER BY d DESC, state DESC LIMIT 1)
SELECT f.state AS fastest_state, {r('f.d')} AS fastest_days, s.state AS slowest_state, {r('s.d')} AS slowest_days,
  {r('s.d - f.d')} AS gap_days FROM f CROSS JOIN s""",
    "x12_late_rate_by_state": W + HD + f"""x AS (SELECT customer_state AS state, {pct(LATE, 'count(*)')} AS rr FROM hy
  WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY rr DESC, state LIMIT 15)
SELECT state, {r('rr')} AS late_rate_pct FROM x""",
    "x13_days_late_histogram": W + HD + "h AS (" + hist_sql("SELECT least(delivery_delay_days, 30.0) AS x FROM hy WHERE is_delayed = 1", 30, "days_late") + ") SELECT * FROM h",
    "x14_delay_buckets": W + HD + f"""b AS (SELECT bucket, count(*) AS orders FROM (SELECT {bucket_sql('delivery_delay_days', *PAGE)} AS bucket FROM hy) z
  WHERE bucket IS NOT NULL GROUP BY 1)
SELECT bucket, orders, {r(pct('orders', '(SELECT sum(orders) FROM b)'))} AS pct FROM b""",
    "x15_delivery_by_seller_state": W + HD + IWD + f"""x AS (SELECT seller_state, {r(avg_days('delivery_seconds'))} AS avg_del,
  count(DISTINCT order_id) AS n_orders, {r(pct(LATE, 'count(*)'))} AS late_rate FROM iwd WHERE seller_state IS NOT NULL GROUP BY 1)
SELECT * FROM x WHERE n_orders >= 50""",
    "x16_monthly_delivery": W + HD + f"""x AS (SELECT order_year_month AS ym_str, {r(avg_days('delivery_seconds'))} AS avg_del,
  {r(pct(LATE, 'count(*)'))} AS late_rate, count(order_id) AS n_orders FROM hd GROUP BY 1) SELECT * FROM x""",
    "x17_slowest_categories": W + HD + IWD + f"""x AS (SELECT product_category_name_english AS category, {avg_days('delivery_seconds')} AS d,
  count(DISTINCT order_id) AS n_orders FROM iwd WHERE product_category_name_english IS NOT NULL GROUP BY 1 HAVING count(DISTINCT order_id) >= 500)
SELECT category, {r('d')} AS avg_del, n_orders FROM x ORDER BY d DESC, category LIMIT 15""",
}
