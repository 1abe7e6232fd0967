"""Oracle SQL for the growth series."""

from souklens.oracle.base import avg_, div, m, pct, r
from souklens.oracle.enrich import E_ORDERS

W = "WITH " + E_ORDERS + ",\n"
DLV = "order_status = 'delivered'"

MONTHLY = W + f"""
mr AS (SELECT order_year_month AS ym, sum(item_revenue) AS revenue FROM e_items WHERE {DLV} GROUP BY 1),
mo AS (SELECT order_year_month AS ym, count(order_id) AS n_orders FROM e_oe WHERE {DLV} GROUP BY 1),
mm AS (SELECT coalesce(mr.ym, mo.ym) AS ym_str, CAST(mr.revenue AS DOUBLE) AS revenue, CAST(mo.n_orders AS DOUBLE) AS n_orders,
  {div('mr.revenue', 'mo.n_orders')} AS aov FROM mr FULL OUTER JOIN mo ON mr.ym = mo.ym WHERE coalesce(mr.ym, mo.ym) IS NOT NULL),
mf AS (SELECT *, {', '.join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY ym_str ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}_f" for c in ('revenue', 'n_orders', 'aov'))} FROM mm),
mg AS (SELECT *, {', '.join(f"({div(f'{c}_f', f'lag({c}_f) OVER (ORDER BY ym_str)')} - 1.0) * 100.0 AS {c}_mom" for c in ('revenue', 'n_orders', 'aov'))} FROM mf),
gr AS (SELECT *, CASE WHEN revenue_mom IS NULL THEN 'normal' WHEN revenue_mom >= 20.0 THEN 'strong_growth'
  WHEN revenue_mom <= -20.0 THEN 'decline' ELSE 'normal' END AS rev_flag FROM mg)
"""

GROWTH_SQL = {
    "w10_monthly_growth": MONTHLY + f"""SELECT ym_str, {r('revenue')} AS revenue, CAST(n_orders AS BIGINT) AS n_orders, {r('aov')} AS aov,
  {r('revenue_mom')} AS rev_mom_pct, {r('n_orders_mom')} AS orders_mom_pct, {r('aov_mom')} AS aov_mom_pct, rev_flag FROM gr""",
    "w11_category_trend": W + f"""top AS (SELECT product_category_name_english AS c FROM e_items WHERE {DLV} AND product_category_name_english IS NOT NULL
  GROUP BY 1 ORDER BY sum(item_revenue) DESC, 1 LIMIT 10)
SELECT order_year_month AS ym_str, product_category_name_english AS category, {m('sum(item_revenue)')} AS revenue
FROM e_items WHERE {DLV} AND product_category_name_english IN (SELECT c FROM top) GROUP BY 1, 2""",
    "w12_state_trend": W + f"""top AS (SELECT customer_state AS s FROM e_oe WHERE {DLV} AND customer_state IS NOT NULL
  GROUP BY 1 ORDER BY sum(total_order_revenue) DESC NULLS LAST, 1 LIMIT 8)
SELECT order_year_month AS ym_str, customer_state AS state, {m('coalesce(sum(total_order_revenue), 0)')} AS revenue
FROM e_oe WHERE {DLV} AND customer_state IN (SELECT s FROM top) GROUP BY 1, 2""",
    "w13_growth_headline": MONTHLY + f""", rk AS (SELECT *, row_number() OVER (ORDER BY ym_str) AS rn, count(*) OVER () AS n FROM gr)
SELECT (SELECT ym_str FROM rk WHERE revenue IS NOT NULL ORDER BY revenue DESC, ym_str LIMIT 1) AS peak_month,
  {r('max(revenue)')} AS peak_revenue, {r(avg_('revenue'))} AS avg_revenue,
  {r(pct('max(CASE WHEN rn = n THEN revenue END) - max(CASE WHEN rn = 2 THEN revenue END)', 'max(CASE WHEN rn = 2 THEN revenue END)'))} AS total_growth_pct,
  count(*) FILTER (WHERE rev_flag = 'strong_growth') AS strong_growth_months FROM rk""",
    "w14_rolling_revenue": MONTHLY + f"""SELECT ym_str, {m('CAST(revenue AS DECIMAL(38,2))')} AS revenue,
  {r(div('sum(revenue) OVER w', 'count(revenue) OVER w'))} AS rolling_revenue
FROM mm WINDOW w AS (ORDER BY ym_str ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
}
