"""Oracle SQL for the rule-based opportunity rows (O7) and their counts."""

from souklens.oracle.base import avg_, avg_days, pct, r
from souklens.oracle.enrich import E_ORDERS

DLV = "order_status = 'delivered'"


def f0(x: str) -> str:
    return f"format('{{:,.0f}}', {r(x, 0)})"


def f2(x: str) -> str:
    return f"format('{{:.2f}}', {r(x, 2)})"


def f1(x: str) -> str:
    return f"format('{{:.1f}}', {r(x, 1)})"


OPP_CTES = "WITH " + E_ORDERS + f""",
iwr AS (SELECT i.*, rv.review_score FROM e_items i LEFT JOIN cl_reviews rv ON rv.order_id = i.order_id WHERE i.{DLV}),
ocat AS (SELECT product_category_name_english AS c, sum(item_revenue) AS revenue, {avg_('review_score')} AS avg_score,
  count(DISTINCT order_id) AS n_orders FROM iwr WHERE product_category_name_english IS NOT NULL GROUP BY 1
  HAVING count(DISTINCT order_id) >= 200),
o1 AS (SELECT * FROM ocat CROSS JOIN (SELECT {avg_('revenue')} AS avg_rev FROM ocat) a
  CROSS JOIN (SELECT {avg_('review_score')} AS all_score FROM iwr) b
  WHERE CAST(revenue AS DOUBLE) > avg_rev AND avg_score < all_score - 0.3 ORDER BY revenue DESC, c LIMIT 3),
cs AS (SELECT customer_state AS st, count(order_id) AS n_orders FROM e_oe WHERE {DLV} AND customer_state IS NOT NULL GROUP BY 1),
o2 AS (SELECT * FROM cs WHERE st NOT IN (SELECT seller_state FROM e_sell WHERE seller_state IS NOT NULL) AND n_orders >= 100
  ORDER BY n_orders DESC, st LIMIT 4),
ca AS (SELECT product_category_name_english AS c, count(order_item_id) AS n_items, {avg_('price')} AS avg_price FROM e_items
  WHERE {DLV} AND product_category_name_english IS NOT NULL GROUP BY 1 HAVING count(order_item_id) >= 500),
o3 AS (SELECT * FROM ca CROSS JOIN (SELECT quantile_cont(CAST(n_items AS DOUBLE), 0.75) AS p75 FROM ca) q
  CROSS JOIN (SELECT {avg_('price')} AS all_price FROM e_items WHERE {DLV}) a
  WHERE n_items > p75 AND avg_price < all_price * 0.5 ORDER BY n_items DESC, c LIMIT 2),
o4 AS (SELECT customer_state AS st, {pct("count(*) FILTER (WHERE is_delayed = 1)", "count(*)")} AS late_rate,
  count(order_id) AS n_orders, {avg_days('delay_seconds')} AS avg_delay FROM e_oe
  WHERE {DLV} AND is_delayed IS NOT NULL AND customer_state IS NOT NULL GROUP BY 1
  HAVING count(order_id) >= 200 AND {pct("count(*) FILTER (WHERE is_delayed = 1)", "count(*)")} > 15
  ORDER BY late_rate DESC, st LIMIT 3),
o5 AS (SELECT count(*) AS n, sum(total_revenue) AS at_risk FROM e_sell WHERE total_revenue > 10000 AND avg_review_score < 3.5),
pp AS (SELECT customer_unique_id, count(order_id) AS n FROM e_oe WHERE {DLV} AND customer_unique_id IS NOT NULL GROUP BY 1),
o6 AS (SELECT (SELECT {pct("count(*) FILTER (WHERE n > 1)", "count(*)")} FROM pp) AS rate,
  (SELECT {avg_('total_order_revenue')} FROM e_oe WHERE {DLV}) AS aov),
opp AS (
  SELECT 'Raise the quality of ''' || c || '''' AS title,
    'Sells for R$' || {f0('revenue')} || ' but scores ' || {f2('avg_score')} || ' of 5, ' || {f2('all_score - avg_score')}
      || ' below all items.' AS description,
    'Revenue R$' || {f0('revenue')} || ', score ' || {f2('avg_score')} AS metric_value,
    'Customer Satisfaction' AS category, 'High' AS priority FROM o1
  UNION ALL SELECT 'Find sellers in ' || st, 'Customers in ' || st || ' placed ' || {f0('n_orders')}
      || ' delivered orders, and no seller of that state delivered any.',
    'Orders ' || {f0('n_orders')} || ', sellers 0', 'Geographic Expansion', 'High' FROM o2
  UNION ALL SELECT 'Sell ''' || c || ''' in bundles',
    {f0('n_items')} || ' items at R$' || {f2('avg_price')} || ' each on average, where all items cost R$' || {f2('all_price')} || '.',
    'Items ' || {f0('n_items')} || ', average price R$' || {f2('avg_price')}, 'Revenue Growth', 'Medium' FROM o3
  UNION ALL SELECT 'Deliver on time in ' || st, {f1('late_rate')} || '% of the orders to ' || st || ' came late.',
    'Late ' || {f1('late_rate')} || '%, average delay ' || {f1('avg_delay')} || ' days', 'Logistics', 'High' FROM o4
  UNION ALL SELECT 'Help ' || CAST(n AS VARCHAR) || ' strong sellers with weak reviews',
    CAST(n AS VARCHAR) || ' sellers with more than R$10,000 score below 3.5; they stand for R$' || {f0('at_risk')} || '.',
    'Sellers ' || CAST(n AS VARCHAR) || ', revenue R$' || {f0('at_risk')}, 'Seller Management', 'High' FROM o5 WHERE n > 0
  UNION ALL SELECT 'Bring buyers back: ' || format('{{:.0f}}', {r('100.0 - rate', 0)}) || '% buy once',
    {f1('rate')} || '% of the customers order again; twice as many would add some R$' || {f0('aov * 2000')} || '.',
    'Repeat rate ' || {f1('rate')} || '%', 'Customer Retention', 'Critical' FROM o6)
"""

OPP_SQL = {
    "o7_opportunities": OPP_CTES + """SELECT *, CASE priority WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3
  WHEN 'Low' THEN 4 END AS priority_rank FROM opp""",
    "o8_opportunities_by_category": OPP_CTES + "SELECT category, count(*) AS opportunities FROM opp GROUP BY 1",
}
