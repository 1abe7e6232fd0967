"""Oracle SQL for the documented metrics."""

from souklens.oracle.base import avg_, avg_days, div, m, pct, r
from souklens.oracle.enrich import E_ORDERS

W = "WITH " + E_ORDERS + ",\n"
DLV = "order_status = 'delivered'"
DI = f"di AS (SELECT * FROM e_items WHERE {DLV}),\n"
IWO = DI + "iwo AS (SELECT di.*, o.customer_state, o.delivery_seconds, o.is_delayed AS o_delayed FROM di LEFT JOIN e_oe o ON o.order_id = di.order_id),\n"
PM = f"pm AS (SELECT DISTINCT customer_unique_id, order_year_month FROM e_oe WHERE {DLV} AND customer_unique_id IS NOT NULL AND order_year_month IS NOT NULL),\npf AS (SELECT customer_unique_id, min(order_year_month) AS f FROM pm GROUP BY 1),\n"


def share(cond: str) -> str:
    return pct(f"count(*) FILTER (WHERE coalesce({cond}, false))", "count(*)")


RANKS = """sr AS (SELECT seller_id, CAST(total_revenue AS DOUBLE) AS x,
  row_number() OVER (ORDER BY CAST(total_revenue AS DOUBLE), seller_id) AS rnk,
  sum(CAST(total_revenue AS DOUBLE)) OVER (ORDER BY CAST(total_revenue AS DOUBLE), seller_id ROWS UNBOUNDED PRECEDING) AS cum_x FROM e_sell),
"""

METRICS_SQL = {
    "m01_new_customers_per_month": W + PM + "x AS (SELECT f AS year_month, count(*) AS new_customers FROM pf GROUP BY 1) SELECT * FROM x",
    "m02_new_vs_returning": W + PM + """x AS (SELECT pm.order_year_month AS year_month, count(*) FILTER (WHERE pm.order_year_month = pf.f) AS new_customers,
  count(*) FILTER (WHERE pm.order_year_month > pf.f) AS returning_customers FROM pm JOIN pf ON pf.customer_unique_id = pm.customer_unique_id
  GROUP BY 1) SELECT * FROM x""",
    "m03_payment_averages": f"""SELECT {r(avg_('CASE WHEN payment_value <> 0 THEN payment_value END'))} AS avg_payment_nonzero,
  {r(avg_("CASE WHEN payment_type = 'credit_card' THEN payment_installments END"), 4)} AS avg_credit_card_installments FROM cl_payments""",
    "m04_voucher_and_multi_payment": f"""WITH per AS (SELECT order_id, max(CASE WHEN payment_type = 'voucher' THEN 1 ELSE 0 END) AS v,
  count(*) AS n FROM cl_payments GROUP BY 1)
SELECT {r(share('v = 1'))} AS voucher_order_pct, {r(share('n > 1'))} AS multi_payment_order_pct FROM per""",
    "m05_installments_vs_value": f"""SELECT payment_installments, count(*) AS payments, {r(avg_('payment_value'))} AS avg_payment_value,
  (SELECT {r('corr(CAST(payment_installments AS DOUBLE), CAST(payment_value AS DOUBLE))', 4)} FROM cl_payments
   WHERE payment_installments IS NOT NULL) AS installments_value_corr
FROM cl_payments WHERE payment_installments IS NOT NULL GROUP BY 1""",
    "m06_process_times": W + f"""x AS (SELECT {r(div('sum(approval_seconds)', 'count(approval_seconds) * 3600'), 4)} AS avg_approval_hours,
  {r(avg_days("date_diff('second', order_approved_at, order_delivered_carrier_date)"), 4)} AS avg_carrier_handoff_days FROM e_oe)
SELECT x.*, (SELECT {r(avg_days("date_diff('second', review_creation_date, review_answer_timestamp)"), 4)} FROM cl_reviews) AS avg_review_response_days FROM x""",
    "m07_same_vs_cross_state": W + IWO + f"""x AS (SELECT CASE WHEN customer_state = seller_state THEN 'same_state' ELSE 'cross_state' END AS route,
  count(*) AS items, count(DISTINCT order_id) AS orders, {r(avg_days('delivery_seconds'))} AS avg_delivery_days,
  {r(avg_('freight_value'))} AS avg_freight FROM iwo WHERE customer_state IS NOT NULL AND seller_state IS NOT NULL GROUP BY 1) SELECT * FROM x""",
    "m08_delivery_over_time": W + f"""x AS (SELECT order_year_month AS year_month, {r(avg_days('delivery_seconds'))} AS avg_delivery_days,
  {r(share('is_delayed = 0'))} AS on_time_pct FROM e_oe WHERE {DLV} AND delivery_seconds IS NOT NULL AND is_delayed IS NOT NULL GROUP BY 1)
SELECT * FROM x""",
    "m09_comment_rate_by_score": f"""SELECT review_score, count(*) AS reviews, {r(share('has_comment'))} AS comment_pct FROM cl_reviews
WHERE review_score IS NOT NULL GROUP BY 1""",
    "m10_weight_correlations": W + DI + f"""x AS (SELECT di.product_weight_g, di.freight_value, rv.review_score FROM di LEFT JOIN cl_reviews rv ON rv.order_id = di.order_id)
SELECT {r('corr(product_weight_g, CAST(freight_value AS DOUBLE))', 4)} AS weight_freight_corr,
  {r('corr(product_weight_g, CAST(review_score AS DOUBLE))', 4)} AS weight_review_corr FROM x""",
    "m11_seller_diversity": W + DI + """x AS (SELECT product_category_name_english AS category, count(DISTINCT seller_id) AS sellers FROM di
  WHERE product_category_name_english IS NOT NULL GROUP BY 1) SELECT * FROM x""",
    "m12_seller_gini": W + RANKS + f"""x AS (SELECT count(*) AS sellers, {r('2.0 * sum(rnk * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)', 4)} AS gini FROM sr)
SELECT * FROM x""",
    "m12_lorenz_curve": W + RANKS + """t AS (SELECT count(*) AS n, sum(x) AS tt FROM sr),
p AS (SELECT CAST(ceil(rnk * 20 / n) AS INTEGER) AS pt, max(rnk) AS rr, max(cum_x) AS cc, max(n) AS n, max(tt) AS tt FROM sr CROSS JOIN t GROUP BY 1)
SELECT pt, """ + r("rr * 100.0 / n") + " AS seller_pct, " + r("cc * 100.0 / tt") + " AS revenue_pct FROM p",
    "m13_freight_by_state": W + IWO + f"""x AS (SELECT customer_state, {r(avg_('freight_value'))} AS avg_freight,
  {r(pct('sum(freight_value)', 'sum(price)'))} AS freight_pct_of_price FROM iwo WHERE customer_state IS NOT NULL GROUP BY 1) SELECT * FROM x""",
    "m13_aov_by_city": W + f"""x AS (SELECT customer_state, customer_city, count(*) AS orders, {r(avg_('total_order_revenue'))} AS aov FROM e_oe
  WHERE {DLV} AND customer_city IS NOT NULL GROUP BY 1, 2) SELECT * FROM x""",
    "m13_aov_by_category": W + DI + f"""per AS (SELECT product_category_name_english AS category, order_id, sum(item_revenue) AS rr FROM di
  WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2)
SELECT category, count(*) AS orders, {r(avg_('rr'))} AS category_aov FROM per GROUP BY 1""",
    "m14_weekend_effect": W + f"""x AS (SELECT CASE WHEN dayofweek(o.order_purchase_timestamp) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type,
  count(*) AS orders, {r(avg_('o.total_order_revenue'))} AS aov, {r(avg_('rv.review_score'), 4)} AS avg_review_score
  FROM e_oe o LEFT JOIN cl_reviews rv ON rv.order_id = o.order_id WHERE o.{DLV} GROUP BY 1) SELECT * FROM x""",
    "m15_cancellation_by_category": W + f"""p AS (SELECT DISTINCT product_category_name_english AS category, order_id, order_status FROM e_items
  WHERE product_category_name_english IS NOT NULL)
SELECT category, count(*) AS orders, {r(share("order_status = 'canceled'"))} AS cancellation_pct FROM p GROUP BY 1""",
    "m16_seller_satisfaction": W + f"x AS (SELECT seller_id, n_unique_orders, {r('avg_review_score', 4)} AS avg_review_score FROM e_sell WHERE n_unique_orders >= 30) SELECT * FROM x",
    "m16_low_score_factors": W + f"""x AS (SELECT CASE WHEN rv.review_score <= 2 THEN 'low (1-2)' ELSE 'other (3-5)' END AS score_group, count(*) AS orders,
  {r(avg_days('o.delivery_seconds'))} AS avg_delivery_days, {r(share('o.is_delayed = 1'))} AS late_pct,
  {r(avg_('o.item_count'), 4)} AS avg_items, {r(avg_('o.total_order_revenue'))} AS aov
  FROM e_oe o JOIN cl_reviews rv ON rv.order_id = o.order_id WHERE o.{DLV} GROUP BY 1) SELECT * FROM x""",
    "m17_review_by_category_order_grain": W + DI + f"""p AS (SELECT DISTINCT product_category_name_english AS category, order_id FROM di
  WHERE product_category_name_english IS NOT NULL)
SELECT p.category, count(*) AS orders, {r(avg_('rv.review_score'), 4)} AS avg_review_score FROM p JOIN cl_reviews rv ON rv.order_id = p.order_id
GROUP BY 1""",
}
