"""Oracle SQL for RFM (R11-R15), cohorts/CLV (H1-H10) and the seller
scorecard (I1-I9)."""

from souklens.oracle.base import avg_, avg_days, m, pct, r
from souklens.oracle.eda import hist_sql
from souklens.oracle.enrich import E_ORDERS

W = "WITH " + E_ORDERS + ",\n"
DLV = "order_status = 'delivered'"
PROBS = "[0.0, 0.2, 0.4, 0.6, 0.8, 1.0]"


def qbin(x: str, q: str, mn: str, mx: str) -> str:
    """Quantile bin 1..5 with the equal-width fallback (DuckDB lists are 1-based)."""
    uniq = " AND ".join(f"{q}[{i}] < {q}[{i + 1}]" for i in range(1, 6))
    byq = f"CASE WHEN {x} <= {q}[2] THEN 1 WHEN {x} <= {q}[3] THEN 2 WHEN {x} <= {q}[4] THEN 3 WHEN {x} <= {q}[5] THEN 4 ELSE 5 END"
    st = f"(({mx} - {mn}) / 5.0)"
    byw = (f"CASE WHEN {mn} = {mx} THEN 3 WHEN {x} <= {mn} + {st} * 1 THEN 1 WHEN {x} <= {mn} + {st} * 2 THEN 2 "
           f"WHEN {x} <= {mn} + {st} * 3 THEN 3 WHEN {x} <= {mn} + {st} * 4 THEN 4 ELSE 5 END")
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {uniq} THEN {byq} ELSE {byw} END)"


def edges(col: str, i: int) -> str:
    v = f"CAST({col} AS DOUBLE)"
    return f"quantile_cont({v}, {PROBS}) AS q{i}, min({v}) AS mn{i}, max({v}) AS mx{i}"


SEGMENTS = ("(5,5,'Champions'),(5,4,'Champions'),(4,5,'Champions'),(4,4,'Loyal Customers'),(3,5,'Loyal Customers'),"
            "(3,4,'Loyal Customers'),(5,3,'Potential Loyalists'),(4,3,'Potential Loyalists'),(5,2,'Potential Loyalists'),"
            "(5,1,'New Customers'),(4,1,'New Customers'),(3,1,'Promising'),(3,2,'Promising'),(4,2,'Need Attention'),"
            "(3,3,'Need Attention'),(2,5,'At Risk'),(2,4,'At Risk'),(2,3,'At Risk'),(2,2,'At Risk'),"
            "(1,5,'Can''t Lose Them'),(1,4,'Can''t Lose Them'),(1,3,'Hibernating'),(1,2,'Hibernating'),"
            "(2,1,'Hibernating'),(1,1,'Lost')")

RFM_CTES = W + f"""
rd AS (SELECT * FROM e_oe WHERE {DLV} AND total_order_revenue IS NOT NULL AND customer_unique_id IS NOT NULL),
rper AS (SELECT customer_unique_id, max(order_purchase_timestamp) AS last_order_date, min(order_purchase_timestamp) AS first_order_date,
  count(order_id) AS frequency, sum(total_order_revenue) AS monetary FROM rd GROUP BY 1),
rpl AS (SELECT customer_unique_id, customer_state, customer_city FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id
  ORDER BY order_purchase_timestamp NULLS LAST, order_id NULLS LAST) AS rn FROM rd) z WHERE rn = 1),
rbase AS (SELECT p.*, CAST(floor(date_diff('second', p.last_order_date,
  (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY FROM rd)) / 86400) AS INTEGER) AS recency_days, pl.customer_state, pl.customer_city
  FROM rper p LEFT JOIN rpl pl ON pl.customer_unique_id = p.customer_unique_id),
red AS (SELECT {edges('recency_days', 0)}, {edges('frequency', 1)}, {edges('monetary', 2)} FROM rbase),
rsc AS (SELECT b.*, 6 - {qbin('CAST(recency_days AS DOUBLE)', 'q0', 'mn0', 'mx0')} AS R,
  {qbin('CAST(frequency AS DOUBLE)', 'q1', 'mn1', 'mx1')} AS F, {qbin('CAST(monetary AS DOUBLE)', 'q2', 'mn2', 'mx2')} AS M
  FROM rbase b CROSS JOIN red),
rseg AS (SELECT * FROM (VALUES {SEGMENTS}) v(sr, sf, segment)),
rfm AS (SELECT s.*, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS rfm_score,
  coalesce(g.segment, 'Hibernating') AS segment FROM rsc s LEFT JOIN rseg g ON g.sr = s.R AND g.sf = s.F)
"""

COHORT_CTES = W + f"""
pm AS (SELECT DISTINCT customer_unique_id, strftime(order_purchase_timestamp, '%Y-%m') AS ym,
  CAST(year(order_purchase_timestamp) * 12 + month(order_purchase_timestamp) AS INTEGER) AS mno
  FROM e_oe WHERE {DLV} AND order_purchase_timestamp IS NOT NULL AND customer_unique_id IS NOT NULL),
pf AS (SELECT customer_unique_id, min(ym) AS cohort_ym, min(mno) AS fm FROM pm GROUP BY 1),
cells AS (SELECT f.cohort_ym, pm.mno - f.fm AS period_number, count(*) AS n_customers FROM pm JOIN pf f
  ON f.customer_unique_id = pm.customer_unique_id GROUP BY 1, 2),
clong AS (SELECT c.*, s.n_customers AS cohort_size, {r(pct('c.n_customers', 's.n_customers'))} AS retention_pct
  FROM cells c JOIN cells s ON s.cohort_ym = c.cohort_ym AND s.period_number = 0),
pp AS (SELECT customer_unique_id, count(order_id) AS orders, coalesce(sum(total_order_revenue), 0) AS clv FROM e_oe
  WHERE {DLV} AND customer_unique_id IS NOT NULL GROUP BY 1)
"""

SELLER_CTES = W + f"""
spairs AS (SELECT DISTINCT order_id, seller_id FROM e_items WHERE {DLV}),
sdo AS (SELECT order_id, delivery_seconds, is_delayed FROM e_oe WHERE {DLV} AND delivery_seconds IS NOT NULL),
sdeliv AS (SELECT p.seller_id, {avg_days('d.delivery_seconds')} AS avg_delivery_days,
  {pct('count(*) FILTER (WHERE d.is_delayed = 1)', 'count(*)')} AS late_rate_pct, count(DISTINCT p.order_id) AS n_delivered
  FROM spairs p LEFT JOIN sdo d ON d.order_id = p.order_id GROUP BY 1),
srev AS (SELECT p.seller_id, {pct('count(*) FILTER (WHERE rv.review_score = 5)', 'count(*)')} AS pct_5star,
  {pct('count(*) FILTER (WHERE rv.review_score = 1)', 'count(*)')} AS pct_1star, count(rv.review_score) AS n_reviews
  FROM spairs p LEFT JOIN cl_reviews rv ON rv.order_id = p.order_id GROUP BY 1),
scust AS (SELECT i.seller_id, count(DISTINCT o.customer_unique_id) AS n_customers_served FROM e_items i
  LEFT JOIN e_oe o ON o.order_id = i.order_id WHERE i.{DLV} GROUP BY 1),
sbase AS (SELECT s.*, d.avg_delivery_days, d.late_rate_pct, d.n_delivered, v.pct_5star, v.pct_1star, v.n_reviews, c.n_customers_served,
  CAST(s.total_revenue AS DOUBLE) / NULLIF(CAST(s.n_unique_orders AS DOUBLE), 0) AS seller_aov
  FROM e_sell s LEFT JOIN sdeliv d ON d.seller_id = s.seller_id LEFT JOIN srev v ON v.seller_id = s.seller_id
  LEFT JOIN scust c ON c.seller_id = s.seller_id),
smed AS (SELECT median(CAST(total_revenue AS DOUBLE)) AS md0, median(CAST(avg_review_score AS DOUBLE)) AS md1,
  median(CAST(avg_delivery_days AS DOUBLE)) AS md2, median(CAST(late_rate_pct AS DOUBLE)) AS md3 FROM sbase),
sfill AS (SELECT b.*, coalesce(CAST(total_revenue AS DOUBLE), md0) AS v0, coalesce(CAST(avg_review_score AS DOUBLE), md1) AS v1,
  coalesce(CAST(avg_delivery_days AS DOUBLE), md2) AS v2, coalesce(CAST(late_rate_pct AS DOUBLE), md3) AS v3 FROM sbase b CROSS JOIN smed),
sed AS (SELECT {edges('v0', 0)}, {edges('v1', 1)}, {edges('v2', 2)}, {edges('v3', 3)} FROM sfill),
stier AS (SELECT f.*, ['Low', 'Below Avg', 'Average', 'Above Avg', 'High'][{qbin('v0', 'q0', 'mn0', 'mx0')}] AS revenue_tier,
  ['Low', 'Below Avg', 'Average', 'Above Avg', 'High'][{qbin('v1', 'q1', 'mn1', 'mx1')}] AS review_tier,
  ['High', 'Above Avg', 'Average', 'Below Avg', 'Low'][{qbin('v2', 'q2', 'mn2', 'mx2')}] AS delivery_tier,
  ['High', 'Above Avg', 'Average', 'Below Avg', 'Low'][{qbin('v3', 'q3', 'mn3', 'mx3')}] AS late_rate_tier FROM sfill f CROSS JOIN sed),
sc AS (SELECT *, CASE
  WHEN revenue_tier IN ('High', 'Above Avg') AND review_tier IN ('High', 'Above Avg') THEN 'Top Performer'
  WHEN revenue_tier IN ('High', 'Above Avg') AND review_tier IN ('Low', 'Below Avg') THEN 'High Revenue, Low Satisfaction'
  WHEN revenue_tier IN ('Low', 'Below Avg') AND review_tier IN ('High', 'Above Avg') AND delivery_tier IN ('High', 'Above Avg')
    THEN 'Hidden Gem (grow this)'
  WHEN delivery_tier IN ('Low', 'Below Avg') THEN 'Delivery Problem'
  WHEN review_tier IN ('Low', 'Below Avg') THEN 'Under-Performing' ELSE 'Average' END AS performance_flag FROM stier)
"""

SEG_SQL = {
    "r11_rfm_table": RFM_CTES + f"""SELECT customer_unique_id, recency_days, frequency, {m('monetary')} AS monetary, R, F, M, rfm_score,
  segment, customer_state, customer_city, last_order_date, first_order_date FROM rfm""",
    "r13_segment_summary": RFM_CTES + f""", ss AS (SELECT segment, count(customer_unique_id) AS n_customers,
  {r(avg_('recency_days'))} AS avg_recency, {r(avg_('frequency'), 4)} AS avg_frequency, {r(avg_('monetary'))} AS avg_monetary,
  sum(monetary) AS rv FROM rfm GROUP BY 1)
SELECT segment, n_customers, avg_recency, avg_frequency, avg_monetary, {m('rv')} AS total_revenue,
  {r(pct('rv', '(SELECT sum(rv) FROM ss)'))} AS revenue_share_pct FROM ss""",
    "r14_segment_headcounts": RFM_CTES + """SELECT count(*) FILTER (WHERE segment = 'Champions') AS champions,
  count(*) FILTER (WHERE segment = 'New Customers') AS new_customers,
  count(*) FILTER (WHERE segment IN ('At Risk', 'Can''t Lose Them')) AS at_risk, count(*) FILTER (WHERE segment = 'Lost') AS lost FROM rfm""",
    "r15_score_distributions": RFM_CTES + """SELECT 'R' AS score_type, R AS score, count(*) AS customers FROM rfm GROUP BY 2
  UNION ALL SELECT 'F', F, count(*) FROM rfm GROUP BY 2 UNION ALL SELECT 'M', M, count(*) FROM rfm GROUP BY 2""",

    "h1_cohort_retention": COHORT_CTES + "SELECT cohort_ym, period_number, n_customers, cohort_size, retention_pct FROM clong",
    "h3_cohort_range": W + f"""x AS (SELECT min(order_purchase_timestamp) AS first_purchase, max(order_purchase_timestamp) AS last_purchase,
  count(DISTINCT strftime(order_purchase_timestamp, '%Y-%m')) AS n_cohort_months FROM e_oe WHERE {DLV} AND customer_unique_id IS NOT NULL)
SELECT * FROM x""",
    "h4_cohort_summary": COHORT_CTES + f""", rt AS (SELECT cohort_ym, sum(n_customers) AS rr FROM clong WHERE period_number >= 1 GROUP BY 1)
SELECT s.cohort_ym, s.cohort_size, CAST(coalesce(rt.rr, 0) AS BIGINT) AS returned_customers,
  {r(pct('coalesce(rt.rr, 0)', 's.cohort_size'))} AS return_rate_pct
FROM clong s LEFT JOIN rt ON rt.cohort_ym = s.cohort_ym WHERE s.period_number = 0""",
    "h5_cohort_heatmap": COHORT_CTES + "SELECT cohort_ym, cohort_size, "
    + ", ".join(f"coalesce(max(CASE WHEN period_number = {k} THEN retention_pct END), 0.0) AS p{k}" for k in range(13))
    + " FROM clong WHERE period_number < 13 GROUP BY cohort_ym, cohort_size",
    "h6_h7_repeat_summary": COHORT_CTES + f"""SELECT count(*) AS customers, count(*) FILTER (WHERE orders = 1) AS one_time_buyers,
  count(*) FILTER (WHERE orders >= 2) AS repeat_buyers, {r(pct('count(*) FILTER (WHERE orders >= 2)', 'count(*)'))} AS repeat_rate_pct,
  {r(avg_('orders'), 4)} AS avg_orders, {m('coalesce(sum(clv) FILTER (WHERE orders = 1), 0)')} AS revenue_one_time,
  {m('coalesce(sum(clv) FILTER (WHERE orders >= 2), 0)')} AS revenue_repeat,
  {r(avg_('CASE WHEN orders = 1 THEN clv END'))} AS avg_clv_one_time, {r(avg_('CASE WHEN orders >= 2 THEN clv END'))} AS avg_clv_repeat FROM pp""",
    "h8_frequency_distribution": COHORT_CTES + f""", fc AS (SELECT orders, count(*) AS customers FROM pp GROUP BY 1)
SELECT orders, customers, {r(pct('customers', '(SELECT sum(customers) FROM fc)'))} AS pct FROM fc""",
    "h9_clv_distribution": COHORT_CTES + ", kept AS (SELECT CAST(clv AS DOUBLE) AS x FROM pp WHERE CAST(clv AS DOUBLE) <= "
    "(SELECT quantile_cont(CAST(clv AS DOUBLE), 0.99) FROM pp)), hh AS (" + hist_sql("SELECT x FROM kept", 60, "clv")
    + f") SELECT hh.*, (SELECT {r(avg_('CAST(clv AS DOUBLE)'))} FROM pp) AS mean_clv, "
    "(SELECT " + r("median(CAST(clv AS DOUBLE))") + " FROM pp) AS median_clv FROM hh",
    "h10_clv_by_orders": COHORT_CTES + f"SELECT orders, {r(avg_('clv'))} AS avg_clv FROM pp GROUP BY 1",

    "i1_seller_scorecard": SELLER_CTES + f"""SELECT seller_id, seller_state, {m('total_revenue')} AS total_revenue, n_unique_orders,
  {r('avg_review_score', 4)} AS avg_review_score, {r('avg_delivery_days', 4)} AS avg_delivery_days, {r('late_rate_pct', 4)} AS late_rate_pct, n_delivered,
  {r('pct_5star', 4)} AS pct_5star, {r('pct_1star', 4)} AS pct_1star, n_reviews,
  n_customers_served, {r('seller_aov', 4)} AS seller_aov, revenue_tier, review_tier, delivery_tier, late_rate_tier, performance_flag FROM sc""",
    "i7_opportunity_lists": SELLER_CTES + ", ".join([""] + [
        f"{n} AS (SELECT '{n}' AS list, seller_id, {m('total_revenue')} AS total_revenue, {r('avg_review_score', 4)} AS avg_review_score, "
        f"{r('late_rate_pct', 4)} AS late_rate_pct FROM sc WHERE performance_flag = '{flag}' ORDER BY {order}, seller_id LIMIT 20)"
        for n, flag, order in [("top_performers", "Top Performer", "sc.total_revenue DESC"),
                               ("high_rev_low_sat", "High Revenue, Low Satisfaction", "sc.total_revenue DESC"),
                               ("hidden_gems", "Hidden Gem (grow this)", "sc.avg_review_score DESC NULLS LAST"),
                               ("delivery_problems", "Delivery Problem", "sc.late_rate_pct DESC NULLS LAST"),
                               ("under_performing", "Under-Performing", "sc.total_revenue ASC")]])
    + "\nSELECT * FROM top_performers UNION ALL SELECT * FROM high_rev_low_sat UNION ALL SELECT * FROM hidden_gems"
      " UNION ALL SELECT * FROM delivery_problems UNION ALL SELECT * FROM under_performing",
    "i8_flag_summary": SELLER_CTES + f"SELECT performance_flag, count(*) AS sellers, {m('sum(total_revenue)')} AS revenue FROM sc GROUP BY 1",
    "i9_seller_scatter": SELLER_CTES + f"""SELECT seller_id, {m('total_revenue')} AS total_revenue, {r('avg_review_score', 4)} AS avg_review_score,
  least(n_unique_orders, 500) AS size, performance_flag,
  (SELECT {r('median(avg_review_score)', 4)} FROM sc) AS median_review,
  (SELECT {r('median(CAST(total_revenue AS DOUBLE))')} FROM sc) AS median_revenue
FROM sc WHERE avg_review_score IS NOT NULL AND total_revenue > 0""",
}



SEG_SQL["h2_cohort_pivot_all"] = COHORT_CTES + "SELECT cohort_ym, cohort_size, " + ", ".join(
    f"coalesce(max(retention_pct) FILTER (WHERE period_number = {k}), 0.0) AS p{k}" for k in range(120)
) + ", string_agg(period_number || ':' || format('{:.2f}', retention_pct), ',' ORDER BY period_number) AS rates FROM clong GROUP BY cohort_ym, cohort_size"
