"""Oracle SQL for the page tables and filter jobs."""

from souklens.oracle.base import avg_, avg_days, m, pct, r
from souklens.oracle.enrich import E_ORDERS

W = "WITH " + E_ORDERS + ",\n"


def brl(x: str) -> str:
    v = f"CAST(({x}) AS DOUBLE)"
    return (f"CASE WHEN {v} >= 1000000 THEN 'R$' || format('{{:.2f}}', {r(f'{v} / 1000000.0', 2)}) || 'M' "
            f"WHEN {v} >= 1000 THEN 'R$' || format('{{:.1f}}', {r(f'{v} / 1000.0', 1)}) || 'K' "
            f"ELSE 'R$' || format('{{:.2f}}', {r(v, 2)}) END")
DLV = "order_status = 'delivered'"
FO = "fo AS (SELECT * FROM e_oe WHERE order_status IN ('delivered', 'shipped')),\n"
HAS = f"{DLV} AND delivery_seconds IS NOT NULL"
HD = f"{HAS} AND is_delayed IS NOT NULL"

_BY = {"o": {"date": "CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'",
             "state": "customer_state IN ('NATION_1', 'NATION_2', 'NATION_3')", "status": "order_status IN ('delivered', 'shipped')"},
       "i": {"category": "product_category_name_english IN ('Category 1', 'Category 2')", "seller state": "seller_state IN ('NATION_2', 'NATION_4')"},
       "r": {"score": "review_score IN (1, 5)"}, "s": {"seller state": "seller_state IN ('NATION_2', 'NATION_4')"}}


def _sizes(name: str) -> str:
    def where(part: str) -> str:
        return " AND ".join(c for n, c in _BY[part].items() if name in (n, "all")) or "true"

    kept = f"order_id IN (SELECT order_id FROM e_oe WHERE {where('o')})"
    return (f"SELECT '{name}' AS filter, (SELECT count(*) FROM e_oe WHERE {where('o')}) AS orders, "
            f"(SELECT count(*) FROM e_items WHERE {kept} AND {where('i')}) AS items, "
            f"(SELECT count(*) FROM cl_reviews WHERE {kept} AND {where('r')}) AS reviews, "
            f"(SELECT count(*) FROM e_sell WHERE {where('s')}) AS sellers")


PAGES_SQL = {
    "f20_filter_sizes": W + "x AS (" + " UNION ALL ".join(
        _sizes(n) for n in ("date", "state", "status", "category", "seller state", "score", "all")) + ") SELECT * FROM x",
    "y01_filtered_kpis": W + FO + f"""oa AS (SELECT count(*) AS total_orders, count(*) FILTER (WHERE {DLV}) AS delivered_orders,
  coalesce({r(avg_(f'CASE WHEN {DLV} THEN total_order_revenue END'))}, 0.0) AS aov,
  coalesce({r(pct(f'count(*) FILTER (WHERE {DLV})', 'count(*)'))}, 0.0) AS delivered_rate,
  coalesce({r(avg_days(f'CASE WHEN {HAS} THEN delivery_seconds END'))}, 0.0) AS avg_delivery_days,
  coalesce({r(pct(f'count(*) FILTER (WHERE {HD} AND is_delayed = 1)', f'count(*) FILTER (WHERE {HD})'))}, 0.0) AS late_rate FROM fo)
SELECT oa.*, (SELECT {m('coalesce(sum(item_revenue), 0)')} FROM e_items WHERE {DLV} AND order_id IN (SELECT order_id FROM fo)) AS total_revenue,
  (SELECT coalesce({r(avg_('review_score'), 4)}, 0.0) FROM cl_reviews WHERE order_id IN (SELECT order_id FROM fo)) AS avg_review_score,
  (SELECT count(DISTINCT customer_unique_id) FROM e_cust) AS total_customers,
  (SELECT {r(pct('count(*) FILTER (WHERE is_repeat_buyer)', 'count(*)'))} FROM e_cust) AS repeat_buyer_rate,
  (SELECT count(*) FROM e_sell) AS total_sellers FROM oa""",
    "f23_filter_share": W + FO + f"""x AS (SELECT (SELECT count(*) FROM fo) AS kept_orders, (SELECT count(*) FROM e_oe) AS total_orders)
SELECT kept_orders, total_orders, {r('kept_orders * 100.0 / NULLIF(total_orders, 0)', 1)} AS kept_pct FROM x""",
    "f21_order_filter": W + """x AS (SELECT order_status, count(*) AS orders, min(order_purchase_timestamp) AS first_purchase,
  max(order_purchase_timestamp) AS last_purchase FROM e_oe
  WHERE order_purchase_timestamp >= TIMESTAMP '1995-01-01 00:00:00' AND order_purchase_timestamp <= TIMESTAMP '1995-12-31 00:00:00'
    AND order_status IN ('delivered', 'shipped') GROUP BY 1) SELECT * FROM x""",
    "f22_item_filter": W + f"""x AS (SELECT order_status, count(*) AS items, count(DISTINCT order_id) AS orders, {m('sum(item_revenue)')} AS revenue
  FROM e_items
  WHERE order_purchase_timestamp >= TIMESTAMP '1995-01-01 00:00:00' AND order_purchase_timestamp <= TIMESTAMP '1995-12-31 00:00:00'
    AND order_status IN ('delivered', 'shipped') GROUP BY 1) SELECT * FROM x""",
    "f24_filter_options": W + """x AS (
  SELECT DISTINCT 'customer_state' AS option, customer_state AS value FROM e_oe WHERE customer_state IS NOT NULL
  UNION ALL SELECT DISTINCT 'seller_state', seller_state FROM e_sell WHERE seller_state IS NOT NULL
  UNION ALL SELECT DISTINCT 'category', product_category_name_english FROM e_items WHERE product_category_name_english IS NOT NULL
  UNION ALL SELECT DISTINCT 'order_status', order_status FROM e_oe WHERE order_status IS NOT NULL
  UNION ALL SELECT DISTINCT 'payment_type', payment_type FROM cl_payments WHERE payment_type IS NOT NULL
  UNION ALL SELECT 'min_date', CAST(min(CAST(order_purchase_timestamp AS DATE)) AS VARCHAR) FROM e_oe
  UNION ALL SELECT 'max_date', CAST(max(CAST(order_purchase_timestamp AS DATE)) AS VARCHAR) FROM e_oe) SELECT * FROM x""",
    "y02_status_counts": W + "x AS (SELECT order_status, count(*) AS orders FROM e_oe GROUP BY 1) SELECT * FROM x",
    "y02_top5_category_share": W + f"""top AS (SELECT product_category_name_english AS category, sum(item_revenue) AS rr FROM e_items
  WHERE {DLV} AND product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY rr DESC, category LIMIT 5)
SELECT category, {m('rr')} AS revenue, {r(pct('rr', '(SELECT sum(rr) FROM top)'))} AS share_of_top FROM top""",
    "y08_state_summary": W + f"""cs AS (SELECT customer_state, count(customer_unique_id) AS n_customers, {avg_('total_spend_payment')} AS avg_spend
  FROM e_cust WHERE customer_state IS NOT NULL GROUP BY 1),
rs AS (SELECT customer_state, coalesce(sum(total_order_revenue), 0) AS revenue FROM e_oe WHERE {DLV} AND customer_state IS NOT NULL GROUP BY 1),
ds AS (SELECT customer_state, {avg_days('delivery_seconds')} AS d FROM e_oe WHERE {HAS} AND customer_state IS NOT NULL GROUP BY 1),
s AS (SELECT coalesce(cs.customer_state, rs.customer_state) AS customer_state, coalesce(cs.n_customers, 0) AS n_customers,
  coalesce({r('cs.avg_spend')}, 0.0) AS avg_spend, coalesce(rs.revenue, 0) AS rev, coalesce({r('ds.d')}, 0.0) AS avg_delivery_days
  FROM cs FULL OUTER JOIN rs ON rs.customer_state = cs.customer_state LEFT JOIN ds ON ds.customer_state = coalesce(cs.customer_state, rs.customer_state))
SELECT customer_state, n_customers, avg_spend, {m('rev')} AS revenue, {brl('rev')} AS revenue_fmt, avg_delivery_days,
  {r(pct('rev', '(SELECT sum(rev) FROM s)'), 1)} AS rev_share FROM s""",
    "y09_state_coverage": W + """cs AS (SELECT DISTINCT customer_state AS state FROM e_cust WHERE customer_state IS NOT NULL),
ss AS (SELECT DISTINCT seller_state AS state FROM e_sell WHERE seller_state IS NOT NULL),
u AS (SELECT state FROM cs UNION SELECT state FROM ss),
x AS (SELECT u.state, cs.state IS NOT NULL AS has_customers, ss.state IS NOT NULL AS has_sellers FROM u
  LEFT JOIN cs ON cs.state = u.state LEFT JOIN ss ON ss.state = u.state)
SELECT *, CASE WHEN has_customers AND has_sellers THEN 'Both' WHEN has_customers THEN 'Customers only' ELSE 'Neither' END AS status FROM x""",
    "y10_executive_figures": W + f"""st AS (SELECT customer_state, coalesce(sum(total_order_revenue), 0) AS rr FROM e_oe
  WHERE {DLV} AND customer_state IS NOT NULL GROUP BY 1),
lead AS (SELECT customer_state AS leading_state, {r(pct('rr', '(SELECT sum(rr) FROM st)'))} AS leading_state_share FROM st
  ORDER BY rr DESC, customer_state DESC LIMIT 1),
dr AS (SELECT o.is_delayed, rv.review_score FROM e_oe o JOIN cl_reviews rv ON rv.order_id = o.order_id WHERE o.{HD}),
sc AS (SELECT {r(avg_('CASE WHEN is_delayed = 0 THEN review_score END'), 4)} AS ontime_score,
  {r(avg_('CASE WHEN is_delayed = 1 THEN review_score END'), 4)} AS late_score FROM dr),
cat AS (SELECT product_category_name_english AS c, sum(item_revenue) AS rr FROM e_items
  WHERE {DLV} AND product_category_name_english IS NOT NULL GROUP BY 1),
tc AS (SELECT c AS top_category, {m('rr')} AS top_category_revenue, (SELECT {r(avg_('rr'))} FROM cat) AS mean_category_revenue
  FROM cat ORDER BY rr DESC, c DESC LIMIT 1),
sd AS (SELECT customer_state AS s, {avg_days('delivery_seconds')} AS d FROM e_oe WHERE {HAS} AND customer_state IS NOT NULL
  GROUP BY 1 HAVING count(*) >= 100),
fs AS (SELECT (SELECT s FROM sd ORDER BY d, s LIMIT 1) AS fastest_state, (SELECT s FROM sd ORDER BY d DESC, s DESC LIMIT 1) AS slowest_state),
per AS (SELECT customer_unique_id, count(order_id) AS n, coalesce(sum(total_order_revenue), 0) AS rr FROM e_oe
  WHERE {DLV} AND customer_unique_id IS NOT NULL GROUP BY 1),
nc AS (SELECT {r(pct('sum(CASE WHEN n = 1 THEN rr END)', 'sum(rr)'))} AS one_time_revenue_share FROM per)
SELECT * FROM lead CROSS JOIN sc CROSS JOIN tc CROSS JOIN fs CROSS JOIN nc""",
}


def _share(cond: str) -> str:
    return pct(f"count(*) FILTER (WHERE coalesce({cond}, false))", "count(*)")


PAGES_SQL.update({
    "y03_sales_kpis": W + f"""st AS (SELECT customer_state, coalesce(sum(total_order_revenue), 0) AS rr FROM e_oe
  WHERE {DLV} AND customer_state IS NOT NULL GROUP BY 1),
lead AS (SELECT customer_state AS leading_state, {r(pct('rr', '(SELECT sum(rr) FROM st)'))} AS leading_state_share FROM st
  ORDER BY rr DESC, customer_state DESC LIMIT 1)
SELECT (SELECT {m('sum(item_revenue)')} FROM e_items WHERE {DLV}) AS total_revenue,
  (SELECT {m('sum(price)')} FROM e_items WHERE {DLV}) AS product_revenue,
  (SELECT {m('sum(freight_value)')} FROM e_items WHERE {DLV}) AS freight_revenue,
  (SELECT {r(avg_('total_order_revenue'))} FROM e_oe WHERE {DLV}) AS aov, lead.* FROM lead""",
    "y03_aov_by_month": W + f"""x AS (SELECT order_year_month AS ym_str, {r(avg_('total_order_revenue'))} AS aov,
  (SELECT {r(avg_('total_order_revenue'))} FROM e_oe WHERE {DLV}) AS overall_aov FROM e_oe WHERE {DLV} GROUP BY 1) SELECT * FROM x""",
    "y04_customer_kpis": W + f"""x AS (SELECT count(DISTINCT customer_unique_id) AS total_customers, count(*) FILTER (WHERE is_repeat_buyer) AS repeat_buyers,
  {r(pct('count(*) FILTER (WHERE is_repeat_buyer)', 'count(*)'))} AS repeat_rate, {r(avg_('total_spend_payment'))} AS avg_spend,
  {r(avg_('total_orders'), 4)} AS avg_orders FROM e_cust) SELECT * FROM x""",
    "y05_product_kpis": W + f"""x AS (SELECT count(DISTINCT product_category_name_english) AS total_categories, {r(avg_('price'))} AS avg_price,
  {r(f"median({pct('freight_value', 'price')})")} AS median_freight_pct FROM e_items WHERE {DLV}) SELECT * FROM x""",
    "y05_category_table": W + f"""x AS (SELECT product_category_name_english AS category, {m('sum(item_revenue)')} AS revenue,
  count(order_item_id) AS items_sold, {r(avg_('price'))} AS avg_price, {r(avg_('freight_value'))} AS avg_freight FROM e_items
  WHERE {DLV} AND product_category_name_english IS NOT NULL GROUP BY 1) SELECT * FROM x""",
    "y06_seller_kpis": W + f"""t AS (SELECT sum(total_revenue) AS top FROM (SELECT total_revenue FROM e_sell ORDER BY total_revenue DESC, seller_id LIMIT 10) z)
SELECT count(*) AS sellers, {m('sum(total_revenue)')} AS total_revenue, {r('median(CAST(total_revenue AS DOUBLE))')} AS median_revenue,
  {r(pct('(SELECT top FROM t)', 'sum(total_revenue)'))} AS top10_share FROM e_sell""",
    "y06_sellers_by_state": W + f"""x AS (SELECT seller_state, {m('sum(total_revenue)')} AS revenue, {brl('sum(total_revenue)')} AS rev_fmt,
  count(seller_id) AS n_sellers, {r(avg_('avg_review_score'), 4)} AS avg_score FROM e_sell WHERE seller_state IS NOT NULL GROUP BY 1)
SELECT * FROM x""",
    "y07_review_kpis": f"""SELECT {r(avg_('review_score'), 4)} AS avg_score, {r(_share('review_score = 5'))} AS pct_5star,
  {r(_share('review_score = 1'))} AS pct_1star, {r(_share('has_comment'))} AS comment_rate FROM cl_reviews""",
    "y07_monthly_reviews": f"""SELECT strftime(review_creation_date, '%Y-%m') AS ym_str, count(review_id) AS n_reviews,
  {r(avg_('review_score'), 4)} AS avg_score FROM cl_reviews WHERE review_creation_date IS NOT NULL GROUP BY 1""",
})

PAGES_SQL["y02_payment_counts"] = ("SELECT payment_type, count(*) AS payments FROM cl_payments "
                                   "WHERE payment_type IS NOT NULL GROUP BY 1")


def _scores(join: str) -> str:
    return W + f"""x AS (SELECT i.order_id, i.product_category_name_english AS c, rv.review_score FROM e_items i {join} cl_reviews rv
  ON rv.order_id = i.order_id WHERE i.{DLV}),
g AS (SELECT c, {avg_('review_score')} AS s, count(DISTINCT order_id) AS n FROM x WHERE c IS NOT NULL GROUP BY 1)
SELECT c AS category, {r('s', 4)} AS avg_score, n AS n_orders, (SELECT {r(avg_('review_score'), 4)} FROM x) AS overall_score,
  CASE WHEN s < 3.8 THEN 'low' WHEN s >= 4.2 THEN 'high' ELSE 'middle' END AS band FROM g WHERE n >= 200"""


_EDGES = list(zip([-300, -14, -7, -3, 0, 3, 7, 14], [-14, -7, -3, 0, 3, 7, 14, 300],
                  ["Early >14d", "Early 8-14d", "Early 3-7d", "Early ≤3d", "Late ≤3d", "Late 3-7d", "Late 7-14d", "Late >14d"]))
PAGES_SQL |= {
    "y05_category_scores": _scores("LEFT JOIN"), "y07_category_scores": _scores("JOIN"),
    "y06_top_sellers": W + f"""x AS (SELECT * FROM e_sell ORDER BY total_revenue DESC, seller_id LIMIT 30)
SELECT substr(seller_id, 1, 12) || '…' AS seller_short, seller_state, {m('total_revenue')} AS total_revenue, n_unique_orders, total_items_sold,
  {r('avg_review_score', 4)} AS avg_review_score, top_category FROM x""",
    "y07_delay_buckets": W + f"""x AS (SELECT o.is_delayed, rv.review_score, CASE """ + " ".join(
        f"WHEN delivery_delay_days > {a} AND delivery_delay_days <= {b} THEN '{name}'" for a, b, name in _EDGES) + f""" END AS bucket
  FROM e_oe o JOIN cl_reviews rv ON rv.order_id = o.order_id WHERE {HD})
SELECT bucket, {r(avg_('review_score'), 4)} AS avg_score, count(review_score) AS orders,
  (SELECT {r(avg_('review_score'), 4)} FROM x WHERE is_delayed = 0) AS ontime_score,
  (SELECT {r(avg_('review_score'), 4)} FROM x WHERE is_delayed = 1) AS late_score FROM x WHERE bucket IS NOT NULL GROUP BY 1 HAVING count(review_score) > 0""",
}
