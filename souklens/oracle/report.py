"""Oracle SQL of the reports (N1, N2, N3, A25): the numbers in plain SQL, and each
rule's line written out as a concatenation."""

from __future__ import annotations

import re

from souklens.oracle.base import avg_, avg_days, m, pct, r
from souklens.oracle.enrich import E_ORDERS
from souklens.oracle.kpi import CAT, KPI_SQL
from souklens.oracle.segments import SEG_SQL
from souklens.plans.report import BY_KEY, MEANINGS, MEASURES, RULES

DLV = "order_status = 'delivered'"
_BIN = ("CASE WHEN delivery_days > 0 AND delivery_days <= 5 THEN '0-5d' WHEN delivery_days > 5 AND delivery_days <= 10 THEN '5-10d' "
        "WHEN delivery_days > 10 AND delivery_days <= 15 THEN '10-15d' WHEN delivery_days > 15 AND delivery_days <= 20 THEN '15-20d' "
        "WHEN delivery_days > 20 AND delivery_days <= 30 THEN '20-30d' WHEN delivery_days > 30 AND delivery_days <= 60 THEN '30-60d' "
        "WHEN delivery_days > 60 AND delivery_days <= 300 THEN '60d+' END")


def _row(domain: str, src: str, key: str = "NULL", by: str = "NULL", weight: str | None = None, **values: str) -> str:
    cols = [f"CAST({values.get(c, 'NULL')} AS DOUBLE) AS {c}" for c in MEASURES if c not in ("n", "mean", "cum")]
    return (f"SELECT '{domain}' AS domain, CAST({key} AS VARCHAR) AS key, CAST({by} AS DECIMAL(38,10)) AS sort, "
            f"CAST({weight or by} AS DECIMAL(38,10)) AS weight, {', '.join(cols)} FROM {src}")


_ORDER = dict(orders="count(*)", revenue="coalesce(sum(order_revenue), 0)",
              aov=pct("coalesce(sum(order_revenue), 0)", "count(*)").replace("* 100.0", "* 1.0"), days=avg_days("delivery_seconds"),
              promised=avg_days("estimated_seconds"), difference=avg_days("delay_seconds"), late="count(*) FILTER (WHERE is_delayed = 1)",
              rate=pct("count(*) FILTER (WHERE is_delayed = 1)", "count(*)"))
_REV = "coalesce(sum(order_revenue), 0)"


def _rows() -> str:
    parts = [
        _row("total", "d, (SELECT count(order_item_id) AS items, " + avg_("review_score") + " AS score, " + avg_("freight_value") + " AS freight, "
             + pct("sum(freight_value)", "sum(item_revenue)") + " AS fs FROM ix) i", by=_REV, items="any_value(i.items)", score="any_value(i.score)",
             freight="any_value(i.freight)", freight_share="any_value(i.fs)", **_ORDER),
        _row("month", "d WHERE order_year_month IS NOT NULL GROUP BY order_year_month", "order_year_month", _REV, **_ORDER),
        _row("category", "ix GROUP BY label", "label", "sum(item_revenue)", orders="count(DISTINCT order_id)", items="count(order_item_id)",
             revenue="sum(item_revenue)", score=avg_("review_score")),
        _row("state", "d WHERE customer_state IS NOT NULL GROUP BY customer_state", "customer_state", _REV, **_ORDER),
        _row("seller state", "ix WHERE seller_state IS NOT NULL GROUP BY seller_state", "seller_state", "sum(item_revenue)", revenue="sum(item_revenue)"),
        _row("speed", "d WHERE customer_state IS NOT NULL GROUP BY customer_state HAVING count(delivery_seconds) >= 100", "customer_state",
             "-" + avg_days("delivery_seconds"), **_ORDER),
        _row("score", "ix WHERE product_category_name_english IS NOT NULL GROUP BY product_category_name_english HAVING count(DISTINCT order_id) >= 200",
             "product_category_name_english", "-" + avg_("review_score"), score=avg_("review_score")),
        _row("delivery", f"(SELECT *, {_BIN} AS b FROM d) z WHERE b IS NOT NULL GROUP BY b", "b", "count(*)", score=avg_("review_score")),
        _row("punctuality", "d WHERE delay_seconds IS NOT NULL GROUP BY delay_seconds > 0", "CASE WHEN delay_seconds > 0 THEN 'late' ELSE 'on time' END",
             "count(*)", score=avg_("review_score")),
        _row("payment", f"({KPI_SQL['k5_payment_performance']}) k WHERE payment_type IS NOT NULL", "payment_type", "payment_value", orders="orders",
             value="payment_value", aov="average_payment_value"),
        _row("payment mix", "cl_payments WHERE payment_type IS NOT NULL GROUP BY payment_type", "payment_type", "count(*)", orders="count(*)"),
        _row("persons", "pp", customers="count(*)", orders="count(*) FILTER (WHERE k > 1)", rate=pct("count(*) FILTER (WHERE k > 1)", "count(*)"),
             clv=avg_("CASE WHEN k > 1 THEN rr END"), aov=avg_("CASE WHEN k = 1 THEN rr END")),
        _row("sellers", "ss", orders="count(*)", median="quantile_cont(CAST(rr AS DOUBLE), 0.5)",
             share=pct("(SELECT sum(rr) FROM (SELECT rr FROM ss ORDER BY rr DESC, seller_id LIMIT 10) z)", "sum(rr)")),
        _row("segment", f"({SEG_SQL['r13_segment_summary']}) s WHERE segment = 'New Customers'", "segment", customers="n_customers", revenue="total_revenue",
             share="revenue_share_pct"),
    ]
    return f"""WITH {E_ORDERS},
d AS (SELECT f.*, c.customer_state, c.customer_unique_id FROM fact_orders f LEFT JOIN cl_customers c ON c.customer_id = f.customer_id WHERE f.{DLV}),
ix AS (SELECT i.*, rv.review_score, {CAT} AS label FROM e_items i LEFT JOIN cl_reviews rv ON rv.order_id = i.order_id
  LEFT JOIN dim_product p ON p.product_id = i.product_id WHERE i.{DLV}),
pp AS (SELECT customer_unique_id, count(order_id) AS k, sum(order_revenue) AS rr FROM d GROUP BY 1),
ss AS (SELECT seller_id, sum(item_revenue) AS rr FROM ix GROUP BY 1),
raw AS ({" UNION ALL ".join(parts)}),
rr AS MATERIALIZED (SELECT domain, key, row_number() OVER o AS rank, count(*) OVER w AS n, {", ".join(c for c in MEASURES if c not in ("n", "mean", "cum", "share"))},
  CAST(sum(sort) OVER w AS DOUBLE) / count(*) OVER w AS mean, coalesce(share, {pct("weight", "sum(weight) OVER w")}) AS share,
  {pct("sum(weight) OVER (PARTITION BY domain ORDER BY sort DESC, key ROWS UNBOUNDED PRECEDING)", "sum(weight) OVER w")} AS cum
  FROM raw WINDOW w AS (PARTITION BY domain), o AS (PARTITION BY domain ORDER BY sort DESC, key))"""


def _number(x: str, form: str) -> str:
    spec, digits = {"0": (",.0f", 0), "2": (",.2f", 2), "p1": (".1f", 1), "p2": (".2f", 2)}[form]
    return f"format('{{:{spec}}}', {r(x, digits)})"


def _text(template: str) -> str:
    out = []
    for plain, name in re.findall(r"([^{]*)(?:\{([^}]+)\})?", template):
        if plain:
            out.append("'" + plain.replace("'", "''") + "'")
        if name:
            *other, measure = name.split(".")
            column, _, form = measure.partition(":")
            value = column if column == "key" else _number(column, form)
            if other:
                domain, place = other
                where = f"key = '{place}'" if domain in BY_KEY else "rank = n" if place == "last" else f"rank = {place}"
                value = f"(SELECT {value} FROM rr z WHERE domain = '{domain}' AND {where})"
            out.append(f"coalesce({value}, 'n/a')")
    return " || ".join(out) or "''"


def _lines(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {section} AS section, {line} AS line, rank, coalesce(key, '') AS key, {_text(title)} AS title, {_text(metric)} AS metric, "
        f"{_text(text)} AS txt FROM rr WHERE domain = '{domain}' AND rank >= {first}" + (f" AND rank <= {last}" if last else "")
        for report, section, line, domain, first, last, title, metric, text in RULES if report == name)


def _report(name: str, select: str) -> str:
    return _rows() + f",\nlines AS ({_lines(name)})\n{select}"


_MEANINGS = ", ".join("({}, '{}', '{}')".format(*x) for x in MEANINGS)
REPORT_SQL = {
    "n01_business_insights": _report("N1", "SELECT category, title AS metric, metric AS value, txt AS observation, business_meaning "
                                     f"FROM lines JOIN (VALUES {_MEANINGS}) v(section, category, business_meaning) USING (section)"),
    "n02_report_lines": _report("N2", 'SELECT section, "key", txt AS line, CAST(row_number() OVER (ORDER BY section, lines.line, rank) AS INTEGER) AS seq FROM lines'),
    "n03_executive_insights": _report("N3", "SELECT section AS id, title, metric, txt AS detail FROM lines"),
    "a25_eda_insights": _report("A25", "SELECT section AS id, title AS topic, txt AS insight FROM lines"),
}
