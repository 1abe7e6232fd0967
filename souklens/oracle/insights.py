"""Oracle SQL for the overview unpivot (N4) and the engine smoke row."""

from souklens.oracle.kpi import KPI_SQL


def f2(x: str) -> str:
    return f"format('{{:.2f}}', {x})"


INSIGHTS_SQL = {
    "n04_overview_kpis": "WITH k AS (" + KPI_SQL["l02_kpis"].strip() + """)
SELECT 'Total Orders' AS Metric, CAST(total_orders AS VARCHAR) AS Value FROM k
UNION ALL SELECT 'Delivered Orders', CAST(delivered_orders AS VARCHAR) FROM k
UNION ALL SELECT 'Total Revenue', """ + f2("total_revenue") + """ FROM k
UNION ALL SELECT 'Average Order Value', """ + f2("average_order_value") + """ FROM k
UNION ALL SELECT 'Average Delivery Days', """ + f2("average_delivery_days") + """ FROM k
UNION ALL SELECT 'Delayed Orders', CAST(delayed_orders AS VARCHAR) FROM k
UNION ALL SELECT 'Delayed Rate', """ + f2("delayed_rate") + " FROM k",
}


def _v13() -> str:
    from souklens.oracle.growth import GROWTH_SQL, MONTHLY
    from souklens.oracle.segments import COHORT_CTES, SEG_SQL, SELLER_CTES
    return ("SELECT (SELECT count(*) FROM (" + SEG_SQL["r11_rfm_table"] + ") a) AS rfm_rows,\n"
            "(SELECT count(DISTINCT cohort_ym) FROM (" + COHORT_CTES + "SELECT * FROM clong) b) AS cohorts,\n"
            "(SELECT max(period_number) + 1 FROM (" + COHORT_CTES + "SELECT * FROM clong) c) AS periods,\n"
            "(SELECT count(*) FROM (" + SELLER_CTES + "SELECT * FROM sc) d) AS scorecard_rows,\n"
            "(SELECT count(*) FROM (" + MONTHLY + "SELECT * FROM gr) e) AS growth_months,\n"
            "(SELECT peak_month FROM (" + GROWTH_SQL["w13_growth_headline"] + ") f) AS peak_month,\n"
            "(SELECT repeat_rate_pct FROM (" + SEG_SQL["h6_h7_repeat_summary"] + ") g) AS repeat_rate_pct")


INSIGHTS_SQL["v13_engine_smoke"] = _v13()
