"""Registers every job with its oracle (imported once by the registry)."""

from __future__ import annotations

from pyspark.sql import types as T

from souklens.functions.numeric import rnd
from souklens.operators import clean as C
from souklens.operators import star as D
from souklens.oracle.cleanlog import CLEANLOG_SQL
from souklens.oracle.delivery import DELIVERY_SQL
from souklens.oracle.eda import EDA_SQL
from souklens.oracle.enrich import ENRICH_COLS, ENRICH_SQL
from souklens.oracle.growth import GROWTH_SQL
from souklens.oracle.insights import INSIGHTS_SQL
from souklens.oracle.kpi import KPI_SQL
from souklens.oracle.metrics import METRICS_SQL
from souklens.oracle.model import DS, FO, FS, MODEL_SQL
from souklens.oracle.opportunities import OPP_SQL
from souklens.oracle.pages import PAGES_SQL
from souklens.oracle.quality import QUALITY_SQL
from souklens.oracle.report import REPORT_SQL
from souklens.oracle.segments import SEG_SQL
from souklens.oracle.sqlsuite import SCRIPT_SQL, SUITE_SQL
from souklens.plans import cohort, delivery, eda, growth, insights, kpi, metrics, pages, quality, report, rfm, script, sellers, sqlsuite
from souklens.registry import register

SQL = {**SUITE_SQL, **KPI_SQL, **ENRICH_SQL, **EDA_SQL, **SEG_SQL, **GROWTH_SQL, **OPP_SQL, **DELIVERY_SQL, **QUALITY_SQL, **MODEL_SQL,
       **PAGES_SQL, **METRICS_SQL, **INSIGHTS_SQL, **REPORT_SQL, **CLEANLOG_SQL, **SCRIPT_SQL}


def project_out(df, cols):
    """Reference column order; DECIMAL money leaves as DOUBLE."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select([df[c].cast("double").alias(c) if isinstance(types[c], T.DecimalType) else df[c] for c in cols])


def _geolocation_zip(L):
    return L.clean["geolocation_zip"].withColumns({c: rnd(c, 6) for c in ("geolocation_lat", "geolocation_lng")})


# Jobs over the star schema
for _name, _job in {**sqlsuite.SUITE, **kpi.KPI_JOBS}.items():
    register(_name, _job, "star", SQL[_name])
for _name, _table, _cols in (("d05_fact_orders", "fact_orders", FO), ("d06_fact_sales", "fact_sales", FS), ("d09_dim_seller", "dim_seller", DS)):
    register(_name, lambda S, t=_table, c=_cols: project_out(S[t], c), "star", SQL[_name])
for _name, _table in (("d07_dim_customer", "dim_customer"), ("d08_dim_product", "dim_product"), ("d10_dim_date", "dim_date"),
                      ("d11_dim_geography", "dim_geography")):
    register(_name, lambda S, t=_table: S[t], "star", SQL[_name])

# The enriched tables
for _name, (_table, _cols) in ENRICH_COLS.items():
    register(_name, lambda E, t=_table, c=_cols: project_out(E[t], c), "enriched", SQL[_name])

# Jobs over all layers
for _jobs in (eda.EDA_JOBS, rfm.RFM_JOBS, cohort.COHORT_JOBS, sellers.SELLER_JOBS, growth.GROWTH_JOBS, delivery.DELIVERY_JOBS,
              quality.QUALITY_JOBS, pages.PAGE_JOBS, metrics.METRIC_JOBS, insights.INSIGHT_JOBS, report.REPORT_JOBS, script.SCRIPT_JOBS):
    for _name, _job in _jobs.items():
        register(_name, _job, None, SQL.get(_name))
register("l06_payment_performance", lambda L: kpi.l06_payment_performance(L.star, L.clean["order_payments"]), None,
         SQL["l06_payment_performance"])

# The cleaned tables themselves; D1, D3, D4: what is folded into
# fact_orders.  The oracle reads the same cleaned/warehouse CTEs.
for _name, _table, _cte in (("c01_customers", "customers", "cl_customers"), ("c02_geolocation", "geolocation", "cl_geo"),
                            ("c04_orders", "orders", "cl_orders"), ("c05_order_items", "order_items", "cl_items"),
                            ("c06_order_payments", "order_payments", "cl_payments"), ("c07_order_reviews", "order_reviews", "cl_reviews"),
                            ("c08_products", "products", "cl_products"), ("c09_sellers", "sellers", "cl_sellers"),
                            ("c10_category_translation", "category_translation", "cl_translation")):
    register(_name, lambda L, t=_table: L.clean[t], None, f"SELECT * FROM {_cte}")
register("c03_geolocation_zip", _geolocation_zip, None, SQL["c03_geolocation_zip"])
register("c11_cleaning_log", lambda L: C.cleaning_log({k: L.raw[k] for k in L.raw}), None, SQL["c11_cleaning_log"])
register("c12_row_counts", lambda L: C.row_counts({k: L.raw[k] for k in L.raw}, L.clean), None, SQL["c12_row_counts"])
register("d01_prepare_orders", lambda L: D.prepare_orders(L.clean["orders"]), None, "SELECT * FROM o_orders")
register("d03_payment_summary", lambda L: D.payment_summary(L.clean["order_payments"]), None,
         "SELECT p.*, t.primary_payment_type FROM o_pay p LEFT JOIN o_pay_type t ON p.order_id = t.order_id")
register("d04_item_summary", lambda L: D.item_summary(L.clean["order_items"]), None, "SELECT * FROM o_items")
