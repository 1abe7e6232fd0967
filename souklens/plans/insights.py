"""The overview KPI set (N4); N1, N2, N3 and A25 are in ``report``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souklens.plans import kpi
from souklens.plans.context import Layers


def _f2(c: str) -> Column:
    return F.format_string("%.2f", F.col(c))


def n04_overview_kpis(L: Layers) -> DataFrame:
    """The overview KPI set as (Metric, Value) rows (an unpivot)."""
    k = kpi.l02_kpis(L.star).select(
        F.col("total_orders").cast("string").alias("a"), F.col("delivered_orders").cast("string").alias("b"),
        _f2("total_revenue").alias("c"), _f2("average_order_value").alias("d"), _f2("average_delivery_days").alias("e"),
        F.col("delayed_orders").cast("string").alias("f"), _f2("delayed_rate").alias("g"))
    return k.selectExpr("stack(7, 'Total Orders', a, 'Delivered Orders', b, 'Total Revenue', c, 'Average Order Value', d, "
                        "'Average Delivery Days', e, 'Delayed Orders', f, 'Delayed Rate', g) as (Metric, Value)")


INSIGHT_JOBS = {"n04_overview_kpis": n04_overview_kpis}
