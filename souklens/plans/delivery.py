"""Delivery analytics (X10-X17) over the enriched layer.

"has_del" = delivered orders with a delivery date; "has_delay" = those whose
punctuality is known.  Item-weighted variants (by seller state, category)
join items to orders first, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.buckets import fixed_bucket, histogram
from souklens.functions.numeric import mean_days, pct, rnd, share_if
from souklens.functions.quantiles import exact_quantiles
from souklens.plans.context import Layers

# Delay buckets of the delivery page.
PAGE_DELAY_EDGES = [-300, -14, -7, -3, 0, 3, 7, 14, 300]
PAGE_DELAY_LABELS = ["Early >14d", "Early 8-14d", "Early 3-7d", "Early ≤3d", "Late ≤3d", "Late 3-7d", "Late 7-14d",
                     "Late >14d"]


def _has_del(L: Layers) -> DataFrame:
    o = L.enriched["orders_enriched"]
    return o.where((F.col("order_status") == "delivered") & F.col("delivery_seconds").isNotNull())


def _has_delay(L: Layers) -> DataFrame:
    return _has_del(L).where(F.col("is_delayed").isNotNull())


def x10_delivery_kpis(L: Layers) -> DataFrame:
    h = _has_del(L)
    # order-grain durations in seconds: quantiles stay distributed
    d = h.agg(rnd(mean_days("delivery_seconds")).alias("avg_delivery_days")).crossJoin(F.broadcast(
        exact_quantiles(h, "delivery_seconds", [0.5, 0.9]).select(
            rnd(F.col("_q")[0] / 86400.0).alias("median_delivery_days"),
            rnd(F.col("_q")[1] / 86400.0).alias("p90_delivery_days"))))
    late = F.col("is_delayed") == 1
    k = _has_delay(L).agg(share_if(late).alias("_late"),
                          rnd(mean_days(F.when(late, F.col("delay_seconds")))).alias("avg_delay_when_late"))
    return d.crossJoin(F.broadcast(k)).select("avg_delivery_days", "median_delivery_days", "p90_delivery_days",
                                 rnd("_late").alias("late_rate_pct"), rnd(F.lit(100.0) - F.col("_late")).alias("on_time_rate_pct"),
                                 "avg_delay_when_late")


def _state_days(L: Layers, min_orders: int) -> DataFrame:
    return (_has_del(L).where(F.col("customer_state").isNotNull()).groupBy(F.col("customer_state").alias("state"))
            .agg(mean_days("delivery_seconds").alias("_d"), F.count(F.lit(1)).alias("orders"))
            .where(F.col("orders") >= min_orders))


def x11_delivery_by_state(L: Layers, min_orders: int = 100) -> DataFrame:
    return _state_days(L, min_orders).select("state", rnd("_d").alias("avg_days"), "orders")


def x11_delivery_gap(L: Layers, min_orders: int = 100) -> DataFrame:
    s = _state_days(L, min_orders)
    return s.agg(F.min(F.struct("_d", "state")).alias("_f"), F.max(F.struct("_d", F.col("state"))).alias("_s")).select(
        F.col("_f.state").alias("fastest_state"), rnd("_f._d").alias("fastest_days"),
        F.col("_s.state").alias("slowest_state"), rnd("_s._d").alias("slowest_days"),
        rnd(F.col("_s._d") - F.col("_f._d")).alias("gap_days")).where(F.col("fastest_state").isNotNull())


def x12_late_rate_by_state(L: Layers, limit: int = 15) -> DataFrame:
    s = (_has_delay(L).where(F.col("customer_state").isNotNull()).groupBy(F.col("customer_state").alias("state"))
         .agg(share_if(F.col("is_delayed") == 1).alias("_r")))
    return s.orderBy(F.desc("_r"), "state").limit(limit).select("state", rnd("_r").alias("late_rate_pct"))


def x13_days_late_histogram(L: Layers, clip: float = 30.0, bins: int = 30) -> DataFrame:
    late = _has_delay(L).where(F.col("is_delayed") == 1).select(
        F.least(F.col("delivery_delay_days"), F.lit(clip)).alias("x"))
    return histogram(late, "x", bins, "days_late")


def x14_delay_buckets(L: Layers) -> DataFrame:
    b = (_has_delay(L).withColumn("bucket", fixed_bucket("delivery_delay_days", PAGE_DELAY_EDGES, PAGE_DELAY_LABELS))
         .where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("orders")))
    tot = b.agg(F.sum("orders").alias("_t"))
    return b.crossJoin(F.broadcast(tot)).select("bucket", "orders", rnd(pct("orders", "_t")).alias("pct"))


def _items_with_days(L: Layers) -> DataFrame:
    it = L.enriched["order_items_enriched"].where(F.col("order_status") == "delivered")
    d = _has_del(L).select("order_id", "delivery_seconds", "is_delayed")
    return it.drop("is_delayed").join(d, "order_id", "left")


def x15_delivery_by_seller_state(L: Layers, min_orders: int = 50) -> DataFrame:
    x = _items_with_days(L).where(F.col("seller_state").isNotNull())
    return (x.groupBy("seller_state").agg(rnd(mean_days("delivery_seconds")).alias("avg_del"),
                                          F.count_distinct("order_id").alias("n_orders"),
                                          rnd(share_if(F.col("is_delayed") == 1)).alias("late_rate"))
            .where(F.col("n_orders") >= min_orders))


def x16_monthly_delivery(L: Layers) -> DataFrame:
    return _has_del(L).groupBy(F.col("order_year_month").alias("ym_str")).agg(
        rnd(mean_days("delivery_seconds")).alias("avg_del"), rnd(share_if(F.col("is_delayed") == 1)).alias("late_rate"),
        F.count("order_id").alias("n_orders"))


def x17_slowest_categories(L: Layers, min_orders: int = 500, limit: int = 15) -> DataFrame:
    x = _items_with_days(L).where(F.col("product_category_name_english").isNotNull())
    c = (x.groupBy(F.col("product_category_name_english").alias("category"))
         .agg(mean_days("delivery_seconds").alias("_d"), F.count_distinct("order_id").alias("n_orders"))
         .where(F.col("n_orders") >= min_orders))
    return c.orderBy(F.desc("_d"), "category").limit(limit).select("category", rnd("_d").alias("avg_del"), "n_orders")


DELIVERY_JOBS = {n: f for n, f in dict(globals()).items() if n[:1] == "x" and n[1:3].isdigit()}
