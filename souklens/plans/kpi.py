"""KPI export engine (K1-K5) and the dashboard query layer.

K1 folds the reference's many scalar subqueries into one conditional
aggregate over delivered orders plus one aggregate over per-person order
counts; the two one-row results are cross-joined (both provably one row).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.numeric import mean, mean_days, money, pct, rnd, share_if
from souklens.plans.sqlsuite import DELIVERED, _with_customer, category_name, category_revenue

def IS_DELIVERED():
    return F.coalesce(DELIVERED(), F.lit(False))


def k1_kpi_summary(w) -> DataFrame:
    d = w["fact_orders"].where(DELIVERED())
    orders = d.agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        money(F.sum("order_revenue")).alias("total_revenue"),
        rnd(mean("order_revenue")).alias("average_order_value"),
        rnd(mean_days("delivery_seconds")).alias("average_delivery_days"),
        rnd(mean_days("estimated_seconds")).alias("average_estimated_delivery_days"),
        rnd(mean_days("delay_seconds")).alias("average_delivery_delay_days"),
        F.count_if(F.col("is_delayed") == 1).alias("delayed_orders"),
        rnd(share_if(F.col("is_delayed") == 1)).alias("delayed_order_rate"))
    # fact_orders holds one row per order (the order key is unique after
    # cleaning, V1) and dim_customer one per customer_id, so a plain count is
    # the distinct order count without the extra shuffle a distinct needs
    per = _with_customer(w, d).groupBy("customer_unique_id").agg(F.count("order_id").alias("n"))
    cust = per.agg(F.count(F.lit(1)).alias("unique_customers"),
                   F.count_if(F.col("n") > 1).alias("repeat_customers"),
                   rnd(pct(F.count_if(F.col("n") > 1), F.count(F.lit(1)))).alias("repeat_customer_rate"))
    return orders.crossJoin(F.broadcast(cust))


def k2_monthly_performance(w) -> DataFrame:
    return w["fact_orders"].where(DELIVERED()).groupBy("order_year_month").agg(
        F.count(F.lit(1)).alias("orders"), money(F.sum("order_revenue")).alias("revenue"),
        rnd(mean("order_revenue")).alias("average_order_value"))


def k3_category_performance(w) -> DataFrame:
    return category_revenue(w).select("category", "orders", F.col("items").alias("items_sold"),
                                      money("revenue_dec").alias("revenue"))


def k4_state_performance(w) -> DataFrame:
    return _with_customer(w, w["fact_orders"].where(DELIVERED())).groupBy("customer_state").agg(
        F.count("order_id").alias("orders"), money(F.sum("order_revenue")).alias("revenue"),
        rnd(mean("order_revenue")).alias("average_order_value"))


def k5_payment_performance(w) -> DataFrame:
    """Delivered orders by primary payment type; the NULL type keeps its row."""
    return w["fact_orders"].where(DELIVERED()).groupBy(F.col("primary_payment_type").alias("payment_type")).agg(
        F.count(F.lit(1)).alias("orders"), money(F.sum("payment_total")).alias("payment_value"),
        rnd(mean("payment_total")).alias("average_payment_value"))


# --------------------------------------------------------------------------- L1-L12

def l01_validate_database(w) -> DataFrame:
    counts = [w[t].agg(F.count(F.lit(1)).alias(alias)) for t, alias in
              [("fact_orders", "fact_orders"), ("fact_sales", "fact_sales"), ("dim_customer", "customers"),
               ("dim_product", "products"), ("dim_seller", "sellers")]]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), counts)


def _delivered_rev() -> F.Column:
    return F.when(IS_DELIVERED(), F.col("order_revenue"))


def l02_kpis(w) -> DataFrame:
    fo = w["fact_orders"]
    dl = F.count_if(IS_DELIVERED())
    late = F.count_if(IS_DELIVERED() & (F.col("is_delayed") == 1))
    return fo.agg(
        F.count(F.lit(1)).alias("total_orders"), dl.alias("delivered_orders"),
        money(F.coalesce(F.sum(_delivered_rev()), F.lit(0))).alias("total_revenue"),
        rnd(mean(_delivered_rev())).alias("average_order_value"),
        rnd(mean_days(F.when(IS_DELIVERED(), F.col("delivery_seconds")))).alias("average_delivery_days"),
        late.alias("delayed_orders"), rnd(pct(late, dl)).alias("delayed_rate"))


def l03_monthly_revenue(w) -> DataFrame:
    """Orders of all statuses, revenue of delivered ones."""
    return w["fact_orders"].groupBy("order_year_month").agg(
        F.count(F.lit(1)).alias("orders"),
        money(F.coalesce(F.sum(_delivered_rev()), F.lit(0))).alias("revenue"),
        rnd(mean(_delivered_rev())).alias("average_order_value"))


def l04_category_revenue(w, limit: int = 20) -> DataFrame:
    return (category_revenue(w).orderBy(F.desc("revenue_dec"), "category").limit(limit)
            .select("category", "orders", "items", money("revenue_dec").alias("revenue")))


def l05_state_revenue(w) -> DataFrame:
    fo = w["fact_orders"].join(w["dim_customer"].select("customer_id", "customer_state"), "customer_id", "left")
    return fo.groupBy(F.col("customer_state").alias("state")).agg(
        F.count_distinct("order_id").alias("orders"),
        money(F.coalesce(F.sum(_delivered_rev()), F.lit(0))).alias("revenue"),
        rnd(mean(_delivered_rev())).alias("average_order_value"))


def l06_payment_performance(w, payments: DataFrame) -> DataFrame:
    """Payment-row grain: cleaned payments of delivered orders."""
    d = w["fact_orders"].where(DELIVERED()).select("order_id")
    p = payments.join(d, "order_id", "left_semi")
    return p.groupBy("payment_type").agg(
        F.count_distinct("order_id").alias("orders"), money(F.sum("payment_value")).alias("revenue"),
        rnd(mean("payment_value")).alias("average_payment_value"))


def l07_delivery_performance(w) -> DataFrame:
    fo = w["fact_orders"]
    dl = F.count_if(IS_DELIVERED())
    late = F.count_if(IS_DELIVERED() & (F.col("is_delayed") == 1))
    return fo.agg(
        dl.alias("delivered_orders"),
        rnd(mean_days(F.when(IS_DELIVERED(), F.col("delivery_seconds")))).alias("average_delivery_days"),
        rnd(mean_days(F.when(IS_DELIVERED(), F.col("estimated_seconds")))).alias("average_estimated_days"),
        rnd(mean_days(F.when(IS_DELIVERED(), F.col("delay_seconds")))).alias("average_delay_days"),
        late.alias("delayed_orders"), rnd(pct(late, dl)).alias("delayed_rate"))


def l08_customer_metrics(w) -> DataFrame:
    per = _with_customer(w, w["fact_orders"]).groupBy("customer_unique_id").agg(
        F.count_distinct("order_id").alias("n"),
        F.coalesce(F.sum(_delivered_rev()), F.lit(0)).alias("rev"))
    rep = F.count_if(F.col("n") > 1)
    return per.agg(F.count(F.lit(1)).alias("total_customers"),
                   F.count_if(F.col("n") == 1).alias("one_time_customers"), rep.alias("repeat_customers"),
                   rnd(pct(rep, F.count(F.lit(1)))).alias("repeat_customer_rate"),
                   money(F.sum("rev")).alias("customer_revenue"))


def l09_seller_performance(w, limit: int = 20) -> DataFrame:
    from souklens.plans.sqlsuite import q06_top_sellers
    return q06_top_sellers(w, limit)


def l10_product_performance(w, limit: int = 20) -> DataFrame:
    from souklens.plans.sqlsuite import q15_top_products
    return q15_top_products(w, limit).withColumnRenamed("items_sold", "items")


def l11_review_performance(w) -> DataFrame:
    return (w["fact_orders"].where(F.col("review_score").isNotNull()).groupBy("review_score")
            .agg(F.count(F.lit(1)).alias("reviews")))


def l12_filter_options(w) -> DataFrame:
    """(option, value) rows: states, categories, primary payment types, years."""
    fo = w["fact_orders"]
    parts = [
        w["dim_customer"].where(F.col("customer_state").isNotNull())
        .select(F.lit("state").alias("option"), F.col("customer_state").alias("value")),
        w["dim_product"].select(F.lit("category").alias("option"), category_name().alias("value")),
        fo.where(F.col("primary_payment_type").isNotNull())
        .select(F.lit("payment_type").alias("option"), F.col("primary_payment_type").alias("value")),
        fo.where(F.col("order_year").isNotNull())
        .select(F.lit("year").alias("option"), F.col("order_year").cast("string").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


KPI_JOBS = {
    "k1_kpi_summary": k1_kpi_summary,
    "k2_monthly_performance": k2_monthly_performance,
    "k3_category_performance": k3_category_performance,
    "k4_state_performance": k4_state_performance,
    "k5_payment_performance": k5_payment_performance,
    "l01_validate_database": l01_validate_database,
    "l02_kpis": l02_kpis,
    "l03_monthly_revenue": l03_monthly_revenue,
    "l04_category_revenue": l04_category_revenue,
    "l05_state_revenue": l05_state_revenue,
    "l07_delivery_performance": l07_delivery_performance,
    "l08_customer_metrics": l08_customer_metrics,
    "l09_seller_performance": l09_seller_performance,
    "l10_product_performance": l10_product_performance,
    "l11_review_performance": l11_review_performance,
    "l12_filter_options": l12_filter_options,
}
