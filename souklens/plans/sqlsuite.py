"""The eighteen analytical queries over the star schema (Q1-Q18).

Each takes the warehouse dict (``fact_orders``, ``fact_sales``,
``dim_customer``, ``dim_product``) and returns a DataFrame with the same
column names as the reference's SQL.  Money is summed as DECIMAL, averages
are sum/count, durations are averaged from whole seconds.

A caller that runs several queries gives them ``shared_tables``: what more than
one of them reads is then computed once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.numeric import mean, mean_days, money, pct, ratio, rnd, share_if
from souklens.functions.reuse import reused

def DELIVERED():
    return F.col("order_status") == "delivered"


def category_name() -> F.Column:
    """English name, else native name, else 'Unknown'."""
    return F.coalesce(F.col("product_category_name_english"), F.col("product_category_name"), F.lit("Unknown"))


def _delivered_orders(w) -> DataFrame:
    return w["fact_orders"].where(DELIVERED())


def _with_customer(w, fo: DataFrame) -> DataFrame:
    """Order-grain facts with the person and state.  fact_orders holds one row
    per order (the order key is unique after cleaning, V1) and dim_customer
    one per customer_id, so counting order_id here counts distinct orders
    without the extra shuffle a distinct aggregate needs."""
    return fo.join(w["dim_customer"].select("customer_id", "customer_unique_id", "customer_state"), "customer_id")


def _orders_with_customer(w) -> DataFrame:
    if "orders_with_customer" in w:
        return w["orders_with_customer"]
    return _with_customer(w, w["fact_orders"])


def _delayed_pct() -> F.Column:
    return share_if(F.col("is_delayed") == 1)


def q01_delivered_revenue(w) -> DataFrame:
    return _delivered_orders(w).agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        money(F.sum("order_revenue")).alias("total_revenue"),
        rnd(ratio(F.sum("order_revenue"), F.count(F.lit(1)))).alias("average_order_value"))


def monthly_delivered_revenue(w) -> DataFrame:
    return _delivered_orders(w).groupBy("order_year_month").agg(F.sum("order_revenue").alias("revenue"))


def q02_monthly_mom(w) -> DataFrame:
    # the window runs over the monthly aggregate only (one row per month)
    m = monthly_delivered_revenue(w)
    prev = F.lag("revenue").over(Window.orderBy("order_year_month"))
    return (m.withColumn("prev", prev)
            .select("order_year_month", money("revenue").alias("revenue"),
                    money("prev").alias("previous_month_revenue"),
                    rnd(pct(F.col("revenue") - F.col("prev"), F.col("prev"))).alias("mom_growth_percent")))


def _sales_with_category(w) -> DataFrame:
    if "sales_with_category" in w:
        return w["sales_with_category"]
    p = w["dim_product"].select("product_id", category_name().alias("category"))
    return w["fact_sales"].where(DELIVERED()).join(p, "product_id", "left") \
        .withColumn("category", F.coalesce(F.col("category"), F.lit("Unknown")))


def category_revenue(w) -> DataFrame:
    """Per category: distinct orders, items, revenue (delivered).

    Two-level aggregate: (category, order) first — combined map-side —
    then per category, so the distinct count needs no extra expand.
    """
    if "category_revenue" in w:
        return w["category_revenue"]
    per_order = _sales_with_category(w).groupBy("category", "order_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("item_revenue").alias("rev"))
    return per_order.groupBy("category").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("n").alias("items"), F.sum("rev").alias("revenue_dec"))


def q03_top_categories(w, limit: int = 20) -> DataFrame:
    c = category_revenue(w)
    return (c.orderBy(F.desc("revenue_dec"), "category").limit(limit)
            .select("category", "orders", "items", money("revenue_dec").alias("revenue")))


def q04_repeat_customers(w) -> DataFrame:
    per = (_orders_with_customer(w).groupBy("customer_unique_id")
           .agg(F.count_distinct("order_id").alias("order_count")))
    return per.agg(F.count(F.lit(1)).alias("total_customers"),
                   F.count_if(F.col("order_count") > 1).alias("repeat_customers"),
                   rnd(pct(F.count_if(F.col("order_count") > 1), F.count(F.lit(1)))).alias("repeat_customer_rate_percent"))


def q05_top_customers(w, limit: int = 20) -> DataFrame:
    per = (_orders_with_customer(w).where(DELIVERED()).groupBy("customer_unique_id").agg(
        F.count("order_id").alias("orders"),
        F.sum("order_revenue").alias("rev"),
        mean("order_revenue").alias("aov"),
        F.min("order_purchase_timestamp").alias("first_purchase"),
        F.max("order_purchase_timestamp").alias("last_purchase")))
    return (per.orderBy(F.desc("rev"), "customer_unique_id").limit(limit)
            .select("customer_unique_id", "orders", money("rev").alias("lifetime_revenue"),
                    rnd("aov").alias("average_order_value"), "first_purchase", "last_purchase"))


def q06_top_sellers(w, limit: int = 20) -> DataFrame:
    per_order = (w["fact_sales"].where(DELIVERED()).groupBy("seller_id", "order_id")
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("item_revenue").alias("rev")))
    per = per_order.groupBy("seller_id").agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("items"),
                                             F.sum("rev").alias("rev"))
    return (per.orderBy(F.desc("rev"), "seller_id").limit(limit)
            .select("seller_id", "orders", "items", money("rev").alias("revenue")))


def q07_seller_performance(w) -> DataFrame:
    so = w["fact_sales"].where(DELIVERED()).select("seller_id", "order_id").distinct()
    fo = _delivered_orders(w).select("order_id", "review_score", "delivery_seconds", "is_delayed")
    m = so.join(fo, "order_id")
    # (seller, order) pairs are distinct and fact_orders has one row per order,
    # so a plain count is the distinct count without an extra shuffle
    return m.groupBy("seller_id").agg(
        F.count("order_id").alias("orders"),
        rnd(mean("review_score")).alias("avg_review_score"),
        rnd(mean_days("delivery_seconds")).alias("avg_delivery_days"),
        rnd(_delayed_pct()).alias("delayed_order_percent"))


def q08_delivery_kpis(w) -> DataFrame:
    return _delivered_orders(w).agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        rnd(mean_days("delivery_seconds")).alias("avg_delivery_days"),
        rnd(mean_days("estimated_seconds")).alias("avg_estimated_delivery_days"),
        rnd(mean_days("delay_seconds")).alias("avg_delay_days"),
        F.count_if(F.col("is_delayed") == 1).alias("delayed_orders"),
        rnd(_delayed_pct()).alias("delayed_order_percent"))


def q09_revenue_by_state(w) -> DataFrame:
    return _orders_with_customer(w).where(DELIVERED()).groupBy("customer_state").agg(
        F.count("order_id").alias("orders"),
        money(F.sum("order_revenue")).alias("revenue"),
        rnd(mean("order_revenue")).alias("average_order_value"))


def q10_review_vs_delay(w) -> DataFrame:
    return (_delivered_orders(w).where(F.col("review_score").isNotNull()).groupBy("review_score").agg(
        F.count(F.lit(1)).alias("orders"),
        rnd(mean_days("delivery_seconds")).alias("avg_delivery_days"),
        rnd(mean_days("delay_seconds")).alias("avg_delay_days"),
        rnd(_delayed_pct()).alias("delayed_percent")))


def q11_payment_types(w) -> DataFrame:
    return (w["fact_orders"].where(F.col("primary_payment_type").isNotNull())
            .groupBy(F.col("primary_payment_type").alias("payment_type")).agg(
                F.count(F.lit(1)).alias("orders"),
                money(F.sum("payment_total")).alias("payment_value"),
                rnd(mean("payment_total")).alias("average_payment_value")))


def q12_category_share(w, limit: int = 10) -> DataFrame:
    c = category_revenue(w)
    total = c.agg(F.sum("revenue_dec").alias("total"))  # one row
    return (c.crossJoin(F.broadcast(total)).orderBy(F.desc("revenue_dec"), "category").limit(limit)
            .select("category", money("revenue_dec").alias("revenue"),
                    rnd(pct("revenue_dec", "total")).alias("revenue_share_percent")))


def q13_monthly_orders(w) -> DataFrame:
    return _delivered_orders(w).groupBy("order_year_month").agg(
        F.count(F.lit(1)).alias("orders"),
        money(F.sum("order_revenue")).alias("revenue"),
        rnd(mean("order_revenue")).alias("average_order_value"))


def q14_payment_behavior(w) -> DataFrame:
    b = F.when(F.col("payment_rows") > 1, F.lit("Multiple Payments")).otherwise(F.lit("Single Payment"))
    return w["fact_orders"].groupBy(b.alias("payment_behavior")).agg(
        F.count(F.lit(1)).alias("orders"),
        money(F.sum("payment_total")).alias("payment_value"),
        rnd(mean("payment_total")).alias("average_payment"))


def q15_top_products(w, limit: int = 20) -> DataFrame:
    s = _sales_with_category(w)
    per_order = s.groupBy("product_id", "category", "order_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("item_revenue").alias("rev"))
    per = per_order.groupBy("product_id", "category").agg(
        F.sum("n").alias("items_sold"), F.count(F.lit(1)).alias("orders"), F.sum("rev").alias("rev"))
    return (per.orderBy(F.desc("rev"), "product_id", "category").limit(limit)
            .select("product_id", "category", "items_sold", "orders", money("rev").alias("revenue")))


def q16_delivery_by_state(w) -> DataFrame:
    return _orders_with_customer(w).where(DELIVERED()).groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        rnd(mean_days("delivery_seconds")).alias("avg_delivery_days"),
        rnd(mean_days("delay_seconds")).alias("avg_delay_days"),
        rnd(_delayed_pct()).alias("delayed_percent"))


def q17_multi_payment(w) -> DataFrame:
    return w["fact_orders"].where(F.col("payment_rows") > 1).agg(
        F.count(F.lit(1)).alias("multiple_payment_orders"),
        money(F.sum("payment_total")).alias("payment_value"),
        rnd(mean("payment_total")).alias("average_payment_value"))


def q18_quarterly(w) -> DataFrame:
    ts = F.col("order_purchase_timestamp")
    return (_delivered_orders(w).groupBy(F.year(ts).alias("order_year"), F.quarter(ts).alias("qn"))
            .agg(F.sum("order_revenue").alias("rev"), F.count(F.lit(1)).alias("orders"))
            .select("order_year", F.concat(F.lit("Q"), F.col("qn").cast("string")).alias("quarter"),
                    money("rev").alias("revenue"), "orders"))


SUITE = {
    "q01_delivered_revenue": q01_delivered_revenue,
    "q02_monthly_mom": q02_monthly_mom,
    "q03_top_categories": q03_top_categories,
    "q04_repeat_customers": q04_repeat_customers,
    "q05_top_customers": q05_top_customers,
    "q06_top_sellers": q06_top_sellers,
    "q07_seller_performance": q07_seller_performance,
    "q08_delivery_kpis": q08_delivery_kpis,
    "q09_revenue_by_state": q09_revenue_by_state,
    "q10_review_vs_delay": q10_review_vs_delay,
    "q11_payment_types": q11_payment_types,
    "q12_category_share": q12_category_share,
    "q13_monthly_orders": q13_monthly_orders,
    "q14_payment_behavior": q14_payment_behavior,
    "q15_top_products": q15_top_products,
    "q16_delivery_by_state": q16_delivery_by_state,
    "q17_multi_payment": q17_multi_payment,
    "q18_quarterly": q18_quarterly,
}

# The columns of each table that the suite reads.
SUITE_READS = {
    "fact_orders": ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_year_month", "delivery_seconds",
                    "estimated_seconds", "delay_seconds", "is_delayed", "order_revenue", "payment_total", "payment_rows",
                    "primary_payment_type", "review_score"),
    "fact_sales": ("order_id", "product_id", "seller_id", "order_status", "item_revenue"),
    "dim_customer": ("customer_id", "customer_unique_id", "customer_state"),
    "dim_product": ("product_id", "product_category_name", "product_category_name_english"),
}
# The columns of the orders with their customer that Q4, Q5, Q9 and Q16 read.
WITH_CUSTOMER_READS = ("order_id", "customer_unique_id", "customer_state", "order_status", "order_purchase_timestamp", "order_revenue",
                       "delivery_seconds", "delay_seconds", "is_delayed")


def shared_tables(star: Mapping[str, DataFrame], stored: bool = False) -> Mapping[str, DataFrame]:
    """The tables for a run of the whole suite.  Facts, joins and sums that
    several queries read are marked for caching, with the columns that they
    read, when the first of them asks for one; stored facts are read as they
    are.  Other columns are not there, so a query that needs more fails."""
    from souklens.plans.context import LazyTables

    w = {n: (lambda n=n: star[n].select(*SUITE_READS[n])) for n in SUITE_READS}
    if not stored:
        w |= {n: (lambda n=n: reused(star[n].select(*SUITE_READS[n]))) for n in ("fact_orders", "fact_sales")}
    plain = LazyTables(w)
    joined = LazyTables({**{n: (lambda n=n: plain[n]) for n in plain},
                         "orders_with_customer": lambda: reused(_orders_with_customer(plain).select(*WITH_CUSTOMER_READS)),
                         "sales_with_category": lambda: reused(_sales_with_category(plain))})
    return LazyTables({**{n: (lambda n=n: joined[n]) for n in joined}, "category_revenue": lambda: reused(category_revenue(joined))})
