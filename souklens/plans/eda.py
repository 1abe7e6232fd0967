"""Exploratory analysis over the enriched layer.

Every metric bag becomes a one-row DataFrame and every distribution a long
table.  Shares use a one-row total cross-joined back instead of a global
window, so no step funnels all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.buckets import fixed_bucket, histogram
from souklens.functions.numeric import mean, mean_days, money, pct, ratio, rnd, share_if
from souklens.functions.quantiles import exact_quantiles
from souklens.plans.context import Layers

def DELIVERED():
    return F.col("order_status") == "delivered"
def ONE():
    return F.lit(1)

# Bucket edges and labels.
DELAY_EDGES = [-200, -14, -7, -3, 0, 3, 7, 14, 300]
DELAY_LABELS = ["Early >14d", "Early 8-14d", "Early 3-7d", "Early 0-3d", "Late 0-3d", "Late 3-7d", "Late 7-14d", "Late >14d"]
FREIGHT_EDGES = [0, 10, 20, 30, 50, 500]
FREIGHT_LABELS = ["R$0-10", "R$10-20", "R$20-30", "R$30-50", "R$50+"]
DELIVERY_BIN_EDGES = [0, 5, 10, 15, 20, 30, 60, 300]
DELIVERY_BIN_LABELS = ["0-5d", "5-10d", "10-15d", "15-20d", "20-30d", "30-60d", "60d+"]
SEGMENT_LABELS = ["High-Frequency (3+ orders)", "Returning (2 orders)", "High-Value (1 order, R$500+)",
                  "Single-Purchase (<R$500)"]
# The reference trims its monthly series to these months (pass
# as ``month_range`` to reproduce; by default no month is dropped).
REFERENCE_MONTH_RANGE = ("2016-10", "2018-08")


def _share_of_total(df: DataFrame, count_col: str, out: str, digits: int = 2) -> DataFrame:
    total = df.agg(F.sum(count_col).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, rnd(pct(count_col, "_total"), digits)).drop("_total")


def _orders(L: Layers) -> DataFrame:
    return L.enriched["orders_enriched"]


def _items(L: Layers) -> DataFrame:
    return L.enriched["order_items_enriched"]


def _del_items(L: Layers) -> DataFrame:
    return _items(L).where(DELIVERED())


def _del_sales(L: Layers) -> DataFrame:
    """Delivered item rows for jobs that need no product or seller field."""
    return L.star["fact_sales"].where(DELIVERED())


def _del_orders_with_days(L: Layers) -> DataFrame:
    return _orders(L).where(DELIVERED() & F.col("delivery_seconds").isNotNull())


def _reviews(L: Layers) -> DataFrame:
    return L.clean["order_reviews"].select("order_id", "review_score")


def a01_descriptive(L: Layers) -> DataFrame:
    o = _orders(L).agg(
        F.count(ONE()).alias("total_orders"), F.count_if(DELIVERED()).alias("delivered_orders"),
        F.count_if(F.col("order_status") == "canceled").alias("canceled_orders"),
        F.min("order_purchase_timestamp").alias("_min"), F.max("order_purchase_timestamp").alias("_max"))
    c = L.enriched["customer_analytics"].agg(
        F.count_distinct("customer_unique_id").alias("total_unique_customers"),
        F.count_if("is_repeat_buyer").alias("repeat_buyers"))
    p = L.enriched["product_analytics"].agg(F.count(ONE()).alias("total_products_in_analytics"))
    s = L.enriched["seller_analytics"].agg(F.count(ONE()).alias("total_active_sellers"))
    return (o.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(p)).crossJoin(F.broadcast(s)).select(
        "total_orders", "delivered_orders", "canceled_orders", "total_unique_customers", "repeat_buyers",
        rnd(pct("repeat_buyers", "total_unique_customers")).alias("repeat_buyer_rate_pct"),
        "total_products_in_analytics", "total_active_sellers",
        F.date_format("_min", "yyyy-MM-dd").alias("date_min"),
        F.floor(F.timestamp_diff("SECOND", F.col("_min"), F.col("_max")) / 86400).cast("bigint").alias("date_span_days")))


def a02_status_distribution(L: Layers) -> DataFrame:
    c = _orders(L).where(F.col("order_status").isNotNull()).groupBy("order_status").agg(F.count(ONE()).alias("orders"))
    return _share_of_total(c, "orders", "pct_of_orders")


def a03_payment_types(L: Layers) -> DataFrame:
    p = L.clean["order_payments"].where(F.col("payment_type").isNotNull())
    c = p.groupBy("payment_type").agg(F.count(ONE()).alias("payment_rows"), rnd(mean("payment_value")).alias("avg_payment_value"))
    return _share_of_total(c, "payment_rows", "pct_of_rows")


def a04_review_distribution(L: Layers) -> DataFrame:
    r = _reviews(L).where(F.col("review_score").isNotNull())
    c = r.groupBy("review_score").agg(F.count(ONE()).alias("reviews"))
    avg = r.agg(rnd(mean("review_score"), 4).alias("avg_review_score"))
    return _share_of_total(c, "reviews", "pct_of_reviews").crossJoin(F.broadcast(avg))


def a05_business_kpis(L: Layers) -> DataFrame:
    di = _del_sales(L).agg(
        F.sum("item_revenue").alias("_rev"), F.sum("price").alias("_prod"), F.sum("freight_value").alias("_fr"),
        rnd(mean("freight_value")).alias("avg_freight_per_item"))
    o = _orders(L)
    late = F.col("is_delayed") == 1
    has = DELIVERED() & F.col("delivery_seconds").isNotNull()
    has_delay = has & F.col("is_delayed").isNotNull()
    oa = o.agg(
        F.count(ONE()).alias("total_orders"), F.count_if(DELIVERED()).alias("delivered_orders"),
        rnd(mean(F.when(DELIVERED(), F.col("total_order_revenue")))).alias("avg_order_value"),
        rnd(mean(F.when(DELIVERED(), F.col("item_count"))), 4).alias("avg_items_per_order"),
        rnd(pct(F.count_if(F.col("order_status") == "canceled"), F.count(ONE()))).alias("cancellation_rate_pct"),
        rnd(mean_days(F.when(has, F.col("delivery_seconds")))).alias("avg_delivery_days"),
        pct(F.count_if(has_delay & late), F.count_if(has_delay)).alias("_late"),
        rnd(mean_days(F.when(has_delay & late, F.col("delay_seconds")))).alias("avg_delay_when_late_days"))
    ca = L.enriched["customer_analytics"].agg(
        rnd(pct(F.count_if("is_repeat_buyer"), F.count(ONE()))).alias("repeat_buyer_rate_pct"),
        F.count(ONE()).alias("total_unique_customers"))
    rv = _reviews(L).agg(rnd(mean("review_score"), 4).alias("avg_review_score"))
    sa = L.enriched["seller_analytics"].agg(F.count(ONE()).alias("active_sellers"))
    return di.crossJoin(F.broadcast(oa)).crossJoin(F.broadcast(ca)).crossJoin(F.broadcast(rv)).crossJoin(F.broadcast(sa)).select(
        "total_orders", "delivered_orders", money("_rev").alias("total_revenue_brl"),
        money("_prod").alias("product_revenue_brl"), money("_fr").alias("freight_revenue_brl"),
        rnd(pct("_fr", "_rev")).alias("freight_pct_of_revenue"), "avg_order_value", "avg_items_per_order",
        "avg_freight_per_item", "cancellation_rate_pct", "repeat_buyer_rate_pct", "avg_review_score",
        "avg_delivery_days", rnd(F.lit(100.0) - F.col("_late")).alias("on_time_delivery_rate"),
        rnd("_late").alias("late_delivery_rate"), "avg_delay_when_late_days", "total_unique_customers",
        "active_sellers")


def monthly_revenue_orders(L: Layers, month_range: tuple[str, str] | None = None) -> DataFrame:
    """Item revenue ⟗ delivered order count per purchase month; AOV."""
    rev = _del_items(L).groupBy("order_year_month").agg(F.sum("item_revenue").alias("revenue"))
    n = _orders(L).where(DELIVERED()).groupBy("order_year_month").agg(F.count("order_id").alias("n_orders"))
    m = rev.join(n, "order_year_month", "full_outer").where(F.col("order_year_month").isNotNull())
    if month_range:
        m = m.where(F.col("order_year_month").between(*month_range))
    return m.withColumn("aov", ratio("revenue", "n_orders"))


def a06_monthly_revenue(L: Layers, month_range: tuple[str, str] | None = None) -> DataFrame:
    return monthly_revenue_orders(L, month_range).select(
        F.col("order_year_month").alias("year_month"), money("revenue").alias("revenue"),
        "n_orders", rnd("aov").alias("aov"))


def a06_monthly_summary(L: Layers, month_range: tuple[str, str] | None = None) -> DataFrame:
    m = monthly_revenue_orders(L, month_range)
    pr = F.min(F.when(F.col("revenue").isNotNull(), F.struct((-F.col("revenue")).alias("k"), F.col("order_year_month").alias("m"))))
    po = F.min(F.when(F.col("n_orders").isNotNull(), F.struct((-F.col("n_orders")).alias("k"), F.col("order_year_month").alias("m"))))
    return m.agg(pr.alias("_pr"), po.alias("_po"), mean("revenue").alias("_ar"), mean("n_orders").alias("_ao")).select(
        F.col("_pr.m").alias("peak_revenue_month"), money(-F.col("_pr.k")).alias("peak_revenue_value"),
        F.col("_po.m").alias("peak_orders_month"), (-F.col("_po.k")).alias("peak_orders_value"),
        rnd("_ar").alias("avg_monthly_revenue"), rnd("_ao").alias("avg_monthly_orders"))


def _top_categories(L: Layers, metric: F.Column, name: str, limit: int) -> DataFrame:
    c = (_del_items(L).where(F.col("product_category_name_english").isNotNull())
         .groupBy(F.col("product_category_name_english").alias("category")).agg(metric.alias("_v")))
    return c.orderBy(F.desc("_v"), "category").limit(limit).withColumnRenamed("_v", name)


def a07_top_categories_revenue(L: Layers, limit: int = 15) -> DataFrame:
    return _top_categories(L, F.sum("item_revenue"), "revenue", limit).withColumn("revenue", money("revenue"))


def a08_top_categories_volume(L: Layers, limit: int = 15) -> DataFrame:
    return _top_categories(L, F.count("order_id"), "items_sold", limit)


def a09_seller_concentration(L: Layers, top_n: int = 10) -> DataFrame:
    s = L.enriched["seller_analytics"]
    top = s.orderBy(F.desc("total_revenue"), "seller_id").limit(top_n).agg(F.sum("total_revenue").alias("_top"))
    a = s.agg(F.count(ONE()).alias("total_active_sellers"), money(F.max("total_revenue")).alias("top_seller_revenue"),
              F.sum("total_revenue").alias("_all"),
              F.count_distinct("seller_state").alias("states_with_sellers"))
    med = exact_quantiles(s, "total_revenue", [0.5]).select(rnd(F.col("_q")[0]).alias("median_seller_revenue"))
    return a.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(med)).select("total_active_sellers", "top_seller_revenue", "median_seller_revenue",
                                   rnd(pct("_top", "_all")).alias("top_10_sellers_pct_of_total_revenue"),
                                   "states_with_sellers")


def a09_top_sellers(L: Layers, limit: int = 15) -> DataFrame:
    s = L.enriched["seller_analytics"]
    by_rev = s.orderBy(F.desc("total_revenue"), "seller_id").limit(limit).select(
        F.lit("revenue").alias("ranking"), "seller_id", "seller_state", F.col("total_revenue").cast("double").alias("value"))
    by_ord = s.orderBy(F.desc("n_unique_orders"), "seller_id").limit(limit).select(
        F.lit("orders").alias("ranking"), "seller_id", "seller_state", F.col("n_unique_orders").cast("double").alias("value"))
    return by_rev.unionByName(by_ord)


def a10_revenue_by_seller_state(L: Layers) -> DataFrame:
    s = L.enriched["seller_analytics"].where(F.col("seller_state").isNotNull())
    return s.groupBy("seller_state").agg(money(F.sum("total_revenue")).alias("total_revenue"))


def a11_customers_by_state(L: Layers) -> DataFrame:
    c = (L.enriched["customer_analytics"].where(F.col("customer_state").isNotNull()).groupBy("customer_state")
         .agg(F.count("customer_unique_id").alias("n_customers"), rnd(mean("total_spend_payment")).alias("avg_spend")))
    r = (_orders(L).where(DELIVERED() & F.col("customer_state").isNotNull()).groupBy("customer_state")
         .agg(money(F.sum("total_order_revenue")).alias("total_revenue")))
    return c.join(r, "customer_state", "left")


def a12_order_frequency(L: Layers) -> DataFrame:
    c = L.enriched["customer_analytics"].groupBy("total_orders").agg(F.count(ONE()).alias("customers"))
    return _share_of_total(c, "customers", "pct_of_customers")


def customer_segment() -> F.Column:
    n, spend = F.col("total_orders"), F.col("total_spend_payment")
    return (F.when(n >= 3, F.lit(SEGMENT_LABELS[0])).when(n == 2, F.lit(SEGMENT_LABELS[1]))
            .when(spend >= 500, F.lit(SEGMENT_LABELS[2])).otherwise(F.lit(SEGMENT_LABELS[3])))


def a13_customer_segments(L: Layers) -> DataFrame:
    c = L.enriched["customer_analytics"]
    return c.groupBy(customer_segment().alias("segment")).agg(
        F.count("customer_unique_id").alias("n_customers"), rnd(mean("total_spend_payment")).alias("avg_spend"),
        rnd(mean("total_orders"), 4).alias("avg_orders"))


def a14_logistics(L: Layers) -> DataFrame:
    d = _del_orders_with_days(L)
    late = F.col("is_delayed") == 1
    o = d.agg(rnd(mean_days("delivery_seconds")).alias("avg_delivery_days"),
              rnd(share_if(late)).alias("late_rate_pct"),
              rnd(mean_days(F.when(late, F.col("delay_seconds")))).alias("avg_delay_when_late"))
    # order-grain durations in seconds: quantiles stay distributed
    q = exact_quantiles(d, "delivery_seconds", [0.5, 0.9]).select(
        rnd(F.col("_q")[0] / 86400.0).alias("median_delivery_days"), rnd(F.col("_q")[1] / 86400.0).alias("p90_delivery_days"))
    # freight is in cents of a bounded price list: the inline exact median is fine
    i = _del_sales(L).agg(rnd(mean("freight_value")).alias("avg_freight_per_item"),
                          rnd(F.median(F.col("freight_value").cast("double"))).alias("median_freight"))
    return o.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(i)).select("avg_delivery_days", "median_delivery_days", "p90_delivery_days", "late_rate_pct",
                                              "avg_delay_when_late", "avg_freight_per_item", "median_freight")


def a15_delivery_by_state(L: Layers, min_orders: int = 200) -> DataFrame:
    d = _del_orders_with_days(L).where(F.col("customer_state").isNotNull())
    return (d.groupBy(F.col("customer_state").alias("state"))
            .agg(rnd(mean_days("delivery_seconds")).alias("avg_days"), F.count(ONE()).alias("n_orders"))
            .where(F.col("n_orders") >= min_orders))


def a16_freight_pct_by_category(L: Layers, limit: int = 12) -> DataFrame:
    i = _del_items(L).where(F.col("product_category_name_english").isNotNull()).withColumn(
        "freight_pct", pct("freight_value", "price"))
    # a continuous ratio per item: per-category exact medians that split hot categories
    c = (exact_quantiles(i.withColumnRenamed("product_category_name_english", "category"), "freight_pct", [0.5],
                         keys=["category"])
         .select("category", F.col("_q")[0].alias("_m")).where(F.col("_m").isNotNull()))
    return c.orderBy(F.desc("_m"), "category").limit(limit).select("category", rnd("_m").alias("median_freight_pct"))


def a17_freight_price_corr(L: Layers) -> DataFrame:
    return _del_sales(L).agg(rnd(F.corr(F.col("price").cast("double"), F.col("freight_value").cast("double")), 4)
                             .alias("freight_price_correlation"))


def a17_freight_price_sample(L: Layers, n: int = 8000, seed: int = 42, max_price: float = 1000) -> DataFrame:
    """Deterministic seeded sample: the ``n`` rows with the smallest
    md5('order_id|order_item_id|seed').  The limit is the feature."""
    i = _del_sales(L).where(F.col("price") <= max_price)
    key = F.md5(F.concat_ws("|", F.col("order_id").cast("string"), F.col("order_item_id").cast("string"),
                            F.lit(str(seed))).cast("binary"))
    return (i.select("order_id", "order_item_id", F.col("price").cast("double").alias("price"),
                     F.col("freight_value").cast("double").alias("freight_value"), key.alias("_h"))
            .orderBy("_h", "order_id", "order_item_id").limit(n).drop("_h"))


def _items_with_review(L: Layers) -> DataFrame:
    return _del_items(L).join(_reviews(L), "order_id", "inner")


def a18_review_by_category(L: Layers, min_orders: int = 200, k: int = 5) -> DataFrame:
    c = (_items_with_review(L).where(F.col("product_category_name_english").isNotNull())
         .groupBy(F.col("product_category_name_english").alias("category"))
         .agg(mean("review_score").alias("_s"), F.count_distinct("order_id").alias("n_orders"))
         .where(F.col("n_orders") >= min_orders))
    low = c.orderBy("_s", "category").limit(k).withColumn("position", F.lit("lowest"))
    high = c.orderBy(F.desc("_s"), F.desc("category")).limit(k).withColumn("position", F.lit("highest"))
    return low.unionByName(high).select("position", "category", rnd("_s", 3).alias("avg_score"), "n_orders")


def _del_orders_reviewed(L: Layers) -> DataFrame:
    return _del_orders_with_days(L).join(_reviews(L), "order_id", "inner")


def _score_by_bucket(df: DataFrame, bucket: F.Column, count_name: str) -> DataFrame:
    return (df.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy("bucket")
            .agg(rnd(mean("review_score"), 3).alias("avg_score"), F.count("review_score").alias(count_name)))


def a19_review_by_delay_bucket(L: Layers) -> DataFrame:
    return _score_by_bucket(_del_orders_reviewed(L), fixed_bucket("delivery_delay_days", DELAY_EDGES, DELAY_LABELS),
                            "n_orders")


def a20_ontime_vs_late(L: Layers) -> DataFrame:
    d = _del_orders_reviewed(L).where(F.col("is_delayed").isNotNull() & F.col("review_score").isNotNull())
    g = F.when(F.col("is_delayed") == 1, F.lit("late")).otherwise(F.lit("on_time"))
    c = d.groupBy(g.alias("delivery"), "review_score").agg(F.count(ONE()).alias("orders"))
    tot = d.groupBy(g.alias("delivery")).agg(F.count(ONE()).alias("_t"), mean("review_score").alias("_m"))
    delta = d.agg((mean(F.when(F.col("is_delayed") == 1, F.col("review_score")))
                   - mean(F.when(F.col("is_delayed") == 0, F.col("review_score")))).alias("_d"))
    return (c.join(tot, "delivery").crossJoin(F.broadcast(delta)).select(
        "delivery", "review_score", "orders", rnd(pct("orders", "_t")).alias("pct_of_group"),
        rnd("_m", 4).alias("avg_score"), rnd("_d", 4).alias("score_delta_late_vs_ontime")))


def a21_review_by_freight_bucket(L: Layers) -> DataFrame:
    return _score_by_bucket(_items_with_review(L), fixed_bucket("freight_value", FREIGHT_EDGES, FREIGHT_LABELS),
                            "n_items")


CORR_COLS = ["delivery_days", "delivery_delay_days", "total_order_revenue", "item_count", "freight_revenue",
             "review_score"]


def a22_correlation_matrix(L: Layers) -> DataFrame:
    """6×6 Pearson matrix in long form; the 15 pairs in one aggregate pass."""
    d = _del_orders_reviewed(L).where(F.col("total_order_revenue").isNotNull()).select(
        [F.col(c).cast("double").alias(c) for c in CORR_COLS])
    pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
    one = d.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
    upper = one.selectExpr(f"stack({len(pairs)}, {stack}) as (var_x, var_y, r)")
    lower = upper.select(F.col("var_y").alias("var_x"), F.col("var_x").alias("var_y"), "r")
    dstack = ", ".join(f"'{c}', '{c}', `{c}`" for c in CORR_COLS)
    diag = d.agg(*[F.corr(c, c).alias(c) for c in CORR_COLS]).selectExpr(
        f"stack({len(CORR_COLS)}, {dstack}) as (var_x, var_y, r)")
    return upper.unionByName(lower).unionByName(diag).withColumn("r", rnd("r", 4))


def a23_review_by_delivery_bin(L: Layers) -> DataFrame:
    return _score_by_bucket(_del_orders_reviewed(L),
                            fixed_bucket("delivery_days", DELIVERY_BIN_EDGES, DELIVERY_BIN_LABELS), "n_orders")


def a24_histograms(L: Layers) -> DataFrame:
    d = _del_orders_with_days(L).select(F.least(F.col("delivery_days"), F.lit(60.0)).alias("x"))
    f = _del_sales(L).select(F.least(F.col("freight_value").cast("double"), F.lit(80.0)).alias("x"))
    return histogram(d, "x", 50, "delivery_days").unionByName(histogram(f, "x", 60, "freight_value"))


EDA_JOBS = {name: fn for name, fn in dict(globals()).items() if name[:1] == "a" and name[1:3].isdigit()}
