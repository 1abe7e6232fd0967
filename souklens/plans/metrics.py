"""Documented metrics without code in the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.numeric import mean, mean_days, money, pct, ratio, rnd, share_if
from souklens.functions.quantiles import running_total
from souklens.plans.context import Layers

ONE_DAY = 86400.0


def DELIVERED():
    return F.col("order_status") == "delivered"


def _orders(L: Layers) -> DataFrame:
    return L.enriched["orders_enriched"]


def _del_items(L: Layers) -> DataFrame:
    return L.enriched["order_items_enriched"].where(DELIVERED())


def _person_months(L: Layers) -> DataFrame:
    o = _orders(L).where(DELIVERED() & F.col("customer_unique_id").isNotNull() & F.col("order_year_month").isNotNull())
    return o.select("customer_unique_id", "order_year_month").distinct()


def m01_new_customers_per_month(L: Layers) -> DataFrame:
    first = _person_months(L).groupBy("customer_unique_id").agg(F.min("order_year_month").alias("ym"))
    return first.groupBy(F.col("ym").alias("year_month")).agg(F.count(F.lit(1)).alias("new_customers"))


def m02_new_vs_returning(L: Layers) -> DataFrame:
    pm = _person_months(L)
    first = pm.groupBy("customer_unique_id").agg(F.min("order_year_month").alias("_f"))
    x = pm.join(first, "customer_unique_id")
    return x.groupBy(F.col("order_year_month").alias("year_month")).agg(
        F.count_if(F.col("order_year_month") == F.col("_f")).alias("new_customers"),
        F.count_if(F.col("order_year_month") > F.col("_f")).alias("returning_customers"))


def m03_payment_averages(L: Layers) -> DataFrame:
    p = L.clean["order_payments"]
    return p.agg(rnd(mean(F.when(F.col("payment_value") != 0, F.col("payment_value")))).alias("avg_payment_nonzero"),
                 rnd(mean(F.when(F.col("payment_type") == "credit_card", F.col("payment_installments"))), 4)
                 .alias("avg_credit_card_installments"))


def m04_voucher_and_multi_payment(L: Layers) -> DataFrame:
    per = L.clean["order_payments"].groupBy("order_id").agg(
        F.max((F.col("payment_type") == "voucher").cast("int")).alias("v"), F.count(F.lit(1)).alias("n"))
    return per.agg(rnd(share_if(F.col("v") == 1)).alias("voucher_order_pct"),
                   rnd(share_if(F.col("n") > 1)).alias("multi_payment_order_pct"))


def m05_installments_vs_value(L: Layers) -> DataFrame:
    p = L.clean["order_payments"].where(F.col("payment_installments").isNotNull())
    corr = p.agg(rnd(F.corr(F.col("payment_installments").cast("double"), F.col("payment_value").cast("double")), 4)
                 .alias("installments_value_corr"))
    return p.groupBy("payment_installments").agg(F.count(F.lit(1)).alias("payments"),
                                                 rnd(mean("payment_value")).alias("avg_payment_value")).crossJoin(F.broadcast(corr))


def m06_process_times(L: Layers) -> DataFrame:
    o = _orders(L)
    r = L.clean["order_reviews"]
    ho = o.agg(rnd(ratio(F.sum("approval_seconds"), F.count("approval_seconds") * 3600), 4).alias("avg_approval_hours"),
               rnd(mean_days(F.timestamp_diff("SECOND", F.col("order_approved_at"), F.col("order_delivered_carrier_date"))), 4)
               .alias("avg_carrier_handoff_days"))
    hr = r.agg(rnd(mean_days(F.timestamp_diff("SECOND", F.col("review_creation_date"), F.col("review_answer_timestamp"))), 4)
               .alias("avg_review_response_days"))
    return ho.crossJoin(F.broadcast(hr))


def _items_with_order_days(L: Layers) -> DataFrame:
    o = _orders(L).select("order_id", "customer_state", "delivery_seconds", "is_delayed")
    return _del_items(L).drop("is_delayed").join(o, "order_id", "left")


def m07_same_vs_cross_state(L: Layers) -> DataFrame:
    x = _items_with_order_days(L).where(F.col("customer_state").isNotNull() & F.col("seller_state").isNotNull())
    route = F.when(F.col("customer_state") == F.col("seller_state"), "same_state").otherwise("cross_state")
    return x.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("items"),
                                               F.count_distinct("order_id").alias("orders"),
                                               rnd(mean_days("delivery_seconds")).alias("avg_delivery_days"),
                                               rnd(mean("freight_value")).alias("avg_freight"))


def m08_delivery_over_time(L: Layers) -> DataFrame:
    d = _orders(L).where(DELIVERED() & F.col("delivery_seconds").isNotNull() & F.col("is_delayed").isNotNull())
    return d.groupBy(F.col("order_year_month").alias("year_month")).agg(
        rnd(mean_days("delivery_seconds")).alias("avg_delivery_days"), rnd(share_if(F.col("is_delayed") == 0)).alias("on_time_pct"))


def m09_comment_rate_by_score(L: Layers) -> DataFrame:
    r = L.clean["order_reviews"].where(F.col("review_score").isNotNull())
    return r.groupBy("review_score").agg(F.count(F.lit(1)).alias("reviews"), rnd(share_if(F.col("has_comment"))).alias("comment_pct"))


def m10_weight_correlations(L: Layers) -> DataFrame:
    i = _del_items(L).join(L.clean["order_reviews"].select("order_id", "review_score"), "order_id", "left")
    return i.agg(rnd(F.corr("product_weight_g", F.col("freight_value").cast("double")), 4).alias("weight_freight_corr"),
                 rnd(F.corr("product_weight_g", F.col("review_score").cast("double")), 4).alias("weight_review_corr"))


def m11_seller_diversity(L: Layers) -> DataFrame:
    pairs = (_del_items(L).where(F.col("product_category_name_english").isNotNull())
             .select(F.col("product_category_name_english").alias("category"), "seller_id").distinct())
    return pairs.groupBy("category").agg(F.count(F.lit(1)).alias("sellers"))


def value_groups(values: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Values (column ``x``, e.g. selling sellers' revenue) as groups (x, c sellers, s revenue) with ``c0``
    and ``s0``, the sellers and revenue of all lower values, and the one-row
    totals ``_n_c`` / ``_n_s``.

    Ranks inside a group of equal values do not change the Gini sum or any
    Lorenz point, so no per-seller rank (and no single ordered partition) is
    needed: the running total over value ranges is deterministic and a value
    shared by a third of all sellers is one row."""
    g = values.where(F.col("x").isNotNull()).groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("s"))
    cum, tot = running_total(g, "x", ["c", "s"], buckets)
    return (cum.withColumns({"c0": F.col("_cum_c") - F.col("c"), "s0": F.col("_cum_s") - F.col("s")})
            .drop("_cum_c", "_cum_s")), tot


def _seller_revenue(L: Layers) -> DataFrame:
    return L.enriched["seller_analytics"].select(F.col("total_revenue").cast("double").alias("x"))


def gini(values: DataFrame) -> DataFrame:
    """Gini = 2·Σ(i·x_i) / (n·Σx) − (n + 1) / n over ascending ``x``; the c
    rows of value x hold ranks c0+1 … c0+c, so they add x·(c·c0 + c(c+1)/2)."""
    g, _ = value_groups(values)
    ix = F.col("x") * (F.col("c") * F.col("c0") + F.col("c") * (F.col("c") + 1) / 2)
    return g.agg(F.sum("c").alias("sellers"), F.sum(ix).alias("_ix"), F.sum("s").alias("_x")).select(
        "sellers", rnd(F.lit(2.0) * F.col("_ix") / (F.col("sellers") * F.col("_x"))
                       - (F.col("sellers") + 1) / F.col("sellers"), 4).alias("gini"))


def m12_seller_gini(L: Layers) -> DataFrame:
    return gini(_seller_revenue(L))


def lorenz(values: DataFrame, points: int = 20) -> DataFrame:
    """Cumulative share of ``x`` at each 1/points of rows (ascending): point
    pt ends at rank R = floor(pt·n/points) when some rank falls in it
    (ceil(R·points/n) = pt); the revenue of the R smallest sellers comes from
    the value group holding rank R.  One aggregate with ``points``
    conditional sums; no per-seller rank."""
    g, tot = value_groups(values)
    x = g.crossJoin(F.broadcast(tot))
    n = F.col("_n_c")

    def end_rank(pt: int):
        return F.floor(F.lit(pt) * n / F.lit(points))

    aggs = [F.max(n).alias("_n"), F.max("_n_s").alias("_t")]
    for pt in range(1, points + 1):
        r = end_rank(pt)
        holds = (F.col("c0") < r) & (r <= F.col("c0") + F.col("c"))
        aggs.append(F.max(F.when(holds, F.col("s0") + (r - F.col("c0")) * F.col("x"))).alias(f"_c{pt}"))
    one = x.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(pt).alias("pt"), F.floor(F.lit(pt) * F.col("_n") / F.lit(points)).alias("r"),
                              F.col(f"_c{pt}").alias("c")) for pt in range(1, points + 1)])
    pts = one.select("_n", "_t", F.inline(rows))
    pts = pts.where((F.col("r") >= 1) & (F.ceil(F.col("r") * points / F.col("_n")) == F.col("pt")))
    return pts.select(F.col("pt").cast("int").alias("pt"), rnd(F.col("r") * 100.0 / F.col("_n")).alias("seller_pct"),
                      rnd(F.col("c") * 100.0 / F.col("_t")).alias("revenue_pct"))


def m12_lorenz_curve(L: Layers, points: int = 20) -> DataFrame:
    return lorenz(_seller_revenue(L), points)


def m13_freight_by_state(L: Layers) -> DataFrame:
    x = _items_with_order_days(L).where(F.col("customer_state").isNotNull())
    return x.groupBy("customer_state").agg(rnd(mean("freight_value")).alias("avg_freight"),
                                           rnd(pct(F.sum("freight_value"), F.sum("price"))).alias("freight_pct_of_price"))


def m13_aov_by_city(L: Layers, min_orders: int = 1) -> DataFrame:
    o = _orders(L).where(DELIVERED() & F.col("customer_city").isNotNull())
    return (o.groupBy("customer_state", "customer_city").agg(F.count(F.lit(1)).alias("orders"),
                                                             rnd(mean("total_order_revenue")).alias("aov"))
            .where(F.col("orders") >= min_orders))


def m13_aov_by_category(L: Layers) -> DataFrame:
    """Average revenue per order within each category (item revenue of the
    category summed per order first)."""
    i = _del_items(L).where(F.col("product_category_name_english").isNotNull())
    per = i.groupBy("product_category_name_english", "order_id").agg(F.sum("item_revenue").alias("r"))
    return per.groupBy(F.col("product_category_name_english").alias("category")).agg(
        F.count(F.lit(1)).alias("orders"), rnd(mean("r")).alias("category_aov"))


def m14_weekend_effect(L: Layers) -> DataFrame:
    o = _orders(L).where(DELIVERED()).join(L.clean["order_reviews"].select("order_id", "review_score"), "order_id", "left")
    wk = F.when(F.dayofweek("order_purchase_timestamp").isin(1, 7), "weekend").otherwise("weekday")
    return o.groupBy(wk.alias("day_type")).agg(F.count(F.lit(1)).alias("orders"),
                                               rnd(mean("total_order_revenue")).alias("aov"),
                                               rnd(mean("review_score"), 4).alias("avg_review_score"))


def m15_cancellation_by_category(L: Layers) -> DataFrame:
    i = L.enriched["order_items_enriched"].where(F.col("product_category_name_english").isNotNull())
    pairs = i.select(F.col("product_category_name_english").alias("category"), "order_id", "order_status").distinct()
    return pairs.groupBy("category").agg(F.count(F.lit(1)).alias("orders"),
                                         rnd(share_if(F.col("order_status") == "canceled")).alias("cancellation_pct"))


def m16_seller_satisfaction(L: Layers, min_orders: int = 30) -> DataFrame:
    s = L.enriched["seller_analytics"].where(F.col("n_unique_orders") >= min_orders)
    return s.select("seller_id", "n_unique_orders", rnd("avg_review_score", 4).alias("avg_review_score"))


def m16_low_score_factors(L: Layers) -> DataFrame:
    o = _orders(L).where(DELIVERED()).join(L.clean["order_reviews"].select("order_id", "review_score"), "order_id")
    grp = F.when(F.col("review_score") <= 2, "low (1-2)").otherwise("other (3-5)")
    return o.groupBy(grp.alias("score_group")).agg(
        F.count(F.lit(1)).alias("orders"), rnd(mean_days("delivery_seconds")).alias("avg_delivery_days"),
        rnd(share_if(F.col("is_delayed") == 1)).alias("late_pct"), rnd(mean("item_count"), 4).alias("avg_items"),
        rnd(mean("total_order_revenue")).alias("aov"))


def m17_review_by_category_order_grain(L: Layers) -> DataFrame:
    pairs = (_del_items(L).where(F.col("product_category_name_english").isNotNull())
             .select(F.col("product_category_name_english").alias("category"), "order_id").distinct())
    r = pairs.join(L.clean["order_reviews"].select("order_id", "review_score"), "order_id")
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("orders"), rnd(mean("review_score"), 4).alias("avg_review_score"))


METRIC_JOBS = {n: f for n, f in dict(globals()).items() if n[:1] == "m" and n[1:3].isdigit()}
__all__ = ["METRIC_JOBS", "money"]
