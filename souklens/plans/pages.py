"""Page-level tables (Y1-Y10) and the filter jobs built on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.buckets import fixed_bucket
from souklens.functions.numeric import brl, mean, mean_days, money, pct, ratio, rnd, share_if
from souklens.functions.quantiles import exact_quantiles
from souklens.operators.filters import (FilterSpec, apply_filters, apply_item_filters, apply_order_filters,
                                        filter_options, filter_sizes, kept_share)
from souklens.operators.summary import avg_of, summary_of
from souklens.plans.context import Layers
from souklens.sources.inline import local_table

# The 27 state codes of the reference's market (pass as
# ``universe`` to y09_state_coverage to reproduce its fixed list).
REFERENCE_STATES = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE",
                    "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")
# Registered example filter: delivered and shipped orders only.
EXAMPLE_FILTER = FilterSpec(order_statuses=("delivered", "shipped"))
# Registered example for the helper filters F21/F22: purchases from the
# first to the last day of 1995 (the end bound is that day's midnight).
EXAMPLE_DATES = (dt.date(1995, 1, 1), dt.date(1995, 12, 31))
# Registered examples of F20: one filter for each selector, and all together.
EXAMPLE_FILTERS = {
    "date": FilterSpec(date_range=EXAMPLE_DATES), "state": FilterSpec(customer_states=("NATION_1", "NATION_2", "NATION_3")),
    "status": EXAMPLE_FILTER, "category": FilterSpec(categories=("Category 1", "Category 2")),
    "seller state": FilterSpec(seller_states=("NATION_2", "NATION_4")), "score": FilterSpec(review_scores=(1, 5)),
    "all": FilterSpec(EXAMPLE_DATES, ("NATION_1", "NATION_2", "NATION_3"), EXAMPLE_FILTER.order_statuses, ("Category 1", "Category 2"),
                      ("NATION_2", "NATION_4"), (1, 5))}


def DELIVERED():
    return F.col("order_status") == "delivered"


def _bundle(L: Layers, spec: FilterSpec) -> dict[str, DataFrame]:
    return apply_filters(L.enriched["orders_enriched"], L.enriched["order_items_enriched"],
                         L.clean["order_reviews"], L.enriched["seller_analytics"], spec)


def y01_filtered_kpis(L: Layers, spec: FilterSpec = EXAMPLE_FILTER) -> DataFrame:
    """The eleven KPI values of the filtered bundle (0 where empty)."""
    b = _bundle(L, spec)
    o, it, rv = b["orders"], b["items"], b["reviews"]
    has = DELIVERED() & F.col("delivery_seconds").isNotNull()
    hd = has & F.col("is_delayed").isNotNull()
    oa = o.agg(F.count(F.lit(1)).alias("total_orders"), F.count_if(DELIVERED()).alias("delivered_orders"),
               F.coalesce(rnd(mean(F.when(DELIVERED(), F.col("total_order_revenue")))), F.lit(0.0)).alias("aov"),
               F.coalesce(rnd(pct(F.count_if(DELIVERED()), F.count(F.lit(1)))), F.lit(0.0)).alias("delivered_rate"),
               F.coalesce(rnd(mean_days(F.when(has, F.col("delivery_seconds")))), F.lit(0.0)).alias("avg_delivery_days"),
               F.coalesce(rnd(pct(F.count_if(hd & (F.col("is_delayed") == 1)), F.count_if(hd))), F.lit(0.0)).alias("late_rate"))
    ia = it.where(DELIVERED()).agg(money(F.coalesce(F.sum("item_revenue"), F.lit(0))).alias("total_revenue"))
    ra = rv.agg(F.coalesce(rnd(mean("review_score"), 4), F.lit(0.0)).alias("avg_review_score"))
    ca = L.enriched["customer_analytics"].agg(F.count_distinct("customer_unique_id").alias("total_customers"),
                                              rnd(pct(F.count_if("is_repeat_buyer"), F.count(F.lit(1)))).alias("repeat_buyer_rate"))
    sa = b["sellers"].agg(F.count(F.lit(1)).alias("total_sellers"))
    return oa.crossJoin(F.broadcast(ia)).crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(ca)).crossJoin(F.broadcast(sa))


def f20_filter_sizes(L: Layers, specs: dict[str, FilterSpec] | None = None) -> DataFrame:
    """rows that each filter keeps of orders, items, reviews and sellers."""
    return filter_sizes(L.enriched["orders_enriched"], L.enriched["order_items_enriched"], L.clean["order_reviews"],
                        L.enriched["seller_analytics"], specs or EXAMPLE_FILTERS)


def f23_filter_share(L: Layers, spec: FilterSpec = EXAMPLE_FILTER) -> DataFrame:
    return kept_share(L.enriched["orders_enriched"], _bundle(L, spec)["orders"])


def f21_order_filter(L: Layers, date_range=EXAMPLE_DATES, statuses=EXAMPLE_FILTER.order_statuses) -> DataFrame:
    """F21 on the whole orders table: kept orders per status and the purchase
    span they cover (the last kept purchase is at most the end day's midnight)."""
    o = apply_order_filters(L.enriched["orders_enriched"], date_range, None, statuses, ("voucher",))
    return o.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"),
                                         F.min("order_purchase_timestamp").alias("first_purchase"),
                                         F.max("order_purchase_timestamp").alias("last_purchase"))


def f22_item_filter(L: Layers, date_range=EXAMPLE_DATES, statuses=EXAMPLE_FILTER.order_statuses) -> DataFrame:
    """F22 on the whole item table: kept items, orders and revenue per status."""
    it = apply_item_filters(L.enriched["order_items_enriched"], date_range, None, None, None, statuses)
    per_order = it.groupBy("order_status", "order_id").agg(F.count(F.lit(1)).alias("n"), F.sum("item_revenue").alias("rev"))
    return per_order.groupBy("order_status").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("orders"),
                                                 money(F.sum("rev")).alias("revenue"))


def f24_filter_options(L: Layers) -> DataFrame:
    return filter_options(L.enriched["orders_enriched"], L.enriched["order_items_enriched"],
                          L.enriched["seller_analytics"], L.clean["order_payments"])


def y02_status_counts(L: Layers) -> DataFrame:
    return L.enriched["orders_enriched"].groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))


def y02_top5_category_share(L: Layers, k: int = 5) -> DataFrame:
    """Share of each of the top-k categories *within the top k*."""
    it = L.enriched["order_items_enriched"].where(DELIVERED() & F.col("product_category_name_english").isNotNull())
    c = it.groupBy(F.col("product_category_name_english").alias("category")).agg(F.sum("item_revenue").alias("_r"))
    top = c.orderBy(F.desc("_r"), "category").limit(k)
    tot = top.agg(F.sum("_r").alias("_t"))
    return top.crossJoin(F.broadcast(tot)).select("category", money("_r").alias("revenue"), rnd(pct("_r", "_t")).alias("share_of_top"))


def y08_state_summary(L: Layers) -> DataFrame:
    """Persons ⟗ delivered revenue ⟕ delivery days per state, NULL → 0, share."""
    ca = L.enriched["customer_analytics"].where(F.col("customer_state").isNotNull())
    o = L.enriched["orders_enriched"].where(DELIVERED() & F.col("customer_state").isNotNull())
    cs = ca.groupBy("customer_state").agg(F.count("customer_unique_id").alias("n_customers"),
                                          mean("total_spend_payment").alias("avg_spend"))
    rs = o.groupBy("customer_state").agg(F.coalesce(F.sum("total_order_revenue"), F.lit(0)).alias("revenue"))
    ds = o.where(F.col("delivery_seconds").isNotNull()).groupBy("customer_state").agg(
        mean_days("delivery_seconds").alias("avg_delivery_days"))
    s = cs.join(rs, "customer_state", "full_outer").join(ds, "customer_state", "left")
    s = s.select("customer_state", F.coalesce("n_customers", F.lit(0)).alias("n_customers"),
                 F.coalesce(rnd("avg_spend"), F.lit(0.0)).alias("avg_spend"),
                 F.coalesce(F.col("revenue"), F.lit(0)).alias("_rev"),
                 F.coalesce(rnd("avg_delivery_days"), F.lit(0.0)).alias("avg_delivery_days"))
    tot = s.agg(F.sum("_rev").alias("_t"))
    return s.crossJoin(F.broadcast(tot)).select("customer_state", "n_customers", "avg_spend", money("_rev").alias("revenue"),
                                   brl("_rev").alias("revenue_fmt"), "avg_delivery_days",
                                   rnd(pct("_rev", "_t"), 1).alias("rev_share"))


def y09_state_coverage(L: Layers, universe: tuple[str, ...] | None = None) -> DataFrame:
    """Both / Customers only / Neither per state.  The universe is a parameter;
    by default the states observed among customers or sellers."""
    spark = L.spark
    cs = L.enriched["customer_analytics"].where(F.col("customer_state").isNotNull()).select(
        F.col("customer_state").alias("state")).distinct().withColumn("has_customers", F.lit(True))
    ss = L.enriched["seller_analytics"].where(F.col("seller_state").isNotNull()).select(
        F.col("seller_state").alias("state")).distinct().withColumn("has_sellers", F.lit(True))
    if universe:
        u = local_table(spark, [(s,) for s in universe], "state string")
    else:
        u = cs.select("state").unionByName(ss.select("state")).distinct()
    x = u.join(cs, "state", "left").join(ss, "state", "left").select(
        "state", F.coalesce("has_customers", F.lit(False)).alias("has_customers"),
        F.coalesce("has_sellers", F.lit(False)).alias("has_sellers"))
    return x.withColumn("status", F.when(F.col("has_customers") & F.col("has_sellers"), "Both")
                        .when(F.col("has_customers"), "Customers only").otherwise("Neither"))


def y10_executive_figures(L: Layers) -> DataFrame:
    """Leading-state revenue share, on-time vs late score, top category vs
    mean, fastest/slowest state (≥100 orders), new-customer revenue share."""
    o = L.enriched["orders_enriched"].where(DELIVERED())
    st = o.where(F.col("customer_state").isNotNull()).groupBy("customer_state").agg(
        F.coalesce(F.sum("total_order_revenue"), F.lit(0)).alias("_r"))
    lead = st.agg(F.max(F.struct("_r", "customer_state")).alias("_m"), F.sum("_r").alias("_t")).select(
        F.col("_m.customer_state").alias("leading_state"), rnd(pct("_m._r", "_t")).alias("leading_state_share"))
    rv = L.clean["order_reviews"].select("order_id", "review_score")
    dr = o.where(F.col("delivery_seconds").isNotNull() & F.col("is_delayed").isNotNull()).join(rv, "order_id")
    sc = dr.agg(rnd(mean(F.when(F.col("is_delayed") == 0, F.col("review_score"))), 4).alias("ontime_score"),
                rnd(mean(F.when(F.col("is_delayed") == 1, F.col("review_score"))), 4).alias("late_score"))
    it = L.enriched["order_items_enriched"].where(DELIVERED() & F.col("product_category_name_english").isNotNull())
    cat = it.groupBy("product_category_name_english").agg(F.sum("item_revenue").alias("_r"))
    tc = cat.agg(F.max(F.struct("_r", "product_category_name_english")).alias("_m"), mean("_r").alias("_a")).select(
        F.col("_m.product_category_name_english").alias("top_category"), money("_m._r").alias("top_category_revenue"),
        rnd("_a").alias("mean_category_revenue"))
    sd = (o.where(F.col("delivery_seconds").isNotNull() & F.col("customer_state").isNotNull()).groupBy("customer_state")
          .agg(mean_days("delivery_seconds").alias("_d"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 100))
    fs = sd.agg(F.min(F.struct("_d", "customer_state")).alias("_f"), F.max(F.struct("_d", "customer_state")).alias("_s")).select(
        F.col("_f.customer_state").alias("fastest_state"), F.col("_s.customer_state").alias("slowest_state"))
    per = o.where(F.col("customer_unique_id").isNotNull()).groupBy("customer_unique_id").agg(
        F.count("order_id").alias("_n"), F.coalesce(F.sum("total_order_revenue"), F.lit(0)).alias("_r"))
    nc = per.agg(rnd(pct(F.sum(F.when(F.col("_n") == 1, F.col("_r"))), F.sum("_r"))).alias("one_time_revenue_share"))
    return lead.crossJoin(F.broadcast(sc)).crossJoin(F.broadcast(tc)).crossJoin(F.broadcast(fs)).crossJoin(F.broadcast(nc))


PAGE_JOBS = {"y01_filtered_kpis": y01_filtered_kpis, "f20_filter_sizes": f20_filter_sizes, "f21_order_filter": f21_order_filter,
             "f22_item_filter": f22_item_filter, "f23_filter_share": f23_filter_share,
             "f24_filter_options": f24_filter_options, "y02_status_counts": y02_status_counts,
             "y02_top5_category_share": y02_top5_category_share, "y08_state_summary": y08_state_summary,
             "y09_state_coverage": y09_state_coverage, "y10_executive_figures": y10_executive_figures}


def y03_sales_kpis(L: Layers) -> DataFrame:
    """Revenue split, AOV and the leading state's share of state revenue."""
    it = L.star["fact_sales"].where(DELIVERED())
    o = L.enriched["orders_enriched"].where(DELIVERED())
    a = it.agg(money(F.sum("item_revenue")).alias("total_revenue"), money(F.sum("price")).alias("product_revenue"),
               money(F.sum("freight_value")).alias("freight_revenue"))
    b = o.agg(rnd(mean("total_order_revenue")).alias("aov"))
    st = o.where(F.col("customer_state").isNotNull()).groupBy("customer_state").agg(
        F.coalesce(F.sum("total_order_revenue"), F.lit(0)).alias("_r"))
    c = st.agg(F.max(F.struct("_r", "customer_state")).alias("_m"), F.sum("_r").alias("_t")).select(
        F.col("_m.customer_state").alias("leading_state"), rnd(pct("_m._r", "_t")).alias("leading_state_share"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def y03_aov_by_month(L: Layers) -> DataFrame:
    """Mean order total per purchase month, with the overall mean."""
    o = L.enriched["orders_enriched"].where(DELIVERED())
    overall = o.agg(rnd(mean("total_order_revenue")).alias("overall_aov"))
    return o.groupBy(F.col("order_year_month").alias("ym_str")).agg(
        rnd(mean("total_order_revenue")).alias("aov")).crossJoin(F.broadcast(overall))


def y04_customer_kpis(L: Layers) -> DataFrame:
    """Persons, repeat buyers and rate, average spend and orders."""
    c = L.enriched["customer_analytics"]
    return c.agg(F.count_distinct("customer_unique_id").alias("total_customers"),
                 F.count_if("is_repeat_buyer").alias("repeat_buyers"),
                 rnd(pct(F.count_if("is_repeat_buyer"), F.count(F.lit(1)))).alias("repeat_rate"),
                 rnd(mean("total_spend_payment")).alias("avg_spend"), rnd(mean("total_orders"), 4).alias("avg_orders"))


def y05_product_kpis(L: Layers) -> DataFrame:
    """Categories sold, average price, median freight as % of price."""
    it = L.enriched["order_items_enriched"].where(DELIVERED())
    sold = L.star["fact_sales"].where(DELIVERED())  # prices need no product or seller join
    med = exact_quantiles(sold.withColumn("_fp", pct("freight_value", "price")), "_fp", [0.5])  # continuous ratio per item
    return it.agg(F.count_distinct("product_category_name_english").alias("total_categories"),
                  rnd(mean("price")).alias("avg_price")).crossJoin(F.broadcast(med.select(rnd(F.col("_q")[0]).alias("median_freight_pct"))))


def y05_category_table(L: Layers) -> DataFrame:
    """Per category revenue, items, average price and freight."""
    it = L.enriched["order_items_enriched"].where(DELIVERED() & F.col("product_category_name_english").isNotNull())
    return it.groupBy(F.col("product_category_name_english").alias("category")).agg(
        money(F.sum("item_revenue")).alias("revenue"), F.count("order_item_id").alias("items_sold"),
        rnd(mean("price")).alias("avg_price"), rnd(mean("freight_value")).alias("avg_freight"))


def y06_seller_kpis(L: Layers, top_n: int = 10) -> DataFrame:
    s = L.enriched["seller_analytics"]
    top = s.orderBy(F.desc("total_revenue"), "seller_id").limit(top_n).agg(F.sum("total_revenue").alias("_top"))
    a = s.agg(F.count(F.lit(1)).alias("sellers"), money(F.sum("total_revenue")).alias("total_revenue"),
              F.sum("total_revenue").alias("_all"))
    med = exact_quantiles(s, "total_revenue", [0.5]).select(rnd(F.col("_q")[0]).alias("median_revenue"))
    return a.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(med)).select("sellers", "total_revenue", "median_revenue", rnd(pct("_top", "_all")).alias("top10_share"))


def y06_sellers_by_state(L: Layers) -> DataFrame:
    s = L.enriched["seller_analytics"].where(F.col("seller_state").isNotNull())
    return (s.groupBy("seller_state").agg(F.sum("total_revenue").alias("_r"), F.count("seller_id").alias("n_sellers"),
                                          rnd(mean("avg_review_score"), 4).alias("avg_score"))
            .select("seller_state", money("_r").alias("revenue"), brl("_r").alias("rev_fmt"), "n_sellers", "avg_score"))


def y07_review_kpis(L: Layers) -> DataFrame:
    r = L.clean["order_reviews"]
    return r.agg(rnd(mean("review_score"), 4).alias("avg_score"), rnd(share_if(F.col("review_score") == 5)).alias("pct_5star"),
                 rnd(share_if(F.col("review_score") == 1)).alias("pct_1star"),
                 rnd(share_if(F.col("has_comment"))).alias("comment_rate"))


def y07_monthly_reviews(L: Layers) -> DataFrame:
    r = L.clean["order_reviews"].where(F.col("review_creation_date").isNotNull())
    return r.groupBy(F.date_format("review_creation_date", "yyyy-MM").alias("ym_str")).agg(
        F.count("review_id").alias("n_reviews"), rnd(mean("review_score"), 4).alias("avg_score"))


PAGE_JOBS.update({"y03_sales_kpis": y03_sales_kpis, "y03_aov_by_month": y03_aov_by_month,
                  "y04_customer_kpis": y04_customer_kpis, "y05_product_kpis": y05_product_kpis,
                  "y05_category_table": y05_category_table, "y06_seller_kpis": y06_seller_kpis,
                  "y06_sellers_by_state": y06_sellers_by_state, "y07_review_kpis": y07_review_kpis,
                  "y07_monthly_reviews": y07_monthly_reviews})


def y02_payment_counts(L: Layers, payment_types: tuple[str, ...] = ()) -> DataFrame:
    """Y2: payment rows per type, optionally limited to the selected types."""
    p = L.clean["order_payments"].where(F.col("payment_type").isNotNull())
    if payment_types:
        p = p.where(F.col("payment_type").isin(*payment_types))
    return p.groupBy("payment_type").agg(F.count(F.lit(1)).alias("payments"))


PAGE_JOBS["y02_payment_counts"] = y02_payment_counts


def _category_scores(L: Layers, orders: str, least: int) -> DataFrame:
    s = summary_of(L)
    overall = F.max(F.when(F.col("dim") == "total", avg_of("score"))).over(Window.partitionBy())
    rows = s.withColumn("_all", overall).where((F.col("dim") == "category") & F.col("key").isNotNull() & (F.col(orders) >= least))
    return rows.select(F.col("key").alias("category"), rnd(avg_of("score"), 4).alias("avg_score"), F.col(orders).alias("n_orders"),
                       rnd("_all", 4).alias("overall_score"),
                       F.when(avg_of("score") < 3.8, "low").when(avg_of("score") >= 4.2, "high").otherwise("middle").alias("band"))


def y05_category_scores(L: Layers, least_orders: int = 200) -> DataFrame:
    """Mean review score of the categories with many delivered orders,
    reviewed or not."""
    return _category_scores(L, "n_orders", least_orders)


def y06_top_sellers(L: Layers, top_n: int = 30) -> DataFrame:
    """The sellers with the highest revenue, as a table."""
    return (L.enriched["seller_analytics"].orderBy(F.desc("total_revenue"), "seller_id").limit(top_n)
            .select(F.concat(F.substring("seller_id", 1, 12), F.lit("…")).alias("seller_short"), "seller_state",
                    money("total_revenue").alias("total_revenue"), "n_unique_orders", "total_items_sold",
                    rnd("avg_review_score", 4).alias("avg_review_score"), "top_category"))


def y07_category_scores(L: Layers, least_orders: int = 200) -> DataFrame:
    """The same over reviewed orders alone."""
    return _category_scores(L, "reviewed_by_category", least_orders)


# The review page's own delay edges (days) and their labels.
PAGE_DELAY_EDGES = [-300, -14, -7, -3, 0, 3, 7, 14, 300]
PAGE_DELAY_LABELS = ["Early >14d", "Early 8-14d", "Early 3-7d", "Early ≤3d", "Late ≤3d", "Late 3-7d", "Late 7-14d", "Late >14d"]


def y07_delay_buckets(L: Layers) -> DataFrame:
    """Mean score and orders per delay bucket of the page's edges (beyond
    them an order counts in no bucket), with the on-time and late means of all."""
    o = L.enriched["orders_enriched"].where(DELIVERED() & F.col("delivery_seconds").isNotNull() & F.col("is_delayed").isNotNull())
    d = o.join(L.clean["order_reviews"].select("order_id", "review_score"), "order_id").groupBy(
        fixed_bucket("delivery_delay_days", PAGE_DELAY_EDGES, PAGE_DELAY_LABELS).alias("bucket"), "is_delayed").agg(
        F.sum("review_score").alias("s"), F.count("review_score").alias("n"))
    whole = Window.partitionBy()

    def score(late: int):
        return ratio(F.sum(F.when(F.col("is_delayed") == late, F.col("s"))).over(whole), F.sum(F.when(F.col("is_delayed") == late, F.col("n"))).over(whole))

    x = d.withColumns({"ontime": score(0), "late": score(1)}).groupBy("bucket", "ontime", "late").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return x.where(F.col("bucket").isNotNull() & (F.col("n") > 0)).select(
        "bucket", rnd(ratio("s", "n"), 4).alias("avg_score"), F.col("n").alias("orders"),
        rnd("ontime", 4).alias("ontime_score"), rnd("late", 4).alias("late_score"))


PAGE_JOBS.update({"y05_category_scores": y05_category_scores, "y06_top_sellers": y06_top_sellers,
                  "y07_category_scores": y07_category_scores, "y07_delay_buckets": y07_delay_buckets})
