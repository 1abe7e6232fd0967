"""Monthly growth, trends and rule-based opportunities.

Windows here run over the monthly aggregate (one row per calendar month), so
their single partition is bounded by the calendar, not by the data; those of
the opportunities run over the summary (a row per category, state and month).
Top-N lists are joined back as semi joins (no driver-side lists).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.numeric import mean, money, pct, ratio, rnd, share_if
from souklens.functions.reuse import reused
from souklens.operators.enrich import seller_sales
from souklens.operators.summary import avg_days_of, avg_of, summary_of
from souklens.plans.context import Layers


def DELIVERED():
    return F.col("order_status") == "delivered"


# Growth flag threshold (fraction) and opportunity priorities in order.
GROWTH_FLAG_THRESHOLD = 0.20
PRIORITY_ORDER = ["Critical", "High", "Medium", "Low"]


def _monthly(L: Layers) -> DataFrame:
    it = L.star["fact_sales"].where(DELIVERED())
    o = L.enriched["orders_enriched"].where(DELIVERED())
    rev = it.groupBy(F.col("order_year_month").alias("ym_str")).agg(F.sum("item_revenue").alias("revenue"))
    n = o.groupBy(F.col("order_year_month").alias("ym_str")).agg(F.count("order_id").alias("n_orders"))
    return (rev.join(n, "ym_str", "full_outer").where(F.col("ym_str").isNotNull())
            .withColumn("aov", ratio("revenue", "n_orders")))


def monthly_growth(L: Layers) -> DataFrame:
    """pandas pct_change: previous *observed* row with NULLs padded forward;
    NULL (not inf) on a zero base."""
    w = Window.orderBy("ym_str")
    m = _monthly(L).withColumn("revenue", F.col("revenue").cast("double")).withColumn("n_orders", F.col("n_orders").cast("double"))
    for c in ("revenue", "n_orders", "aov"):
        m = m.withColumn(f"_{c}_f", F.last(F.col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        m = m.withColumn(f"_{c}_p", F.lag(f"_{c}_f").over(w))
        m = m.withColumn(f"_{c}_mom", (ratio(f"_{c}_f", f"_{c}_p") - F.lit(1.0)) * F.lit(100.0))
    t = GROWTH_FLAG_THRESHOLD * 100
    flag = (F.when(F.col("_revenue_mom").isNull(), "normal").when(F.col("_revenue_mom") >= t, "strong_growth")
            .when(F.col("_revenue_mom") <= -t, "decline").otherwise("normal"))
    return m.withColumn("rev_flag", flag)


def w10_monthly_growth(L: Layers) -> DataFrame:
    return monthly_growth(L).select(
        "ym_str", rnd("revenue").alias("revenue"), F.col("n_orders").cast("bigint").alias("n_orders"), rnd("aov").alias("aov"),
        rnd("_revenue_mom").alias("rev_mom_pct"), rnd("_n_orders_mom").alias("orders_mom_pct"),
        rnd("_aov_mom").alias("aov_mom_pct"), "rev_flag")


def _top_keys(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("_v"))
    return agg.orderBy(F.desc("_v"), key).limit(n).select(key)


def w11_category_trend(L: Layers, top_n: int = 10) -> DataFrame:
    it = L.enriched["order_items_enriched"].where(DELIVERED())
    top = _top_keys(it, "product_category_name_english", "item_revenue", top_n)
    return (it.join(top, "product_category_name_english", "left_semi")
            .groupBy(F.col("order_year_month").alias("ym_str"), F.col("product_category_name_english").alias("category"))
            .agg(money(F.sum("item_revenue")).alias("revenue")))


def w12_state_trend(L: Layers, top_n: int = 8) -> DataFrame:
    o = L.enriched["orders_enriched"].where(DELIVERED())
    top = _top_keys(o, "customer_state", "total_order_revenue", top_n)
    return (o.join(top, "customer_state", "left_semi")
            .groupBy(F.col("order_year_month").alias("ym_str"), F.col("customer_state").alias("state"))
            .agg(money(F.coalesce(F.sum("total_order_revenue"), F.lit(0))).alias("revenue")))


def w13_growth_headline(L: Layers) -> DataFrame:
    """Peak month, mean revenue, last vs second month growth, strong months."""
    m = monthly_growth(L).withColumn("_rn", F.row_number().over(Window.orderBy("ym_str")))
    n = m.agg(F.max("_rn").alias("_n"))
    x = m.crossJoin(F.broadcast(n))
    return x.agg(
        F.min(F.when(F.col("revenue").isNotNull(), F.struct((-F.col("revenue")).alias("k"), F.col("ym_str").alias("m")))).alias("_pk"),
        mean("revenue").alias("_avg"),
        F.max(F.when(F.col("_rn") == F.col("_n"), F.col("revenue"))).alias("_last"),
        F.max(F.when(F.col("_rn") == 2, F.col("revenue"))).alias("_second"),
        F.count_if(F.col("rev_flag") == "strong_growth").alias("strong_growth_months")).select(
        F.col("_pk.m").alias("peak_month"), rnd(-F.col("_pk.k")).alias("peak_revenue"), rnd("_avg").alias("avg_revenue"),
        rnd(pct(F.col("_last") - F.col("_second"), "_second")).alias("total_growth_pct"), "strong_growth_months")


def w14_rolling_revenue(L: Layers, window: int = 3) -> DataFrame:
    w = Window.orderBy("ym_str").rowsBetween(-(window - 1), 0)
    m = _monthly(L)
    return m.select("ym_str", money("revenue").alias("revenue"),
                    rnd(ratio(F.sum("revenue").over(w), F.count("revenue").over(w))).alias("rolling_revenue"))


# --------------------------------------------------------------------------- opportunities

OPP_COLS = ["title", "description", "metric_value", "category", "priority"]
UPLIFT_ORDERS = 2000  # orders that a doubled repeat rate is taken to add


def _fmt0(c) -> F.Column:
    """Thousands-separated whole number, rounded half-up first so the text
    does not depend on an engine's tie-breaking."""
    return F.format_number(rnd(F.col(c) if isinstance(c, str) else c, 0), 0)


def _rule(number: int, limit: int, holds, order, title, description, metric, category: str, priority: str) -> F.Column:
    """One rule as a struct: whether it holds for the row, the number that its
    rows are ranked by, how many may stay, and the text."""
    return F.struct(F.lit(number).alias("rule"), F.lit(limit).alias("most"), F.coalesce(holds, F.lit(False)).alias("holds"),
                    order.cast("decimal(38,10)").alias("by"), title.alias("title"), description.alias("description"),
                    metric.alias("metric_value"), F.lit(category).alias("category"), F.lit(priority).alias("priority"))


def opportunities(L: Layers, uplift_orders: int = UPLIFT_ORDERS) -> DataFrame:
    """Rule-based opportunity rows, ordered by priority.

    All rules read one summary (a row per category, state, month and total)
    with the sellers at risk and the repeat rate added as rows.  References
    such as the mean over categories are windows over these few rows, and each
    row gives the rules that hold for it, so nothing is read or joined twice.
    The sellers' orders are counted too: they then read the same numbered items
    as the summary, and one exchange of the items serves both.  Summary and
    repeat rate share the customers."""
    if not L.stored:
        L = L.with_clean(customers=reused(L.clean["customers"].select("customer_id", "customer_unique_id", "customer_state")))
    c = L.clean
    risk = (seller_sales(c["order_items"], c["orders"], c["order_reviews"])
            .where((F.col("total_revenue") > 10000) & (F.col("avg_review_score") < 3.5))
            .agg(F.count(F.lit(1)).alias("n_sellers"), F.sum("total_revenue").alias("at_risk"), F.sum("n_unique_orders").alias("n_orders"))
            .select(F.lit("risk").alias("dim"), "n_sellers", "at_risk", "n_orders"))
    persons = (c["orders"].where(DELIVERED()).join(c["customers"].select("customer_id", "customer_unique_id"), "customer_id")
               .where(F.col("customer_unique_id").isNotNull()).groupBy("customer_unique_id").agg(F.count("order_id").alias("n"))
               .agg(share_if(F.col("n") > 1).alias("repeat_rate")).select(F.lit("persons").alias("dim"), "repeat_rate"))
    rows = summary_of(L).unionByName(risk, allowMissingColumns=True).unionByName(persons, allowMissingColumns=True)
    every = Window.partitionBy()
    is_cat, known_key = F.col("dim") == "category", F.col("key").isNotNull()
    big, wide = is_cat & known_key & (F.col("n_orders") >= 200), is_cat & known_key & (F.col("n_items") >= 500)
    total = F.col("dim") == "total"
    place = F.when(F.col("dim").isin("customer_state", "seller_state"), F.col("key"))
    rows = rows.withColumns({
        "avg_score": avg_of("score"), "avg_price": avg_of("price"), "late_rate": pct("late", "known"),
        "avg_delay": avg_days_of("delay", "known"),
        "all_revenue": ratio(F.sum(F.when(big, F.col("revenue"))).over(every), F.count(F.when(big, F.col("revenue"))).over(every)),
        "all_score": F.max(F.when(total, avg_of("score"))).over(every), "all_price": F.max(F.when(total, avg_of("price"))).over(every),
        "p75": F.percentile(F.when(wide, F.col("n_items").cast("double")), 0.75).over(every),
        "aov": F.max(F.when(total, avg_of("order_value"))).over(every),
        "sold_from": F.max(F.when(F.col("dim") == "seller_state", F.lit(1))).over(Window.partitionBy(place))})
    state = (F.col("dim") == "customer_state") & known_key
    rules = F.array(
        # O1: categories with >= 200 orders, revenue above the mean, score 0.3 below overall
        _rule(1, 3, big & (F.col("revenue") > F.col("all_revenue")) & (F.col("avg_score") < F.col("all_score") - 0.3), F.col("revenue"),
              F.format_string("Raise the quality of '%s'", "key"),
              F.format_string("Sells for R$%s but scores %.2f of 5, %.2f below all items.",
                              _fmt0("revenue"), rnd("avg_score"), rnd(F.col("all_score") - F.col("avg_score"))),
              F.format_string("Revenue R$%s, score %.2f", _fmt0("revenue"), rnd("avg_score")), "Customer Satisfaction", "High"),
        # O2: states with >= 100 delivered orders and no seller that delivered
        _rule(2, 4, state & F.col("sold_from").isNull() & (F.col("n_orders") >= 100), F.col("n_orders"),
              F.format_string("Find sellers in %s", "key"),
              F.format_string("Customers in %s placed %s delivered orders, and no seller of that state delivered any.", "key", _fmt0("n_orders")),
              F.format_string("Orders %s, sellers 0", _fmt0("n_orders")), "Geographic Expansion", "High"),
        # O3: categories >= 500 items, items above p75, average price below half the overall
        _rule(3, 2, wide & (F.col("n_items") > F.col("p75")) & (F.col("avg_price") < F.col("all_price") * 0.5), F.col("n_items"),
              F.format_string("Sell '%s' in bundles", "key"),
              F.format_string("%s items at R$%.2f each on average, where all items cost R$%.2f.",
                              _fmt0("n_items"), rnd("avg_price"), rnd("all_price")),
              F.format_string("Items %s, average price R$%.2f", _fmt0("n_items"), rnd("avg_price")), "Revenue Growth", "Medium"),
        # States with >= 200 orders of known punctuality and late rate above 15 %
        _rule(4, 3, state & (F.col("known") >= 200) & (F.col("late_rate") > 15), F.col("late_rate"),
              F.format_string("Deliver on time in %s", "key"),
              F.format_string("%.1f%% of the orders to %s came late.", rnd("late_rate", 1), "key"),
              F.format_string("Late %.1f%%, average delay %.1f days", rnd("late_rate", 1), rnd("avg_delay", 1)), "Logistics", "High"),
        # Sellers above 10,000 revenue with a score below 3.5 (a row only if any)
        _rule(5, 1, (F.col("dim") == "risk") & (F.col("n_sellers") > 0), F.col("n_sellers"),
              F.format_string("Help %d strong sellers with weak reviews", "n_sellers"),
              F.format_string("%d sellers with more than R$10,000 score below 3.5; they stand for R$%s.", "n_sellers", _fmt0("at_risk")),
              F.format_string("Sellers %d, revenue R$%s", "n_sellers", _fmt0("at_risk")), "Seller Management", "High"),
        # Repeat-rate uplift (always one row)
        _rule(6, 1, F.col("dim") == "persons", F.lit(1),
              F.concat(F.lit("Bring buyers back: "), F.format_string("%.0f%% buy once", rnd(F.lit(100.0) - F.col("repeat_rate"), 0))),
              F.format_string("%.1f%% of the customers order again; twice as many would add some R$%s.",
                              rnd("repeat_rate", 1), _fmt0(F.col("aov") * uplift_orders)),
              F.format_string("Repeat rate %.1f%%", rnd("repeat_rate", 1)), "Customer Retention", "Critical"))
    ranked = (rows.select("key", F.explode(rules).alias("r")).select("key", "r.*").where("holds")
              .withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("by"), "key"))))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY_ORDER]), F.col("priority"))
    return ranked.where(F.col("place") <= F.col("most")).select(*OPP_COLS).withColumn("priority_rank", rank.cast("int"))


def o7_opportunities(L: Layers) -> DataFrame:
    """All opportunities by priority; equal ones by title."""
    return opportunities(L).select(*OPP_COLS, "priority_rank").orderBy("priority_rank", "title")


def o8_opportunities_by_category(L: Layers, priorities: tuple[str, ...] = tuple(PRIORITY_ORDER)) -> DataFrame:
    return (opportunities(L).where(F.col("priority").isin(*priorities)).groupBy("category")
            .agg(F.count(F.lit(1)).alias("opportunities")))


GROWTH_JOBS = {"w10_monthly_growth": w10_monthly_growth, "w11_category_trend": w11_category_trend,
               "w12_state_trend": w12_state_trend, "w13_growth_headline": w13_growth_headline,
               "w14_rolling_revenue": w14_rolling_revenue, "o7_opportunities": o7_opportunities,
               "o8_opportunities_by_category": o8_opportunities_by_category}
