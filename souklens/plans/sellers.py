"""Seller scorecard, tiers, performance flags and opportunity lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.buckets import QUINTILE_PROBS, quintile_of
from souklens.functions.numeric import mean, mean_days, money, ratio, rnd, share_if
from souklens.functions.quantiles import filled_quantiles
from souklens.functions.reuse import reused
from souklens.plans.context import Layers

def DELIVERED():
    return F.col("order_status") == "delivered"

# Tier labels, lowest bin first.
TIER_LABELS = ["Low", "Below Avg", "Average", "Above Avg", "High"]
FLAGS = ["Top Performer", "High Revenue, Low Satisfaction", "Hidden Gem (grow this)", "Delivery Problem",
         "Under-Performing", "Average"]


TIERS = [("total_revenue", "revenue_tier", False), ("avg_review_score", "review_tier", False),
         ("avg_delivery_days", "delivery_tier", True), ("late_rate_pct", "late_rate_tier", True)]


def with_tiers(df: DataFrame) -> DataFrame:
    """Quintile tiers, NULLs first filled with the column median; medians
    (``_m0`` …, in the order of ``TIERS``) and edges from one distributed pass."""
    scored = df.crossJoin(F.broadcast(filled_quantiles(df, [v for v, _, _ in TIERS], QUINTILE_PROBS)))
    for i, (value, out, reverse) in enumerate(TIERS):
        edges, v = F.col(f"_e{i}"), F.coalesce(F.col(value).cast("double"), F.col(f"_m{i}"))
        labels = TIER_LABELS[::-1] if reverse else TIER_LABELS
        scored = scored.withColumn(out, F.element_at(F.array(*[F.lit(x) for x in labels]),
                                                     quintile_of(v, edges, edges[0], edges[5])))
    return scored.drop(*[f"_e{i}" for i in range(len(TIERS))])


def seller_scorecard(L: Layers, columns: Sequence[str] | None = None) -> DataFrame:
    """I1-I6.  A job that reads only some columns names them: only those and
    the tiers' values are then kept for the second reading."""
    sa = L.enriched["seller_analytics"]
    oe = L.enriched["orders_enriched"]
    d_items = L.enriched["order_items_enriched"].where(DELIVERED())
    pairs = d_items.select("order_id", "seller_id").distinct()
    d_orders = oe.where(DELIVERED() & F.col("delivery_seconds").isNotNull()).select("order_id", "delivery_seconds", "is_delayed")
    rv = L.clean["order_reviews"].select("order_id", "review_score")
    who = oe.select("order_id", "customer_unique_id")
    # I2-I4 in one aggregate over the seller's distinct delivered orders; every
    # right side has one row per order, so the left joins keep the pair grain.
    # Unknown delivery and unreviewed orders stay in the share denominators.
    per = (pairs.join(d_orders, "order_id", "left").join(rv, "order_id", "left").join(who, "order_id", "left")
           .groupBy("seller_id").agg(
               mean_days("delivery_seconds").alias("avg_delivery_days"),
               share_if(F.col("is_delayed") == 1).alias("late_rate_pct"),
               F.count("order_id").alias("n_delivered"),
               share_if(F.col("review_score") == 5).alias("pct_5star"),
               share_if(F.col("review_score") == 1).alias("pct_1star"),
               F.count("review_score").alias("n_reviews"),
               F.nullif(F.count_distinct("customer_unique_id"), F.lit(0)).alias("n_customers_served")))
    sc = (sa.join(per, "seller_id", "left")
          .withColumn("seller_aov", ratio("total_revenue", "n_unique_orders")))
    if columns is not None:
        sc = sc.select(*dict.fromkeys([*columns, *[value for value, _, _ in TIERS]]))
    sc = with_tiers(reused(sc))
    return sc.withColumn("performance_flag", performance_flag())


def performance_flag() -> F.Column:
    """Tests in order; the first that holds wins."""
    good = ["High", "Above Avg"]
    poor = ["Low", "Below Avg"]
    rv_hi, rv_lo = F.col("revenue_tier").isin(good), F.col("revenue_tier").isin(poor)
    sat_good, sat_poor = F.col("review_tier").isin(good), F.col("review_tier").isin(poor)
    del_good, del_poor = F.col("delivery_tier").isin(good), F.col("delivery_tier").isin(poor)
    return (F.when(rv_hi & sat_good, FLAGS[0]).when(rv_hi & sat_poor, FLAGS[1])
            .when(rv_lo & sat_good & del_good, FLAGS[2]).when(del_poor, FLAGS[3])
            .when(sat_poor, FLAGS[4]).otherwise(FLAGS[5]))


SCORECARD_COLS = ["seller_id", "seller_state", "total_revenue", "n_unique_orders", "avg_review_score", "avg_delivery_days",
                  "late_rate_pct", "n_delivered", "pct_5star", "pct_1star", "n_reviews", "n_customers_served",
                  "seller_aov", "revenue_tier", "review_tier", "delivery_tier", "late_rate_tier", "performance_flag"]


ROUND4 = ("avg_review_score", "seller_aov", "avg_delivery_days", "late_rate_pct", "pct_5star", "pct_1star")


def i1_seller_scorecard(L: Layers) -> DataFrame:
    sc = seller_scorecard(L)
    return sc.select([money(c).alias(c) if c == "total_revenue" else
                      rnd(c, 4).alias(c) if c in ROUND4 else F.col(c) for c in SCORECARD_COLS])


def i7_opportunity_lists(L: Layers, limit: int = 20) -> DataFrame:
    """Five lists of at most ``limit`` sellers each, each with its own sort."""
    sc = seller_scorecard(L, ["seller_id"])
    spec = [("top_performers", FLAGS[0], F.desc("total_revenue")),
            ("high_rev_low_sat", FLAGS[1], F.desc("total_revenue")),
            ("hidden_gems", FLAGS[2], F.desc("avg_review_score")),
            ("delivery_problems", FLAGS[3], F.desc("late_rate_pct")),
            ("under_performing", FLAGS[4], F.asc("total_revenue"))]
    parts = [sc.where(F.col("performance_flag") == flag).orderBy(order, "seller_id").limit(limit)
             .select(F.lit(name).alias("list"), "seller_id", money("total_revenue").alias("total_revenue"),
                     rnd("avg_review_score", 4).alias("avg_review_score"),
                     rnd("late_rate_pct", 4).alias("late_rate_pct"))
             for name, flag, order in spec]
    return reduce(DataFrame.unionByName, parts)


def i8_flag_summary(L: Layers) -> DataFrame:
    return seller_scorecard(L, []).groupBy("performance_flag").agg(
        F.count(F.lit(1)).alias("sellers"), money(F.sum("total_revenue")).alias("revenue"))


def i9_seller_scatter(L: Layers, size_cap: int = 500) -> DataFrame:
    sc = seller_scorecard(L, ["seller_id", "n_unique_orders"])
    pts = sc.where(F.col("avg_review_score").isNotNull() & (F.col("total_revenue") > 0))
    return pts.select(
        "seller_id", money("total_revenue").alias("total_revenue"), rnd("avg_review_score", 4).alias("avg_review_score"),
        F.least(F.col("n_unique_orders"), F.lit(size_cap)).alias("size"), "performance_flag",
        rnd("_m1", 4).alias("median_review"), rnd("_m0").alias("median_revenue"))


SELLER_JOBS = {"i1_seller_scorecard": i1_seller_scorecard, "i7_opportunity_lists": i7_opportunity_lists,
               "i8_flag_summary": i8_flag_summary, "i9_seller_scatter": i9_seller_scatter}
