"""RFM scoring and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.buckets import with_quintiles
from souklens.functions.numeric import mean, money, pct, rnd
from souklens.functions.reuse import reused
from souklens.functions.stats import asc, first_of
from souklens.plans.context import Layers
from souklens.sources.inline import local_table

# Fixed values: (R, F) score pair → segment; pairs not listed → Hibernating.
SEGMENT_MAP = {
    (5, 5): "Champions", (5, 4): "Champions", (4, 5): "Champions",
    (4, 4): "Loyal Customers", (3, 5): "Loyal Customers", (3, 4): "Loyal Customers",
    (5, 3): "Potential Loyalists", (4, 3): "Potential Loyalists", (5, 2): "Potential Loyalists",
    (5, 1): "New Customers", (4, 1): "New Customers",
    (3, 1): "Promising", (3, 2): "Promising",
    (4, 2): "Need Attention", (3, 3): "Need Attention",
    (2, 5): "At Risk", (2, 4): "At Risk", (2, 3): "At Risk", (2, 2): "At Risk",
    (1, 5): "Can't Lose Them", (1, 4): "Can't Lose Them",
    (1, 3): "Hibernating", (1, 2): "Hibernating", (2, 1): "Hibernating",
    (1, 1): "Lost",
}
DEFAULT_SEGMENT = "Hibernating"


def segment_table(spark) -> DataFrame:
    """The 25-row lookup (a fixed, provably tiny broadcast side)."""
    return local_table(spark, [(r, f, s) for (r, f), s in SEGMENT_MAP.items()], "R int, F int, segment string")


def compute_rfm(L: Layers, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per person with a delivered, revenue-bearing order.  A job
    that reads only some columns names them: only those and the scored values
    are then kept for the second reading."""
    o = L.enriched["orders_enriched"].where((F.col("order_status") == "delivered")
                                            & F.col("total_order_revenue").isNotNull()
                                            & F.col("customer_unique_id").isNotNull())
    per = o.groupBy("customer_unique_id").agg(
        F.max("order_purchase_timestamp").alias("last_order_date"),
        F.min("order_purchase_timestamp").alias("first_order_date"),
        F.count("order_id").alias("frequency"),
        F.sum("total_order_revenue").alias("monetary"),
        # the place of the person's first order, in the same pass
        first_of(asc("order_purchase_timestamp") + asc("order_id"), ["customer_state", "customer_city"]))
    per = per.withColumns({"customer_state": F.col("_best.customer_state"), "customer_city": F.col("_best.customer_city")}).drop("_best")
    if columns is not None:
        per = per.select(*dict.fromkeys([*columns, "last_order_date", "frequency", "monetary"]))
    # the last day of all is the last of the persons' own: the orders are read once
    per = reused(per)
    snap = per.agg((F.max("last_order_date") + F.expr("INTERVAL 1 DAY")).alias("_snap"))
    rfm = per.crossJoin(F.broadcast(snap)).withColumn(
        "recency_days", F.floor(F.timestamp_diff("SECOND", F.col("last_order_date"), F.col("_snap")) / 86400).cast("int")).drop("_snap")
    # recency (days) and frequency (order counts) have calendar/count-bounded
    # domains; a person's spend does not, so its edges stay distributed
    rfm = with_quintiles(rfm, [("recency_days", "R", True), ("frequency", "F", False),
                                            ("monetary", "M", False)], distributed=("monetary",))
    rfm = rfm.withColumn("rfm_score", F.concat(F.col("R").cast("string"), F.col("F").cast("string"),
                                               F.col("M").cast("string")))
    seg = F.broadcast(segment_table(L.spark))
    return (rfm.join(seg, ["R", "F"], "left")
            .withColumn("segment", F.coalesce(F.col("segment"), F.lit(DEFAULT_SEGMENT))))


RFM_COLS = ["customer_unique_id", "recency_days", "frequency", "monetary", "R", "F", "M", "rfm_score", "segment",
            "customer_state", "customer_city", "last_order_date", "first_order_date"]


def r11_rfm_table(L: Layers) -> DataFrame:
    return compute_rfm(L).select([money(c).alias(c) if c == "monetary" else F.col(c) for c in RFM_COLS])


def r13_segment_summary(L: Layers) -> DataFrame:
    s = compute_rfm(L, ["customer_unique_id"]).groupBy("segment").agg(
        F.count("customer_unique_id").alias("n_customers"), rnd(mean("recency_days")).alias("avg_recency"),
        rnd(mean("frequency"), 4).alias("avg_frequency"), rnd(mean("monetary")).alias("avg_monetary"),
        F.sum("monetary").alias("_rev"))
    tot = s.agg(F.sum("_rev").alias("_tot"))
    return s.crossJoin(F.broadcast(tot)).select("segment", "n_customers", "avg_recency", "avg_frequency", "avg_monetary",
                                   money("_rev").alias("total_revenue"),
                                   rnd(pct("_rev", "_tot")).alias("revenue_share_pct"))


def r14_segment_headcounts(L: Layers) -> DataFrame:
    s = F.col("segment")
    return compute_rfm(L, []).agg(
        F.count_if(s == "Champions").alias("champions"), F.count_if(s == "New Customers").alias("new_customers"),
        F.count_if(s.isin("At Risk", "Can't Lose Them")).alias("at_risk"), F.count_if(s == "Lost").alias("lost"))


def r15_score_distributions(L: Layers) -> DataFrame:
    long = compute_rfm(L, []).selectExpr("stack(3, 'R', R, 'F', F, 'M', M) as (score_type, score)")
    return long.groupBy("score_type", "score").agg(F.count(F.lit(1)).alias("customers"))


RFM_JOBS = {"r11_rfm_table": r11_rfm_table, "r13_segment_summary": r13_segment_summary,
            "r14_segment_headcounts": r14_segment_headcounts, "r15_score_distributions": r15_score_distributions}
