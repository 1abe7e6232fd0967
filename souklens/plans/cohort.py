"""Monthly cohorts, retention and customer lifetime value.

Orders are first reduced to distinct (person, month) pairs — at most one row
per person per month — so the per-person first month and the join back are
bounded even for a person holding a large share of all orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.buckets import histogram
from souklens.functions.numeric import mean, money, pct, rnd
from souklens.functions.quantiles import exact_quantiles
from souklens.plans.context import Layers

def DELIVERED():
    return F.col("order_status") == "delivered"


def _person_months(L: Layers) -> DataFrame:
    o = L.enriched["orders_enriched"].where(DELIVERED() & F.col("order_purchase_timestamp").isNotNull()
                                            & F.col("customer_unique_id").isNotNull())
    ts = F.col("order_purchase_timestamp")
    return o.select("customer_unique_id", F.date_format(ts, "yyyy-MM").alias("ym"),
                    (F.year(ts) * 12 + F.month(ts)).alias("mno")).distinct()


def cohort_long(L: Layers) -> DataFrame:
    """H1: cohort month × period number: distinct persons, cohort size, retention %."""
    # a person has at most one row per month of the calendar
    first = F.min(F.struct("mno", "ym")).over(Window.partitionBy("customer_unique_id"))
    x = _person_months(L).withColumn("_f", first).select(
        "customer_unique_id", F.col("_f.ym").alias("cohort_ym"), (F.col("mno") - F.col("_f.mno")).alias("period_number"))
    cells = x.groupBy("cohort_ym", "period_number").agg(F.count(F.lit(1)).alias("n_customers"))
    sizes = cells.where(F.col("period_number") == 0).select("cohort_ym", F.col("n_customers").alias("cohort_size"))
    return (cells.join(sizes, "cohort_ym")
            .withColumn("retention_pct", rnd(pct("n_customers", "cohort_size"))))


def h1_cohort_retention(L: Layers) -> DataFrame:
    return cohort_long(L)


def cohort_rows(L: Layers) -> DataFrame:
    """H2 as sparse rows: per cohort its size and ``rates``, a map from every
    period in which somebody returned to the retention %.  Exact for any number
    of periods; a row holds as many entries as the calendar has months."""
    return cohort_long(L).groupBy("cohort_ym", "cohort_size").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("period_number", "retention_pct")))).alias("rates"))


def cohort_pivot(L: Layers, periods: list[int]) -> DataFrame:
    """H2/H5: the given period numbers as columns, retention % (0.0 where no
    one returned), beside the cohort's size and its sparse row.  The period
    list is a parameter, so no pass over the data is needed to discover its
    columns, and what lies beyond it stays in ``rates``."""
    return cohort_rows(L).select("cohort_ym", "cohort_size", *[F.coalesce(F.try_element_at("rates", F.lit(k)), F.lit(0.0)).alias(f"p{k}")
                                                                for k in periods], "rates")


def h5_cohort_heatmap(L: Layers, n_periods: int = 13) -> DataFrame:
    """H5: the first periods of the cohorts that have any of them."""
    return cohort_pivot(L, list(range(n_periods))).drop("rates")


def h3_cohort_range(L: Layers) -> DataFrame:
    o = L.enriched["orders_enriched"].where(DELIVERED() & F.col("customer_unique_id").isNotNull())
    return o.agg(F.min("order_purchase_timestamp").alias("first_purchase"),
                 F.max("order_purchase_timestamp").alias("last_purchase"),
                 F.count_distinct(F.date_format("order_purchase_timestamp", "yyyy-MM")).alias("n_cohort_months"))


def h4_cohort_summary(L: Layers) -> DataFrame:
    """Returned = sum of n_customers over periods ≥ 1 (a person may count twice)."""
    c = cohort_long(L)
    sizes = c.where(F.col("period_number") == 0).select("cohort_ym", "cohort_size")
    ret = c.where(F.col("period_number") >= 1).groupBy("cohort_ym").agg(F.sum("n_customers").alias("_r"))
    return (sizes.join(ret, "cohort_ym", "left")
            .select("cohort_ym", "cohort_size", F.coalesce("_r", F.lit(0)).cast("bigint").alias("returned_customers"))
            .withColumn("return_rate_pct", rnd(pct("returned_customers", "cohort_size"))))


def _per_person(L: Layers) -> DataFrame:
    d = L.enriched["orders_enriched"].where(DELIVERED() & F.col("customer_unique_id").isNotNull())
    return d.groupBy("customer_unique_id").agg(
        F.count("order_id").alias("orders"),
        F.coalesce(F.sum("total_order_revenue"), F.lit(0).cast("decimal(28,2)")).alias("clv"))


def h6_h7_repeat_summary(L: Layers) -> DataFrame:
    """H6 + H7: one-time vs repeat counts, rate, average orders, revenue and
    average CLV of each group."""
    p = _per_person(L)
    one, rep = F.col("orders") == 1, F.col("orders") >= 2
    return p.agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(one).alias("one_time_buyers"),
        F.count_if(rep).alias("repeat_buyers"), rnd(pct(F.count_if(rep), F.count(F.lit(1)))).alias("repeat_rate_pct"),
        rnd(mean("orders"), 4).alias("avg_orders"),
        money(F.coalesce(F.sum(F.when(one, F.col("clv"))), F.lit(0))).alias("revenue_one_time"),
        money(F.coalesce(F.sum(F.when(rep, F.col("clv"))), F.lit(0))).alias("revenue_repeat"),
        rnd(mean(F.when(one, F.col("clv")))).alias("avg_clv_one_time"),
        rnd(mean(F.when(rep, F.col("clv")))).alias("avg_clv_repeat"))


def h8_frequency_distribution(L: Layers) -> DataFrame:
    c = _per_person(L).groupBy("orders").agg(F.count(F.lit(1)).alias("customers"))
    tot = c.agg(F.sum("customers").alias("_t"))
    return c.crossJoin(F.broadcast(tot)).select("orders", "customers", rnd(pct("customers", "_t")).alias("pct")).drop("_t")


def h9_clv_distribution(L: Layers, bins: int = 60, upper_q: float = 0.99) -> DataFrame:
    """CLV values up to the 99th percentile: mean, median and a histogram."""
    p = _per_person(L).withColumn("clv", F.col("clv").cast("double"))
    # one value per person: exact quantiles without gathering them in one task
    q = exact_quantiles(p, "clv", [upper_q, 0.5])
    kept = p.crossJoin(F.broadcast(q.select(F.col("_q")[0].alias("_p99")))).where(F.col("clv") <= F.col("_p99"))
    stats = p.agg(rnd(mean("clv")).alias("mean_clv")).crossJoin(F.broadcast(q.select(rnd(F.col("_q")[1]).alias("median_clv"))))
    return histogram(kept, "clv", bins, "clv").crossJoin(F.broadcast(stats))


def h10_clv_by_orders(L: Layers) -> DataFrame:
    return _per_person(L).groupBy("orders").agg(rnd(mean("clv")).alias("avg_clv"))


COHORT_JOBS = {"h1_cohort_retention": h1_cohort_retention, "h3_cohort_range": h3_cohort_range,
               "h4_cohort_summary": h4_cohort_summary, "h5_cohort_heatmap": h5_cohort_heatmap,
               "h6_h7_repeat_summary": h6_h7_repeat_summary, "h8_frequency_distribution": h8_frequency_distribution,
               "h9_clv_distribution": h9_clv_distribution, "h10_clv_by_orders": h10_clv_by_orders}


# Ten years of monthly periods as columns; every later one is in ``rates``.
ALL_PERIODS = tuple(range(120))


def h2_cohort_pivot_all(L: Layers, periods: tuple[int, ...] = ALL_PERIODS) -> DataFrame:
    """H2: cohorts × period numbers (0.0 where nobody returned), and the whole
    sparse row as text (``period:rate`` by period)."""
    text = F.array_join(F.transform(F.map_entries("rates"), lambda e: F.format_string("%d:%.2f", e["key"], e["value"])), ",")
    return cohort_pivot(L, list(periods)).withColumn("rates", text)


COHORT_JOBS["h2_cohort_pivot_all"] = h2_cohort_pivot_all
