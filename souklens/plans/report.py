"""Reports from rules: N1, N2, N3 and A25 as data.

``report_rows`` is one table of every number that the reports quote: a row per
(domain, key), ranked within its domain, all of it bounded by the calendar and
the catalogue.  ``RULES`` are lines with placeholders.  A rule is joined to the
rows of its domain, and each placeholder is replaced by the row's own number
(``{revenue:2}``) or by one of another row (``{state.1.key}``, the first of its
domain; ``{month.last.key}``, the last).  Every number is computed once,
however many lines quote it.

Forms of a number: ``:0`` and ``:2`` with thousands separators, ``:p1`` and
``:p2`` plain with one and two decimals.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.numeric import mean, pct, ratio, rnd
from souklens.functions.quantiles import exact_quantiles
from souklens.operators.enrich import seller_sales
from souklens.operators.summary import avg_days_of, avg_of, summary_of
from souklens.plans import kpi, rfm
from souklens.plans.context import Layers
from souklens.sources.inline import local_table

MEASURES = ["orders", "items", "revenue", "aov", "share", "cum", "mean", "score", "days", "promised", "difference", "late", "rate",
            "value", "customers", "clv", "freight", "freight_share", "median", "n"]

# report, section, line, domain, first and last rank (0: all), title, metric, text
RULES: list[tuple] = [
    ("N1", 1, 1, "total", 1, 1, "Delivered Orders", "{orders:0}", "{orders:0} orders reached their buyer."),
    ("N1", 2, 1, "total", 1, 1, "Total Revenue", "R$ {revenue:2}", "These orders brought R$ {revenue:2}."),
    ("N1", 3, 1, "total", 1, 1, "Average Order Value", "R$ {aov:2}", "One of them is worth R$ {aov:2} on average."),
    ("N1", 4, 1, "persons", 1, 1, "Unique Customers", "{customers:0}", "They were placed by {customers:0} customers."),
    ("N1", 5, 1, "persons", 1, 1, "Repeat Customers", "{orders:0}", "{orders:0} of the customers ordered again."),
    ("N1", 6, 1, "persons", 1, 1, "Repeat Customer Rate", "{rate:p2}%", "That is {rate:p2}% of all customers."),
    ("N1", 7, 1, "total", 1, 1, "Average Delivery Time", "{days:p2} days", "From purchase to delivery it took {days:p2} days."),
    ("N1", 8, 1, "total", 1, 1, "Estimated Delivery Time", "{promised:p2} days", "Buyers were told {promised:p2} days."),
    ("N1", 9, 1, "total", 1, 1, "Average Delivery Difference", "{difference:p2} days", "Delivery and promise differ by {difference:p2} days."),
    ("N1", 10, 1, "total", 1, 1, "Delayed Order Rate", "{rate:p2}%", "{late:0} orders came after the promised day, {rate:p2}% of them all."),
    ("N1", 11, 1, "month", 1, 1, "Highest Revenue Month", "{key}", "{key} sold most: R$ {revenue:2} in {orders:0} orders."),
    ("N1", 12, 1, "total", 1, 1, "Lowest Revenue Month", "{month.last.key}", "{month.last.key} sold least: R$ {month.last.revenue:2} in {month.last.orders:0} orders."),
    ("N1", 13, 1, "category", 1, 1, "Top Revenue Category", "{key}", "{key} sold for R$ {revenue:2} in {orders:0} orders."),
    ("N1", 14, 1, "state", 1, 1, "Top Customer State", "{key}", "Buyers in {key} spent R$ {revenue:2} in {orders:0} orders."),
    ("N1", 15, 1, "payment", 1, 1, "Top Payment Method", "{key}", "R$ {value:2} were paid by {key}, for {orders:0} orders."),
    ("N2", 0, 1, "total", 1, 1, "", "", "# Marketplace report"),
    ("N2", 1, 1, "total", 1, 1, "", "", "## 1. Summary"),
    ("N2", 1, 2, "total", 1, 1, "", "", "{orders:0} delivered orders brought R$ {revenue:2}, R$ {aov:2} each."),
    ("N2", 1, 3, "persons", 1, 1, "", "", "They came from {customers:0} customers, of whom {orders:0} ({rate:p2}%) ordered again."),
    ("N2", 1, 4, "total", 1, 1, "", "", "Delivery took {days:p2} days where {promised:p2} were promised."),
    ("N2", 2, 1, "total", 1, 1, "", "", "## 2. Key figures"),
    ("N2", 2, 2, "total", 1, 1, "", "", "| Figure | Value |"),
    ("N2", 2, 3, "total", 1, 1, "", "", "| Delivered orders | {orders:0} |"),
    ("N2", 2, 4, "total", 1, 1, "", "", "| Revenue | R$ {revenue:2} |"),
    ("N2", 2, 5, "total", 1, 1, "", "", "| Order value | R$ {aov:2} |"),
    ("N2", 2, 6, "persons", 1, 1, "", "", "| Customers | {customers:0} |"),
    ("N2", 2, 7, "persons", 1, 1, "", "", "| Returning customers | {orders:0} |"),
    ("N2", 2, 8, "persons", 1, 1, "", "", "| Return rate | {rate:p2}% |"),
    ("N2", 2, 9, "total", 1, 1, "", "", "| Days to deliver | {days:p2} |"),
    ("N2", 2, 10, "total", 1, 1, "", "", "| Days promised | {promised:p2} |"),
    ("N2", 2, 11, "total", 1, 1, "", "", "| Days after the promise | {difference:p2} |"),
    ("N2", 2, 12, "total", 1, 1, "", "", "| Late orders | {late:0} |"),
    ("N2", 2, 13, "total", 1, 1, "", "", "| Late rate | {rate:p2}% |"),
    ("N2", 3, 1, "total", 1, 1, "", "", "## 3. Months"),
    ("N2", 3, 2, "month", 1, 1, "", "", "Best month: {key} with R$ {revenue:2} from {orders:0} orders."),
    ("N2", 3, 3, "total", 1, 1, "", "", "Weakest month: {month.last.key} with R$ {month.last.revenue:2} from {month.last.orders:0} orders."),
    ("N2", 3, 4, "total", 1, 1, "", "", "| Month | Orders | Revenue | Order value |"),
    ("N2", 3, 5, "month", 1, 0, "", "", "| {key} | {orders:0} | R$ {revenue:2} | R$ {aov:2} |"),
    ("N2", 4, 1, "total", 1, 1, "", "", "## 4. Categories"),
    ("N2", 4, 2, "category", 1, 1, "", "", "{key} leads with R$ {revenue:2}."),
    ("N2", 4, 3, "total", 1, 1, "", "", "| Category | Orders | Items | Revenue |"),
    ("N2", 4, 4, "category", 1, 20, "", "", "| {key} | {orders:0} | {items:0} | R$ {revenue:2} |"),
    ("N2", 5, 1, "total", 1, 1, "", "", "## 5. States"),
    ("N2", 5, 2, "state", 1, 1, "", "", "{key} leads with R$ {revenue:2}."),
    ("N2", 5, 3, "total", 1, 1, "", "", "| State | Orders | Revenue | Order value |"),
    ("N2", 5, 4, "state", 1, 0, "", "", "| {key} | {orders:0} | R$ {revenue:2} | R$ {aov:2} |"),
    ("N2", 6, 1, "total", 1, 1, "", "", "## 6. Payment"),
    ("N2", 6, 2, "payment", 1, 1, "", "", "Most was paid by {key}: R$ {value:2}."),
    ("N2", 6, 3, "total", 1, 1, "", "", "| Paid by | Orders | Value | Mean |"),
    ("N2", 6, 4, "payment", 1, 0, "", "", "| {key} | {orders:0} | R$ {value:2} | R$ {aov:2} |"),
    ("N2", 7, 1, "total", 1, 1, "", "", "## 7. Delivery"),
    ("N2", 7, 2, "total", 1, 1, "", "", "Orders took {days:p2} days; {promised:p2} were promised, a difference of {difference:p2} (below 0: earlier)."),
    ("N2", 7, 3, "total", 1, 1, "", "", "{late:0} orders ({rate:p2}%) came late."),
    ("N2", 8, 1, "total", 1, 1, "", "", "## 8. Returning customers"),
    ("N2", 8, 2, "persons", 1, 1, "", "", "{customers:0} customers had an order delivered, {orders:0} more than one: {rate:p2}%."),
    ("N2", 9, 1, "total", 1, 1, "", "", "## 9. Where to look next"),
    ("N2", 9, 2, "persons", 1, 1, "", "", "1. Returns: with {rate:p2}% coming back, what brings customers back is worth a study."),
    ("N2", 9, 3, "total", 1, 1, "", "", "2. Punctuality: {rate:p2}% of the orders are late; look at sellers, places and products."),
    ("N2", 9, 4, "category", 1, 1, "", "", "3. Assortment: {key} earns most; see how far it can grow."),
    ("N2", 9, 5, "state", 1, 1, "", "", "4. Places: {key} buys most; compare demand and freight elsewhere."),
    ("N2", 9, 6, "payment", 1, 1, "", "", "5. Payment: {key} is preferred; see whether it changes what is bought."),
    ("N2", 10, 1, "total", 1, 1, "", "", "## 10. In short"),
    ("N2", 10, 2, "total", 1, 1, "", "", "R$ {revenue:2} from {orders:0} delivered orders at R$ {aov:2}; returns, punctuality, categories, places and "
     "payment are where to dig."),
    ("N3", 1, 1, "category", 1, 1, "{key} earns most", "R$ {revenue:0}, mean of all categories R$ {mean:0}", "{key} sold for R$ {revenue:0}, more than any other."),
    ("N3", 2, 1, "month", 1, 1, "{key} was the peak", "R$ {revenue:0}, mean month R$ {mean:0}", "{key} brought R$ {revenue:0} where a month brings R$ {mean:0}."),
    ("N3", 3, 1, "total", 1, 1, "Late orders are rated lower", "on time {punctuality.on time.score:p2}, late {punctuality.late.score:p2}",
     "Orders on time score {punctuality.on time.score:p2}, late ones {punctuality.late.score:p2}."),
    ("N3", 4, 1, "persons", 1, 1, "Few customers return", "{rate:p2}% of {customers:0}",
     "{orders:0} of {customers:0} customers ordered again; they spend R$ {clv:0} each, the others R$ {aov:0}."),
    ("N3", 5, 1, "state", 1, 1, "{key} carries much of the revenue", "R$ {revenue:0} ({share:p1}%)", "{key} brings {share:p1}% of the revenue; the first three states {state.3.cum:p1}%."),
    ("N3", 6, 1, "total", 1, 1, "Delivery depends on the place", "{speed.1.key}: {speed.1.days:p1}, {speed.last.key}: {speed.last.days:p1} days",
     "From {speed.1.days:p1} days in {speed.1.key} to {speed.last.days:p1} in {speed.last.key}."),
    ("N3", 7, 1, "payment mix", 1, 1, "{key} is the usual payment", "{share:p1}% of {n:0} kinds", "{orders:0} payments ({share:p1}%) are made by {key}."),
    ("N3", 8, 1, "sellers", 1, 1, "Ten sellers stand out", "{share:p1}%, median seller R$ {median:0}",
     "The ten largest of {orders:0} sellers bring {share:p1}%; the median seller R$ {median:0}."),
    ("N3", 9, 1, "total", 1, 1, "{score.1.key} is rated lowest", "{score.1.score:p2}, all items {score:p2}",
     "Of the categories with 200 orders or more, {score.1.key} scores {score.1.score:p2}; all items {score:p2}."),
    ("N3", 10, 1, "segment", 1, 0, "New customers' share", "{customers:0} customers, R$ {revenue:0} ({share:p1}%)",
     "{customers:0} new customers bring {share:p1}% of the revenue."),
    ("A25", 1, 1, "state", 1, 1, "Concentration", "", "{key} brings R$ {revenue:0}; the first three states {state.3.cum:p1}%."),
    ("A25", 2, 1, "total", 1, 1, "Categories", "", "Most is earned by {category.1.key}, {category.2.key} and {category.3.key}."),
    ("A25", 3, 1, "payment mix", 1, 1, "Payment", "", "{share:p1}% of the payments are made by {key}, {payment mix.2.share:p1}% by {payment mix.2.key}."),
    ("A25", 4, 1, "total", 1, 1, "Lateness", "", "{rate:p1}% of the orders are late; they score {punctuality.late.score:p2}, the others {punctuality.on time.score:p2}."),
    ("A25", 5, 1, "month", 1, 1, "Season", "", "{key} is the peak with R$ {revenue:0}; a month brings R$ {mean:0}."),
    ("A25", 6, 1, "sellers", 1, 1, "Sellers", "", "The ten largest sellers bring {share:p1}%; the median seller R$ {median:0}."),
    ("A25", 7, 1, "total", 1, 1, "Delivery", "", "An order takes {days:p1} days, {speed.1.days:p1} in {speed.1.key} and {speed.last.days:p1} in {speed.last.key}."),
    ("A25", 8, 1, "persons", 1, 1, "Returns", "", "{rate:p2}% of {customers:0} customers ordered again."),
    ("A25", 9, 1, "total", 1, 1, "Freight", "", "Freight is R$ {freight:2} an item, {freight_share:p1}% of the revenue."),
    ("A25", 10, 1, "seller state", 1, 1, "Supply", "", "Sellers of {n:0} states deliver; {key} sells most, {share:p1}%."),
    ("A25", 11, 1, "total", 1, 1, "Waiting", "", "Orders within 5 days score {delivery.0-5d.score:p2}, those of 20 to 30 days {delivery.20-30d.score:p2}."),
    ("A25", 12, 1, "score", 1, 1, "Ratings", "", "{key} has the lowest score of the larger categories, {score:p2}."),
]
# Category and meaning of N1's rows, by section.
MEANINGS = [
    (1, "Overall Performance", "Completed-order volume behind the revenue figures."), (2, "Overall Performance", "Primary revenue KPI."),
    (3, "Overall Performance", "Baseline for basket-size strategies."), (4, "Customer", "Customer base of the delivered-order analysis."),
    (5, "Customer", "Observed returning segment."), (6, "Customer", "Retention is an opportunity area."), (7, "Delivery", "Logistics baseline."),
    (8, "Delivery", "Actual versus promised delivery."), (9, "Delivery", "Negative means earlier than estimated on average."),
    (10, "Delivery", "Share of completed orders past the estimate."), (11, "Monthly Performance", "Strongest monthly revenue period."),
    (12, "Monthly Performance", "Weakest monthly revenue period."), (13, "Product Category", "Leading revenue category."),
    (14, "Geography", "Largest revenue state."), (15, "Payment", "Dominant payment method.")]
# Domains whose rows are quoted by their key instead of their rank.
BY_KEY = ("punctuality", "delivery")


def _of_summary(L: Layers) -> DataFrame:
    """The domains that come from the one summary; a row may stand in two."""
    s, k = F.col("dim"), F.col("key")
    revenue = F.coalesce("order_value_sum", F.lit(0))

    def domain(name: str, of: str, by: Column, holds: Column | None = None, weight: Column | None = None) -> Column:
        here = (s == of) & (k.isNotNull() | F.lit(of == "total"))
        return F.when(here if holds is None else here & holds, F.struct(
            F.lit(name).alias("domain"), by.cast("decimal(38,10)").alias("by"), (by if weight is None else weight).cast("decimal(38,10)").alias("weight")))

    domains = [domain("total", "total", revenue), domain("month", "month", revenue), domain("category", "label", F.col("revenue")),
               domain("state", "customer_state", revenue), domain("seller state", "seller_state", F.col("revenue")),
               domain("speed", "customer_state", -avg_days_of("delivery", "delivery_n"), F.col("delivery_n") >= 100),
               domain("score", "category", -avg_of("score"), F.col("n_orders") >= 200),
               domain("delivery", "delivery_bin", F.col("n_orders")), domain("punctuality", "punctuality", F.col("n_orders"))]
    rows = summary_of(L).withColumn("d", F.explode(F.filter(F.array(*domains), lambda d: d.isNotNull()))).withColumn(
        "money", F.when(F.col("d.domain").isin("category", "seller state"), F.col("revenue")).otherwise(revenue))
    score = F.when(F.col("d.domain").isin("punctuality", "delivery"), avg_of("order_score")).otherwise(avg_of("score"))
    return rows.select(
        "d.domain", "key", "d.by", "d.weight", F.col("n_orders").cast("double").alias("orders"), F.col("n_items").cast("double").alias("items"),
        F.col("money").cast("double").alias("revenue"), ratio("money", "n_orders").alias("aov"), score.alias("score"),
        avg_days_of("delivery", "delivery_n").alias("days"), avg_days_of("estimated", "estimated_n").alias("promised"),
        avg_days_of("delay", "known").alias("difference"), F.col("late").cast("double").alias("late"), pct("late", "n_orders").alias("rate"),
        avg_of("freight").alias("freight"), pct("freight_sum", "revenue").alias("freight_share"))


def _paid(L: Layers) -> DataFrame:
    return kpi.k5_payment_performance(L.star).where(F.col("payment_type").isNotNull()).select(
        F.lit("payment").alias("domain"), F.col("payment_type").alias("key"), F.col("payment_value").cast("decimal(38,10)").alias("by"),
        F.col("orders").cast("double").alias("orders"), F.col("payment_value").alias("value"), F.col("average_payment_value").alias("aov"))


def _payment_mix(L: Layers) -> DataFrame:
    return L.clean["order_payments"].where(F.col("payment_type").isNotNull()).groupBy("payment_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("payment mix").alias("domain"), F.col("payment_type").alias("key"), F.col("n").cast("decimal(38,10)").alias("by"),
        F.col("n").cast("double").alias("orders"))


def _persons(L: Layers) -> DataFrame:
    c = L.clean
    per = (L.star["fact_orders"].where(F.col("order_status") == "delivered").select("customer_id", "order_id", "order_revenue")
           .join(c["customers"].select("customer_id", "customer_unique_id"), "customer_id")
           .groupBy("customer_unique_id").agg(F.count("order_id").alias("k"), F.sum("order_revenue").alias("r")))
    again = F.col("k") > 1
    return per.agg(F.count(F.lit(1)).cast("double").alias("customers"), F.count_if(again).cast("double").alias("orders"),
                   pct(F.count_if(again), F.count(F.lit(1))).alias("rate"), mean(F.when(again, F.col("r"))).alias("clv"),
                   mean(F.when(~again, F.col("r"))).alias("aov")).select(F.lit("persons").alias("domain"), "*")


def _sellers(L: Layers) -> DataFrame:
    c = L.clean
    # Every seller sold in some order: with that test each of the three readings
    # counts orders and so reads the numbered items of the summary, whose one
    # exchange serves all; the sums by seller are moved once.
    sold = (seller_sales(c["order_items"], c["orders"], c["order_reviews"]).where(F.col("n_unique_orders") > 0)
            .select("seller_id", "total_revenue"))
    top = sold.orderBy(F.desc("total_revenue"), "seller_id").limit(10).agg(F.sum("total_revenue").alias("_top"))
    return (sold.agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum("total_revenue").alias("_all")).crossJoin(F.broadcast(top))
            .crossJoin(F.broadcast(exact_quantiles(sold, "total_revenue", [0.5])))
            .select(F.lit("sellers").alias("domain"), "orders", pct("_top", "_all").alias("own_share"), F.col("_q")[0].alias("median")))


def _new_customers(L: Layers) -> DataFrame:
    return rfm.r13_segment_summary(L).where(F.col("segment") == "New Customers").select(
        F.lit("segment").alias("domain"), F.col("segment").alias("key"), F.col("n_customers").cast("double").alias("customers"),
        F.col("total_revenue").alias("revenue"), F.col("revenue_share_pct").alias("own_share"))


OWN_DOMAINS = {"payment": _paid, "payment mix": _payment_mix, "persons": _persons, "sellers": _sellers, "segment": _new_customers}


def _domains(rules: list[tuple]) -> set[str]:
    """The domains that rules stand on or quote."""
    quoted = {name.split(".")[0] for r in rules for t in r[6:] for name in re.findall(r"\{([^}]+)\}", t) if "." in name}
    return quoted | {r[3] for r in rules}


def report_rows(L: Layers, rules: list[tuple] = RULES) -> DataFrame:
    """(domain, key, rank, n, measures…): all numbers that the rules quote."""
    own = [build(L) for name, build in OWN_DOMAINS.items() if name in _domains(rules)]
    empty = L.spark.createDataFrame([], "own_share double, value double, customers double, clv double, median double")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_of_summary(L), *own, empty])
    weight = F.coalesce("weight", "by")
    # a domain has as many rows as there are months, categories or states
    ranked = Window.partitionBy("domain").orderBy(F.desc("by"), "key")
    whole = Window.partitionBy("domain")
    rows = rows.withColumns({"rank": F.row_number().over(ranked), "n": F.count(F.lit(1)).over(whole).cast("double"),
                             "mean": ratio(F.sum("by").over(whole), F.count(F.lit(1)).over(whole)),
                             "share": F.coalesce(F.col("own_share"), pct(weight, F.sum(weight).over(whole))),
                             "cum": pct(F.sum(weight).over(ranked.rowsBetween(Window.unboundedPreceding, 0)), F.sum(weight).over(whole))})
    return rows.select("domain", "key", "rank", *MEASURES)


def _texts(prefix: Column) -> Column:
    """Entries (name, text) of a row's key and of its numbers in all forms."""
    def forms(m: str) -> list[Column]:
        x = F.col(m)
        return [F.struct(F.concat(prefix, F.lit(f"{m}:{f}")).alias("name"), t.alias("text")) for f, t in (
            ("0", F.format_number(rnd(x, 0), 0)), ("2", F.format_number(rnd(x), 2)),
            ("p1", F.format_string("%.1f", rnd(x, 1))), ("p2", F.format_string("%.2f", rnd(x))))]

    every = [F.struct(F.concat(prefix, F.lit("key")).alias("name"), F.col("key").alias("text")), *(f for m in MEASURES for f in forms(m))]
    shown = [F.lit(True), *(F.col(m).isNotNull() for m in MEASURES for _ in range(4))]
    pairs = F.array(*[F.when(ok, e) for ok, e in zip(shown, every)])
    return F.filter(pairs, lambda e: e.isNotNull() & e["text"].isNotNull())


def report(L: Layers, name: str, rules: list[tuple] | None = None) -> DataFrame:
    """(section, line, rank, key, title, metric, text) of a report; a number
    that does not exist is shown as n/a."""
    rules = [r for r in rules or RULES if r[0] == name]
    rows = report_rows(L, rules)
    by_rank = F.when(F.col("rank") <= 3, F.col("rank").cast("string"))
    place = F.when(F.col("domain").isin(*BY_KEY), F.col("key")).otherwise(by_rank)
    last = F.when((F.col("rank") == F.col("n")) & ~F.col("domain").isin(*BY_KEY), _texts(F.concat("domain", F.lit(".last."))))
    quoted = F.concat(F.coalesce(F.when(place.isNotNull(), _texts(F.concat_ws(".", "domain", place, F.lit("")))), F.array().cast("array<struct<name:string,text:string>>")),
                      F.coalesce(last, F.array().cast("array<struct<name:string,text:string>>")))
    # some hundred rows: each carries what the others may be quoted with
    rows = rows.withColumns({"own": F.map_from_entries(_texts(F.lit(""))), "quoted": quoted}).withColumn(
        "others", F.map_from_entries(F.flatten(F.collect_list("quoted").over(Window.partitionBy()))))
    table = local_table(L.spark, [r[1:] for r in rules],
                        "section int, line int, domain string, first int, last int, title string, metric string, text string")
    lines = rows.join(F.broadcast(table), "domain").where((F.col("rank") >= F.col("first")) & ((F.col("last") == 0) | (F.col("rank") <= F.col("last"))))

    def render(c: str) -> Column:
        names = F.regexp_extract_all(F.col(c), F.lit(r"\{([^}]+)\}"), F.lit(1))
        return F.aggregate(names, F.col(c), lambda s, n: F.replace(s, F.concat(F.lit("{"), n, F.lit("}")), F.coalesce(
            F.try_element_at("own", n), F.try_element_at("others", n), F.lit("n/a"))))

    return lines.select("section", "line", "rank", F.coalesce("key", F.lit("")).alias("key"), *[render(c).alias(c) for c in ("title", "metric", "text")])


def n01_business_insights(L: Layers) -> DataFrame:
    """Fifteen insights, each with its category, value and meaning."""
    meanings = local_table(L.spark, MEANINGS, "section int, category string, business_meaning string")
    return report(L, "N1").join(F.broadcast(meanings), "section").select(
        "category", F.col("title").alias("metric"), F.col("metric").alias("value"), F.col("text").alias("observation"), "business_meaning")


def n02_report_lines(L: Layers) -> DataFrame:
    """The report's ten sections as numbered lines."""
    x = report(L, "N2")
    return x.select("section", "key", F.col("text").alias("line"),
                    F.row_number().over(Window.orderBy("section", F.col("line"), "rank")).alias("seq"))


def n03_executive_insights(L: Layers) -> DataFrame:
    """Ten insights with their metric."""
    return report(L, "N3").select(F.col("section").alias("id"), "title", "metric", F.col("text").alias("detail"))


def a25_eda_insights(L: Layers) -> DataFrame:
    """Twelve lines from the exploratory metrics."""
    return report(L, "A25").select(F.col("section").alias("id"), F.col("title").alias("topic"), F.col("text").alias("insight"))


REPORT_JOBS = {"n01_business_insights": n01_business_insights, "n02_report_lines": n02_report_lines, "n03_executive_insights": n03_executive_insights, "a25_eda_insights": a25_eda_insights}
