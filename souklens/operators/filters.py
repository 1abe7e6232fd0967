"""Global dashboard filters (F20-F24) as lazy DataFrame transforms.

Items and reviews follow the filtered orders through a left-semi join on
order_id (no driver-side id sets); option lists are distinct projections.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterSpec:
    date_range: tuple[dt.date, dt.date] | None = None     # purchase day, inclusive on both ends
    customer_states: tuple[str, ...] = ()
    order_statuses: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()                      # English category names
    seller_states: tuple[str, ...] = ()
    review_scores: tuple[int, ...] = ()
    payment_types: tuple[str, ...] = ()                   # offered but, as in the source, never applied to orders


def in_months(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Rows whose year and month columns, where the table has them, fall into
    the months of the days ``first`` to ``last``.  They follow from a filter on
    the purchase time; said of the partition columns of a stored table, they
    keep its other folders closed."""
    if "order_year" in df.columns:
        df = df.where(F.col("order_year").between(first.year, last.year))
    if "order_year_month" in df.columns:
        df = df.where(F.col("order_year_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}"))
    return df


def _between_midnights(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    start, end = (F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz") for d in (first, last))
    return in_months(df, first, last).where((F.col("order_purchase_timestamp") >= start) & (F.col("order_purchase_timestamp") <= end))


def order_condition(spec: FilterSpec) -> Column:
    """F20 order part: calendar-day range (inclusive), states, statuses."""
    keep = F.lit(True)
    if spec.date_range:
        keep &= F.to_date("order_purchase_timestamp").between(F.lit(spec.date_range[0]), F.lit(spec.date_range[1]))
    if spec.customer_states:
        keep &= F.col("customer_state").isin(*spec.customer_states)
    if spec.order_statuses:
        keep &= F.col("order_status").isin(*spec.order_statuses)
    return F.coalesce(keep, F.lit(False))


def item_condition(spec: FilterSpec) -> Column:
    """F20 item part, beside the item's order being kept."""
    keep = F.lit(True)
    if spec.categories:
        keep &= F.col("product_category_name_english").isin(*spec.categories)
    return F.coalesce(keep, F.lit(False)) & seller_condition(spec)


def review_condition(spec: FilterSpec) -> Column:
    """F20 review part, beside the review's order being kept."""
    return F.coalesce(F.col("review_score").isin(*spec.review_scores), F.lit(False)) if spec.review_scores else F.lit(True)


def seller_condition(spec: FilterSpec) -> Column:
    return F.coalesce(F.col("seller_state").isin(*spec.seller_states), F.lit(False)) if spec.seller_states else F.lit(True)


def filter_orders_by_day(orders: DataFrame, spec: FilterSpec) -> DataFrame:
    """F20 order part."""
    return (in_months(orders, *spec.date_range) if spec.date_range else orders).where(order_condition(spec))


def apply_filters(orders: DataFrame, items: DataFrame, reviews: DataFrame, sellers: DataFrame,
                  spec: FilterSpec) -> dict[str, DataFrame]:
    """the filtered bundle.  Items and reviews keep only rows of kept orders."""
    o = filter_orders_by_day(orders, spec)
    kept = o.select("order_id")
    it = in_months(items, *spec.date_range) if spec.date_range else items
    return {"orders": o, "items": it.join(kept, "order_id", "left_semi").where(item_condition(spec)),
            "reviews": reviews.join(kept, "order_id", "left_semi").where(review_condition(spec)),
            "sellers": sellers.where(seller_condition(spec))}


def filter_sizes(orders: DataFrame, items: DataFrame, reviews: DataFrame, sellers: DataFrame,
                 specs: dict[str, FilterSpec]) -> DataFrame:
    """How many rows each of several filters keeps: (filter, orders, items,
    reviews, sellers).  Every table is read once for all of them: an order
    carries one flag per filter, and items and reviews meet the flags by
    order_id."""
    names = list(specs)
    flagged = orders.select("order_id", *[order_condition(s).alias(f"_o{k}") for k, s in enumerate(specs.values())])

    def kept(df: DataFrame, condition, name: str) -> DataFrame:
        return df.agg(*[F.count_if(condition(k, s)).alias(f"{name}{k}") for k, s in enumerate(specs.values())])

    one = kept(flagged, lambda k, s: F.col(f"_o{k}"), "orders")
    for name, df, condition in (("items", items, item_condition), ("reviews", reviews, review_condition)):
        one = one.crossJoin(F.broadcast(kept(df.join(flagged, "order_id"), lambda k, s: F.col(f"_o{k}") & condition(s), name)))
    one = one.crossJoin(F.broadcast(kept(sellers, lambda k, s: seller_condition(s), "sellers")))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), *[F.col(f"{t}{k}").alias(t) for t in ("orders", "items", "reviews", "sellers")])
                                          for k, n in enumerate(names)])).alias("r")).select("r.*")


def apply_order_filters(orders: DataFrame, date_range=None, customer_states=None, order_statuses=None,
                        payment_types=None) -> DataFrame:
    """timestamp range whose end bound is midnight of the end date (so
    that day's later orders fall outside); payment_types is accepted and
    ignored, as in the source."""
    o = orders
    if date_range and date_range[0] and date_range[1]:
        o = _between_midnights(o, *date_range)
    if customer_states:
        o = o.where(F.col("customer_state").isin(*customer_states))
    if order_statuses:
        o = o.where(F.col("order_status").isin(*order_statuses))
    return o


def apply_item_filters(items: DataFrame, date_range=None, customer_states=None, categories=None, seller_states=None,
                       order_statuses=None) -> DataFrame:
    """the same rules on item rows (customer_states unused, as in the source)."""
    it = items
    if date_range and date_range[0] and date_range[1]:
        it = _between_midnights(it, *date_range)
    if categories:
        it = it.where(F.col("product_category_name_english").isin(*categories))
    if seller_states:
        it = it.where(F.col("seller_state").isin(*seller_states))
    if order_statuses:
        it = it.where(F.col("order_status").isin(*order_statuses))
    return it


def kept_share(orders: DataFrame, filtered: DataFrame) -> DataFrame:
    """orders kept by the filters, and their share of all orders."""
    a = filtered.agg(F.count(F.lit(1)).alias("kept_orders"))
    b = orders.agg(F.count(F.lit(1)).alias("total_orders"))
    return a.crossJoin(F.broadcast(b)).withColumn(
        "kept_pct", F.round((F.col("kept_orders") * 100.0 / F.nullif(F.col("total_orders"), F.lit(0))).cast("decimal(38,10)"), 1)
        .cast("double"))


def filter_options(orders: DataFrame, items: DataFrame, sellers: DataFrame, payments: DataFrame) -> DataFrame:
    """(option, value) rows for every selector plus the date bounds."""
    def opt(df, col, name):
        return df.where(F.col(col).isNotNull()).select(F.lit(name).alias("option"), F.col(col).cast("string").alias("value")).distinct()

    bounds = orders.agg(F.min(F.to_date("order_purchase_timestamp")).alias("mn"),
                        F.max(F.to_date("order_purchase_timestamp")).alias("mx"))
    dates = bounds.selectExpr("stack(2, 'min_date', cast(mn as string), 'max_date', cast(mx as string)) as (option, value)")
    parts = [opt(orders, "customer_state", "customer_state"), opt(sellers, "seller_state", "seller_state"),
             opt(items, "product_category_name_english", "category"), opt(orders, "order_status", "order_status"),
             opt(payments, "payment_type", "payment_type"), dates]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
