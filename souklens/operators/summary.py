"""Delivered items summarised by several keys in one pass.

Category, customer state, seller state, month, delivery time, punctuality and the total come from one
``GROUPING SETS`` aggregate over the delivered orders' items, so a job that
needs several of them reads each table once.

Order-grain numbers (orders, lateness, order value) are added up on one marked
row of each order, so they need no distinct counts: the marks are windows over
the rows of one order, which already lie together after the join on order_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.dates import year_month
from souklens.functions.buckets import fixed_bucket
from souklens.functions.numeric import days_from_seconds, ratio, seconds_between

# Grouped columns and the names of the sets that they stand for, in order.
SETS = {"category": "category", "customer_state": "customer_state", "seller_state": "seller_state", "ym": "month",
        "label": "label", "delivery_bin": "delivery_bin", "punctuality": "punctuality"}
# Delivery-time bins (days, right-closed) and their labels.
DELIVERY_EDGES = [0, 5, 10, 15, 20, 30, 60, 300]
DELIVERY_LABELS = ["0-5d", "5-10d", "10-15d", "15-20d", "20-30d", "30-60d", "60d+"]
TOTAL = "total"


def delivered_rows(orders: DataFrame, customers: DataFrame, items: DataFrame, reviews: DataFrame, products: DataFrame,
                   translation: DataFrame, sellers: DataFrame) -> DataFrame:
    """One row per item of a delivered order with its keys; a delivered order
    without items keeps one row.  ``first_of_order``, ``first_of_category`` and
    ``first_of_seller_state`` mark one row of the order and of each of its
    categories and seller states; ``order_value`` is the order's revenue."""
    p = "order_purchase_timestamp"
    o = orders.where(F.col("order_status") == "delivered").select(
        "order_id", "customer_id", year_month(p).alias("ym"),
        seconds_between(p, "order_delivered_customer_date").alias("delivery_seconds"),
        seconds_between(p, "order_estimated_delivery_date").alias("estimated_seconds"),
        seconds_between("order_estimated_delivery_date", "order_delivered_customer_date").alias("delay_seconds"))
    english = F.col("product_category_name_english")
    kinds = products.select("product_id", "product_category_name").join(translation, "product_category_name", "left").select(
        "product_id", F.coalesce(english, "product_category_name").alias("_name"), english.isNotNull().alias("_english"))
    late = F.col("delay_seconds") > 0
    # The items meet products and sellers with their own columns alone, and carry
    # one name and a mark back instead of two names; what belongs to the order
    # joins once they are back with it, and the customers meet the orders, not
    # their items.
    sold = (items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
            .join(o.select("order_id"), "order_id", "left_semi")
            .join(kinds, "product_id", "left").drop("product_id")
            .join(sellers.select("seller_id", "seller_state"), "seller_id", "left").drop("seller_id"))
    rows = (o.join(customers.select("customer_id", "customer_state"), "customer_id", "left")
            .join(sold, "order_id", "left")
            .join(reviews.select("order_id", "review_score", F.lit(1).alias("reviewed")), "order_id", "left")
            .withColumns({"category": F.when(F.col("_english"), F.col("_name")),
                          "label": F.when(F.col("order_item_id").isNotNull(), F.coalesce("_name", F.lit("Unknown"))),
                          "delivery_bin": fixed_bucket(days_from_seconds("delivery_seconds"), DELIVERY_EDGES, DELIVERY_LABELS),
                          "punctuality": F.when(late, "late").when(~late, "on time")}).drop("_name", "_english"))
    one = Window.partitionBy("order_id")

    def first(*keys: str) -> Column:
        return F.row_number().over(Window.partitionBy("order_id", *keys).orderBy("order_item_id")) == 1

    return rows.withColumns({
        "first_of_order": first(), "first_of_category": first("category"), "first_of_seller_state": first("seller_state"),
        "first_of_label": first("label"),
        "order_value": F.sum("price").over(one) + F.sum("freight_value").over(one)})


def delivered_summary(rows: DataFrame) -> DataFrame:
    """(dim, key, …): the sums and counts of ``delivered_rows`` for each
    category (English name, or with the own name where it has none as
    ``label``), customer state, seller state, month, delivery time and
    punctuality, and in total."""
    mark = F.col("first_of_order")

    def of_order(value: str | Column) -> Column:
        return F.when(mark, value)

    late = F.col("delay_seconds") > 0
    sets = [[c] for c in SETS] + [[]]
    wide = rows.groupingSets([[F.col(c) for c in s] for s in sets], *SETS).agg(
        F.grouping_id().alias("gid"),
        F.count("order_item_id").alias("n_items"),
        F.sum(F.col("price") + F.col("freight_value")).alias("revenue"),
        F.sum("price").alias("price_sum"), F.count("price").alias("price_n"),
        F.sum("freight_value").alias("freight_sum"), F.count("freight_value").alias("freight_n"),
        F.sum(F.when(F.col("order_item_id").isNotNull(), F.col("review_score"))).alias("score_sum"),
        F.count(F.when(F.col("order_item_id").isNotNull(), F.col("review_score"))).alias("score_n"),
        F.count_if(mark).alias("orders"),
        F.count_if(F.col("first_of_category") & F.col("order_item_id").isNotNull()).alias("orders_by_category"),
        F.count_if(F.col("first_of_category") & F.col("order_item_id").isNotNull() & F.col("reviewed").isNotNull()).alias("reviewed_by_category"),
        F.count_if(F.col("first_of_seller_state") & F.col("order_item_id").isNotNull()).alias("orders_by_seller_state"),
        F.count_if(F.col("first_of_label") & F.col("order_item_id").isNotNull()).alias("orders_by_label"),
        F.sum(of_order(F.col("order_value"))).alias("order_value_sum"),
        F.count(of_order(F.col("order_value"))).alias("order_value_n"),
        F.count(of_order(F.col("delay_seconds"))).alias("known"),
        F.count_if(mark & F.coalesce(late, F.lit(False))).alias("late"),
        F.sum(of_order(F.col("delay_seconds"))).alias("delay_seconds_sum"),
        F.sum(of_order(F.col("delivery_seconds"))).alias("delivery_seconds_sum"),
        F.count(of_order(F.col("delivery_seconds"))).alias("delivery_n"),
        F.sum(of_order(F.col("estimated_seconds"))).alias("estimated_seconds_sum"),
        F.count(of_order(F.col("estimated_seconds"))).alias("estimated_n"),
        F.sum(of_order(F.col("review_score"))).alias("order_score_sum"),
        F.count(of_order(F.col("review_score"))).alias("order_score_n"))
    n, full = len(SETS), (1 << len(SETS)) - 1
    dim, key = F.lit(TOTAL), F.lit(None).cast("string")
    for k, (column, name) in enumerate(SETS.items()):
        own = F.col("gid") == full - (1 << (n - 1 - k))
        dim, key = F.when(own, name).otherwise(dim), F.when(own, F.col(column)).otherwise(key)
    orders = (F.when(F.col("dim") == "category", F.col("orders_by_category"))
              .when(F.col("dim") == "seller_state", F.col("orders_by_seller_state"))
              .when(F.col("dim") == "label", F.col("orders_by_label")).otherwise(F.col("orders")))
    return (wide.withColumns({"dim": dim, "key": key}).withColumn("n_orders", orders)
            .drop("gid", "orders", "orders_by_category", "orders_by_seller_state", "orders_by_label", *SETS))


def summary_of(layers) -> DataFrame:
    """``delivered_summary`` over the cleaned tables of ``layers``."""
    c = layers.clean
    return delivered_summary(delivered_rows(c["orders"], c["customers"], c["order_items"], c["order_reviews"], c["products"],
                                            c["category_translation"], c["sellers"]))


def avg_of(name: str) -> Column:
    """Mean of a summed column: ``price``, ``freight``, ``score``, ``order_value`` or ``order_score``."""
    return ratio(f"{name}_sum", f"{name}_n")


def avg_days_of(name: str, count: str) -> Column:
    return ratio(F.col(f"{name}_seconds_sum"), F.col(count) * F.lit(86400))
