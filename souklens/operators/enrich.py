"""Enriched analytic tables.

All many-side inputs are aggregated to the join key first, so every join is
one-to-one or many-to-one.  ``is_delayed`` here is three-state (NULL when a
date is unknown), unlike the warehouse flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.dates import day_name, year_month, year_quarter
from souklens.functions.numeric import SECONDS_PER_HOUR, days_from_seconds, mean, ratio, seconds_between
from souklens.functions.stats import asc, first_of, sorted_set_join


def DELIVERED():
    return F.col("order_status") == "delivered"


def _items_per_order(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.count("order_item_id").alias("item_count"),
                                         F.sum("price").alias("product_revenue"),
                                         F.sum("freight_value").alias("freight_revenue"))


def orders_enriched(orders: DataFrame, customers: DataFrame, payments: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order.  Payments and items meet their order first, so
    over tables bucketed by order_id only the customers need an exchange."""
    pay = payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("total_payment_value"),
        sorted_set_join("payment_type", "|").alias("payment_methods"),
        F.max("payment_installments").alias("max_installments"),
        F.count("payment_sequential").alias("n_payment_rows"))
    it = _items_per_order(items).withColumn("total_order_revenue", F.col("product_revenue") + F.col("freight_revenue"))
    cust = customers.select("customer_id", "customer_unique_id", "customer_state", "customer_city",
                            "customer_zip_code_prefix")
    p = "order_purchase_timestamp"
    columns = ["customer_id", *[c for c in orders.columns if c != "customer_id"], *cust.columns[1:], *pay.columns[1:], *it.columns[1:]]
    df = (orders.join(pay, "order_id", "left").join(it, "order_id", "left").join(cust, "customer_id", "left")
          .select("order_id", *[c for c in columns if c != "order_id"]))
    df = df.withColumns({
        "order_year": F.year(p), "order_month": F.month(p), "order_year_month": year_month(p),
        "order_quarter": year_quarter(p), "order_day_of_week": day_name(p), "order_week": F.weekofyear(p),
        "delivery_seconds": seconds_between(p, "order_delivered_customer_date"),
        "estimated_seconds": seconds_between(p, "order_estimated_delivery_date"),
        "delay_seconds": seconds_between("order_estimated_delivery_date", "order_delivered_customer_date"),
        "approval_seconds": seconds_between(p, "order_approved_at"),
    })
    return df.withColumns({
        "delivery_days": days_from_seconds("delivery_seconds"),
        "estimated_delivery_days": days_from_seconds("estimated_seconds"),
        "delivery_delay_days": days_from_seconds("delay_seconds"),
        "is_delayed": (F.col("delay_seconds") > 0).cast("int"),
        "approval_hours": F.col("approval_seconds").cast("double") / F.lit(float(SECONDS_PER_HOUR)),
    })


def _products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Product fields with the English category name, joined at product grain:
    item rows then need one product join and no shuffle by category."""
    return products.select("product_id", "product_category_name", "product_weight_g", "product_length_cm",
                           "product_height_cm", "product_width_cm").join(translation, "product_category_name", "left")


def order_items_enriched(items: DataFrame, orders: DataFrame, products: DataFrame, sellers: DataFrame,
                         translation: DataFrame) -> DataFrame:
    """One row per item with order, product, category and seller fields."""
    o = orders.select("order_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
                      "order_estimated_delivery_date", "customer_id")
    pr = _products(products, translation)
    s = sellers.select("seller_id", "seller_state", "seller_city")
    return (items.join(o, "order_id", "left").join(pr, "product_id", "left").join(s, "seller_id", "left")
            .withColumns({"item_revenue": F.col("price") + F.col("freight_value"),
                          "order_year_month": year_month("order_purchase_timestamp")}))


def _review_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.select("order_id", "review_score")


def customer_analytics(customers: DataFrame, orders: DataFrame, items: DataFrame, reviews: DataFrame,
                       payments: DataFrame) -> DataFrame:
    """One row per person (all statuses).  State and city come from the
    person's earliest order (then the smallest order_id)."""
    oc = orders.join(customers.select("customer_id", "customer_unique_id", "customer_state", "customer_city"),
                     "customer_id", "left")
    pay = payments.groupBy("order_id").agg(F.sum("payment_value").alias("order_payment_value"))
    it = items.groupBy("order_id").agg(F.count("order_item_id").alias("items_count"))
    oc = (oc.join(pay, "order_id", "left").join(it, "order_id", "left")
          .join(_review_per_order(reviews), "order_id", "left")
          .where(F.col("customer_unique_id").isNotNull()))
    agg = oc.groupBy("customer_unique_id").agg(
        F.count("order_id").alias("total_orders"),
        F.count_if(DELIVERED()).alias("delivered_orders"),
        F.min("order_purchase_timestamp").alias("first_order_date"),
        F.max("order_purchase_timestamp").alias("last_order_date"),
        F.coalesce(F.sum("order_payment_value"), F.lit(0).cast("decimal(28,2)")).alias("total_spend_payment"),
        F.coalesce(F.sum("items_count"), F.lit(0).cast("bigint")).alias("total_items_bought"),
        mean("review_score").alias("avg_review_score"),
        first_of(asc("order_purchase_timestamp") + asc("order_id"), ["customer_state", "customer_city"]))
    return (agg.withColumns({"customer_state": F.col("_best.customer_state"), "customer_city": F.col("_best.customer_city")})
            .drop("_best")
            .withColumns({"is_repeat_buyer": F.col("total_orders") >= 2,
                          "avg_order_value": F.col("total_spend_payment").cast("double") / F.col("total_orders")}))


def _delivered_items_with_review(items: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    d = orders.where(DELIVERED()).select("order_id")
    return items.join(d, "order_id", "left_semi").join(_review_per_order(reviews), "order_id", "left")


def product_analytics(products: DataFrame, items: DataFrame, reviews: DataFrame, orders: DataFrame,
                      translation: DataFrame) -> DataFrame:
    """One row per sold product (delivered orders); review weighted by item."""
    x = _delivered_items_with_review(items, orders, reviews)
    agg = x.groupBy("product_id").agg(
        F.count("order_item_id").alias("units_sold"),
        F.sum("price").alias("total_product_revenue"),
        F.sum("freight_value").alias("total_freight_revenue"),
        mean("price").alias("avg_unit_price"),
        mean("freight_value").alias("avg_freight"),
        mean("review_score").alias("avg_review_score"),
        F.count_distinct("order_id").alias("n_unique_orders"))
    return (agg.withColumn("total_revenue", F.col("total_product_revenue") + F.col("total_freight_revenue"))
            .join(_products(products, translation), "product_id", "left"))


def _delivered_by_order(items: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Delivered items with their review score and a mark on one row of each
    (order, seller): a window over the rows of one order, which lie together
    after the joins on order_id, so counting orders needs no distinct."""
    x = _delivered_items_with_review(items, orders, reviews)
    pair = Window.partitionBy("order_id", "seller_id").orderBy("order_item_id")
    return x.withColumn("_first", F.row_number().over(pair) == 1)


def _sums() -> list:
    """First step of the ladder: what adds up from (seller, product) to the seller."""
    return [F.count(F.lit(1)).alias("_rows"), F.count("order_item_id").alias("_items"), F.count_if("_first").alias("_orders"),
            *[f(c).alias(f"_{n}_{c}") for c in ("price", "freight_value", "review_score") for n, f in (("s", F.sum), ("n", F.count))]]


def _add_up(*more) -> list:
    """Later steps: sums of the sums."""
    names = ["_rows", "_items", "_orders", *[f"_{n}_{c}" for c in ("price", "freight_value", "review_score") for n in "sn"]]
    return [*[F.sum(n).alias(n) for n in names], *more]


def _seller_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "total_items_sold": F.col("_items"), "total_product_revenue": F.col("_s_price"), "total_freight_revenue": F.col("_s_freight_value"),
        "avg_item_price": ratio("_s_price", "_n_price"), "avg_freight_value": ratio("_s_freight_value", "_n_freight_value"),
        "avg_review_score": ratio("_s_review_score", "_n_review_score"), "n_unique_orders": F.col("_orders"),
        "total_revenue": F.col("_s_price") + F.col("_s_freight_value")})


SELLER_SUMS = ["total_items_sold", "total_product_revenue", "total_freight_revenue", "avg_item_price", "avg_freight_value",
               "avg_review_score", "n_unique_orders"]


def seller_sales(items: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """The sums and averages of E5 alone: no product is read."""
    x = _delivered_by_order(items, orders, reviews).groupBy("seller_id").agg(*_sums())
    return _seller_columns(x).select("seller_id", *SELLER_SUMS, "total_revenue")


def seller_analytics(sellers: DataFrame, items: DataFrame, orders: DataFrame, reviews: DataFrame,
                     products: DataFrame, translation: DataFrame) -> DataFrame:
    """E5: one row per selling seller (delivered orders); top category is the
    most frequent English name, smallest on ties, 'unknown' if none.

    A ladder over one join of items, orders and reviews: (seller, product)
    first, which meets the products, then (seller, category), then the seller.
    Each step adds up the one before, so a seller with a third of all items is
    reduced in the first step's partial aggregate."""
    by_product = _delivered_by_order(items, orders, reviews).groupBy("seller_id", "product_id").agg(*_sums())
    name = "product_category_name_english"
    by_category = (by_product.join(_products(products, translation).select("product_id", name), "product_id", "left")
                   .groupBy("seller_id", name).agg(*_add_up(F.count("*").alias("_products"))))
    top = F.min(F.when(F.col(name).isNotNull(), F.struct((-F.col("_rows")).alias("n"), F.col(name).alias("v"))))
    agg = _seller_columns(by_category.groupBy("seller_id").agg(
        *_add_up(F.sum("_products").alias("n_unique_products"), top.alias("_top"))))
    return (agg.withColumn("top_category", F.coalesce(F.col("_top.v"), F.lit("unknown")))
            .select("seller_id", *SELLER_SUMS, "n_unique_products", "top_category", "total_revenue")
            .join(sellers.select("seller_id", "seller_state", "seller_city"), "seller_id", "left"))
