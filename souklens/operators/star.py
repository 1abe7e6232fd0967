"""Star schema: two facts and five dimensions.

Many-side tables (items, payments) are collapsed to one row per order
*before* they meet orders, so no join fans out.  Durations are carried as
whole seconds next to the day values so averages can be summed exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.dates import month_name, quarter_label, year_month
from souklens.functions.numeric import SECONDS_PER_DAY, days_from_seconds, seconds_between
from souklens.functions.stats import asc, desc_num, sorted_set_join
from souklens.operators.clean import latest_review_per_order


def prepare_orders(orders: DataFrame) -> DataFrame:
    """Day differences, is_delayed as 0/1 (unknown → 0), year, year-month."""
    p, d, e = "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"
    return (orders
            .withColumns({"delivery_seconds": seconds_between(p, d),
                          "estimated_seconds": seconds_between(p, e),
                          "delay_seconds": seconds_between(e, d)})
            .withColumns({"delivery_days": days_from_seconds("delivery_seconds"),
                          "estimated_delivery_days": days_from_seconds("estimated_seconds"),
                          "delivery_delay_days": days_from_seconds("delay_seconds"),
                          "is_delayed": F.coalesce((F.col("delay_seconds") > 0).cast("int"), F.lit(0)),
                          "order_year": F.year(p),
                          "order_year_month": year_month(p)}))


def prepare_reviews(reviews: DataFrame) -> DataFrame:
    """Newest review per order."""
    return latest_review_per_order(reviews)


def payment_summary(payments: DataFrame) -> DataFrame:
    """D3: total, rows, max installments, ', '-joined methods and the primary
    type (largest summed value; ties → alphabetical; none without an order).
    The sums by type make both, so the payments are read once."""
    by_type = payments.groupBy("order_id", "payment_type").agg(
        F.sum("payment_value").alias("type_value"),
        F.count("payment_value").alias("type_rows"),
        F.max("payment_installments").alias("type_installments"))
    key = F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(desc_num("type_value") + asc("payment_type"))])
    named = F.col("order_id").isNotNull() & F.col("payment_type").isNotNull()
    return by_type.groupBy("order_id").agg(
        F.sum("type_value").cast(by_type.schema["type_value"].dataType).alias("payment_total"),
        F.sum("type_rows").alias("payment_rows"),
        F.max("type_installments").alias("installment_max"),
        sorted_set_join("payment_type", ", ").alias("payment_methods"),
        F.min_by("payment_type", F.when(named, key)).alias("primary_payment_type"))


def item_summary(items: DataFrame) -> DataFrame:
    """Items, product and freight revenue per order."""
    return (items.groupBy("order_id").agg(
        F.count("order_item_id").alias("item_count"),
        F.sum("price").alias("product_revenue"),
        F.sum("freight_value").alias("freight_revenue"))
        .withColumn("order_revenue", F.col("product_revenue") + F.col("freight_revenue")))


FACT_ORDER_ZERO_FILL = {"item_count": 0, "product_revenue": 0, "freight_revenue": 0, "order_revenue": 0,
                        "payment_total": 0, "payment_rows": 0, "installment_max": 0}


def fact_orders(orders: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Orders ⟕ item summary ⟕ payment summary ⟕ latest review score;
    seven numeric columns NULL → 0."""
    f = (prepare_orders(orders)
         .join(item_summary(items), "order_id", "left")
         .join(payment_summary(payments), "order_id", "left")
         .join(prepare_reviews(reviews).select("order_id", "review_score"), "order_id", "left"))
    return f.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(f.schema[c].dataType))
                          for c, v in FACT_ORDER_ZERO_FILL.items()})


FACT_SALES_ORDER_COLS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
                         "order_delivered_customer_date", "order_estimated_delivery_date", "delivery_seconds",
                         "estimated_seconds", "delay_seconds", "delivery_days", "estimated_delivery_days",
                         "delivery_delay_days", "is_delayed", "order_year", "order_year_month"]


def fact_sales(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per item with its order's fields and item_revenue."""
    return (items.join(prepare_orders(orders).select(FACT_SALES_ORDER_COLS), "order_id", "left")
            .withColumn("item_revenue", F.col("price") + F.col("freight_value")))


def dim_customer(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers ⟕ (order count, first and last purchase) per customer_id."""
    per = orders.groupBy("customer_id").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.min("order_purchase_timestamp").alias("first_order_date"),
        F.max("order_purchase_timestamp").alias("last_order_date"))
    return customers.join(per, "customer_id", "left")


def dim_product(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products ⟕ English category name."""
    return products.join(translation, "product_category_name", "left")


def dim_seller(sellers: DataFrame, items: DataFrame) -> DataFrame:
    """Sellers ⟕ item, price, freight, order counts and gross sales (all statuses)."""
    per = (items.groupBy("seller_id").agg(
        F.count("order_item_id").alias("item_count"),
        F.sum("price").alias("product_revenue"),
        F.sum("freight_value").alias("freight_revenue"),
        F.count_distinct("order_id").alias("order_count"))
        .withColumn("gross_sales", F.col("product_revenue") + F.col("freight_revenue")))
    return sellers.join(per, "seller_id", "left")


def dim_date(orders: DataFrame) -> DataFrame:
    """The distinct observed purchase dates (no gap fill)."""
    d = (orders.where(F.col("order_purchase_timestamp").isNotNull())
         .select(F.to_date("order_purchase_timestamp").alias("date")).distinct())
    return d.select("date", F.year("date").alias("year"), F.month("date").alias("month"),
                    month_name("date").alias("month_name"), quarter_label("date").alias("quarter"),
                    year_month("date").alias("year_month"))


def dim_geography(customers: DataFrame, sellers: DataFrame) -> DataFrame:
    """Distinct (zip, city, state) of customers ∪ sellers."""
    c = customers.select(F.col("customer_zip_code_prefix").alias("zip_code_prefix"),
                         F.col("customer_city").alias("city"), F.col("customer_state").alias("state"))
    s = sellers.select(F.col("seller_zip_code_prefix").alias("zip_code_prefix"),
                       F.col("seller_city").alias("city"), F.col("seller_state").alias("state"))
    return c.unionByName(s).distinct()


__all__ = ["SECONDS_PER_DAY", "fact_orders", "fact_sales", "dim_customer", "dim_product",
           "dim_seller", "dim_date", "dim_geography", "prepare_orders", "prepare_reviews", "payment_summary",
           "item_summary"]
