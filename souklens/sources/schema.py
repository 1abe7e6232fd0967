"""Explicit schemas of the nine raw marketplace tables.

Money is DECIMAL(18,2) so sums and rounding are exact; timestamps are
TIMESTAMP_NTZ (wall-clock, no zone).  Fixed at ingest, never inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TS = T.TimestampNTZType()
S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "customers": _st(("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", I),
                     ("customer_city", S), ("customer_state", S)),
    "geolocation": _st(("geolocation_zip_code_prefix", I), ("geolocation_lat", D), ("geolocation_lng", D),
                       ("geolocation_city", S), ("geolocation_state", S)),
    "orders": _st(("order_id", S), ("customer_id", S), ("order_status", S), ("order_purchase_timestamp", TS),
                  ("order_approved_at", TS), ("order_delivered_carrier_date", TS),
                  ("order_delivered_customer_date", TS), ("order_estimated_delivery_date", TS)),
    "order_items": _st(("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
                       ("shipping_limit_date", TS), ("price", MONEY), ("freight_value", MONEY)),
    "order_payments": _st(("order_id", S), ("payment_sequential", I), ("payment_type", S),
                          ("payment_installments", I), ("payment_value", MONEY)),
    "order_reviews": _st(("review_id", S), ("order_id", S), ("review_score", I), ("review_comment_title", S),
                         ("review_comment_message", S), ("review_creation_date", TS),
                         ("review_answer_timestamp", TS)),
    "products": _st(("product_id", S), ("product_category_name", S), ("product_name_lenght", D),
                    ("product_description_lenght", D), ("product_photos_qty", D), ("product_weight_g", D),
                    ("product_length_cm", D), ("product_height_cm", D), ("product_width_cm", D)),
    "sellers": _st(("seller_id", S), ("seller_zip_code_prefix", I), ("seller_city", S), ("seller_state", S)),
    "category_translation": _st(("product_category_name", S), ("product_category_name_english", S)),
}

def conform(name: str, df: DataFrame) -> DataFrame:
    """Project ``df`` onto the declared schema of ``name`` (by column name)."""
    if name not in RAW_SCHEMAS:
        raise ValueError(f"Unknown table: {name}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMAS[name].fields])
