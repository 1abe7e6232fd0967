"""Cleaning and audit of the nine raw tables.

Each ``clean_*`` is a lazy DataFrame transform; ``cleaning_log`` and
``row_counts`` are the audit tables, built from conditional counts (one pass
per table) instead of side effects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.functions.stats import asc, desc_ts, first_by
from souklens.sources.inline import local_table

# Bounding box of valid coordinates (inclusive).
LAT_MIN, LAT_MAX = -35.0, 5.5
LNG_MIN, LNG_MAX = -74.0, -28.0

# The eight known order statuses.
KNOWN_STATUSES = ("delivered", "shipped", "canceled", "unavailable", "invoiced", "processing", "created", "approved")

# Translations missing from the source list, appended as is.
EXTRA_TRANSLATIONS = [
    ("pc_gamer", "PC Gamer"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "Portable Kitchen & Food Preparers"),
    ("unknown", "Unknown / Uncategorized"),
]


def _norm_place(df: DataFrame, city: str, state: str) -> DataFrame:
    return df.withColumns({city: F.lower(F.trim(F.col(city))), state: F.upper(F.trim(F.col(state)))})


def clean_customers(df: DataFrame) -> DataFrame:
    """City trimmed and lower-cased, state trimmed and upper-cased."""
    return _norm_place(df, "customer_city", "customer_state")


def _outside_box() -> F.Column:
    lat, lng = F.col("geolocation_lat"), F.col("geolocation_lng")
    # strict tests: a NULL coordinate is not an outlier and stays
    return F.coalesce((lat < LAT_MIN) | (lat > LAT_MAX) | (lng < LNG_MIN) | (lng > LNG_MAX), F.lit(False))


def clean_geolocation(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows, then rows outside the box; normalise
    text after the dedup (so rows differing only in case both survive)."""
    return _norm_place(df.dropDuplicates().where(~_outside_box()), "geolocation_city", "geolocation_state")


def make_geolocation_zip(geo_clean: DataFrame) -> DataFrame:
    """One row per zip prefix: mean coordinates, smallest city/state."""
    return (geo_clean.where(F.col("geolocation_zip_code_prefix").isNotNull())
            .groupBy("geolocation_zip_code_prefix")
            .agg(F.avg("geolocation_lat").alias("geolocation_lat"),
                 F.avg("geolocation_lng").alias("geolocation_lng"),
                 F.min("geolocation_city").alias("geolocation_city"),
                 F.min("geolocation_state").alias("geolocation_state")))


def clean_orders(df: DataFrame) -> DataFrame:
    """C4: dates are kept as they are (NULL stays NULL); statuses are audited."""
    return df


def clean_order_items(df: DataFrame) -> DataFrame:
    """Rows kept; bad prices and freight are only counted (see the log)."""
    return df


def clean_order_payments(df: DataFrame) -> DataFrame:
    """C6: 'not_defined' → 'unknown'; is_zero_payment; credit card with 0
    installments → 1."""
    t = F.col("payment_type")
    return df.withColumns({
        "payment_type": F.when(t == "not_defined", F.lit("unknown")).otherwise(t),
        "payment_installments": F.when((t == "credit_card") & (F.col("payment_installments") == 0), F.lit(1))
        .otherwise(F.col("payment_installments")),
        "is_zero_payment": F.coalesce(F.col("payment_value") == 0, F.lit(False)),
    })


def latest_review_per_order(df: DataFrame) -> DataFrame:
    """Newest review per order by answer time (NULL last), ties by review_id."""
    cols = [c for c in df.columns if c != "order_id"]
    out = first_by(df, ["order_id"], desc_ts("review_answer_timestamp") + asc("review_id"), cols)
    return out.select(df.columns)


def clean_order_reviews(df: DataFrame) -> DataFrame:
    """Newest review per order; NULL title/message → ''; has_comment."""
    out = latest_review_per_order(df)
    return out.withColumns({
        "review_comment_title": F.coalesce(F.col("review_comment_title"), F.lit("")),
        "review_comment_message": F.coalesce(F.col("review_comment_message"), F.lit("")),
    }).withColumn("has_comment", F.length("review_comment_message") > 0)


def clean_products(df: DataFrame) -> DataFrame:
    """Fix the two misspelt column names, NULL category → 'unknown',
    weight 0 → NULL."""
    return (df.withColumnsRenamed({"product_name_lenght": "product_name_length",
                                   "product_description_lenght": "product_description_length"})
            .withColumns({
                "product_category_name": F.coalesce(F.col("product_category_name"), F.lit("unknown")),
                "product_weight_g": F.when(F.col("product_weight_g") == 0, F.lit(None).cast("double"))
                .otherwise(F.col("product_weight_g")),
            }))


def clean_sellers(df: DataFrame) -> DataFrame:
    """As C1."""
    return _norm_place(df, "seller_city", "seller_state")


def clean_category_translation(df: DataFrame) -> DataFrame:
    """Append the three fixed rows."""
    spark = df.sparkSession
    extra = local_table(spark, EXTRA_TRANSLATIONS, "product_category_name string, product_category_name_english string")
    return df.unionByName(extra)


CLEANERS = {
    "customers": clean_customers,
    "geolocation": clean_geolocation,
    "orders": clean_orders,
    "order_items": clean_order_items,
    "order_payments": clean_order_payments,
    "order_reviews": clean_order_reviews,
    "products": clean_products,
    "sellers": clean_sellers,
    "category_translation": clean_category_translation,
}


# ---------------------------------------------------------------------------
# Audit tables

LOG_SCHEMA = "table string, issue string, rows_affected long, action string, reason string"


def _log_rows(spark: SparkSession, table: str, counts: DataFrame, items: list[tuple[str, str, str, str]]) -> DataFrame:
    """``counts`` is a one-row frame with one column per issue key; ``items``
    gives (key, issue, action, reason).  Unpivoted into log rows."""
    stack = ", ".join(f"'{k}', cast(`{k}` as bigint)" for k, _, _, _ in items)
    long = counts.selectExpr(f"stack({len(items)}, {stack}) as (k, rows_affected)")
    meta = local_table(spark, [(k, i, a, r) for k, i, a, r in items], "k string, issue string, action string, reason string")
    return (long.join(meta, "k").select(F.lit(table).alias("table"), "issue", "rows_affected", "action", "reason"))


def cleaning_log(raw: dict[str, DataFrame]) -> DataFrame:
    """C11: table, issue, rows_affected, action, reason — one conditional
    aggregate per raw table, unpivoted and unioned."""
    spark = raw["orders"].sparkSession
    geo = raw["geolocation"]
    g =(geo.groupBy(*geo.columns).agg(F.count(F.lit(1)).alias("n"))
         .agg(F.sum(F.col("n") - 1).alias("dup")))
    g_out = geo.dropDuplicates().agg(F.count_if(_outside_box()).alias("outlier"))
    geo_counts = g.crossJoin(F.broadcast(g_out))
    o = raw["orders"].agg(
        F.count_if(F.col("order_approved_at").isNull()).alias("no_approved"),
        F.count_if(F.col("order_delivered_carrier_date").isNull()).alias("no_carrier"),
        F.count_if(F.col("order_delivered_customer_date").isNull()).alias("no_delivered"),
        F.count_if(~F.coalesce(F.col("order_status").isin(*KNOWN_STATUSES), F.lit(False))).alias("bad_status"))
    it = raw["order_items"].agg(F.count_if(F.col("price") <= 0).alias("bad_price"),
                                F.count_if(F.col("freight_value") < 0).alias("bad_freight"))
    p = raw["order_payments"].agg(
        F.count_if(F.col("payment_type") == "not_defined").alias("not_defined"),
        F.count_if(F.col("payment_value") == 0).alias("zero_value"),
        F.count_if((F.col("payment_type") == "credit_card") & (F.col("payment_installments") == 0)).alias("cc_zero"))
    rv = raw["order_reviews"]
    r_before = rv.agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col("review_comment_title").isNull()).alias("null_title"),
                      F.count_if(F.col("review_comment_message").isNull()).alias("null_msg"))
    r_after = rv.agg(F.count_distinct("order_id").alias("kept"))
    r = r_before.crossJoin(F.broadcast(r_after)).select((F.col("n") - F.col("kept")).alias("dedup"),
                                           (F.col("null_title") + F.col("null_msg")).alias("null_text"))
    pr = raw["products"].agg(F.count_if(F.col("product_category_name").isNull()).alias("null_cat"),
                             F.count_if(F.col("product_weight_g") == 0).alias("zero_weight"),
                             F.lit(2).alias("renamed"))
    sel = raw["sellers"].agg(F.count(F.lit(1)).alias("normalised"))
    cu = raw["customers"].agg(F.count(F.lit(1)).alias("normalised"))
    tr = raw["category_translation"].agg(F.lit(len(EXTRA_TRANSLATIONS)).alias("appended"))
    parts = [
        _log_rows(spark, "geolocation", geo_counts, [
            ("dup", "Fully duplicate rows", "Removed, first occurrence kept", "Duplicates multiply rows in joins"),
            ("outlier", "Coordinates outside the bounding box", "Removed", "Out-of-bounds points misplace map pins")]),
        _log_rows(spark, "customers", cu, [
            ("normalised", "City/state whitespace and case", "trim+lower city, trim+upper state", "Consistent grouping")]),
        _log_rows(spark, "orders", o, [
            ("no_approved", "Missing order_approved_at", "Kept as NULL", "Payment not captured"),
            ("no_carrier", "Missing order_delivered_carrier_date", "Kept as NULL", "Not yet handed to carrier"),
            ("no_delivered", "Missing order_delivered_customer_date", "Kept as NULL", "Not yet delivered"),
            ("bad_status", "Unknown order_status values", "Flagged", "Unexpected categorical values")]),
        _log_rows(spark, "order_items", it, [
            ("bad_price", "Items with price <= 0", "Flagged", "Not a valid sale"),
            ("bad_freight", "Items with freight_value < 0", "Flagged", "Negative freight is not valid")]),
        _log_rows(spark, "order_payments", p, [
            ("not_defined", "payment_type 'not_defined'", "Relabelled to 'unknown'", "Value is unknown, not missing"),
            ("zero_value", "Zero payment_value rows", "Kept, flagged by is_zero_payment", "Fully discounted rows"),
            ("cc_zero", "Credit card with 0 installments", "Set to 1", "Zero installments is impossible")]),
        _log_rows(spark, "order_reviews", r, [
            ("dedup", "Several reviews per order", "Kept the newest per order", "Final stated opinion"),
            ("null_text", "NULL review title/message", "Filled with ''", "Neutral for text operations")]),
        _log_rows(spark, "products", pr, [
            ("renamed", "Misspelt column names", "Renamed", "Source typo"),
            ("null_cat", "Missing product_category_name", "Filled with 'unknown'", "Still real revenue"),
            ("zero_weight", "Zero product_weight_g", "Set to NULL", "Impossible weight")]),
        _log_rows(spark, "sellers", sel, [
            ("normalised", "City/state normalisation", "trim+lower city, trim+upper state", "Consistency")]),
        _log_rows(spark, "category_translation", tr, [
            ("appended", "Missing category translations", "Appended fixed rows", "No NULL English names")]),
    ]
    return reduce(DataFrame.unionByName, parts)


def row_counts(raw: dict[str, DataFrame], clean: dict[str, DataFrame]) -> DataFrame:
    """Rows before / after / removed per table."""
    parts = []
    for name, df in raw.items():
        b = df.agg(F.count(F.lit(1)).alias("rows_before"))
        a = clean[name].agg(F.count(F.lit(1)).alias("rows_after"))
        parts.append(b.crossJoin(F.broadcast(a)).select(F.lit(name).alias("table"), "rows_before", "rows_after",
                                           (F.col("rows_before") - F.col("rows_after")).alias("rows_removed")))
    return reduce(DataFrame.unionByName, parts)
