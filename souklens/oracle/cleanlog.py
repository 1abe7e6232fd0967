"""Oracle SQL for the cleaning log (C11)."""

ITEMS = {
    "geolocation": [("dup", "Fully duplicate rows", "Removed, first occurrence kept", "Duplicates multiply rows in joins"),
                    ("outlier", "Coordinates outside the bounding box", "Removed", "Out-of-bounds points misplace map pins")],
    "customers": [("normalised", "City/state whitespace and case", "trim+lower city, trim+upper state", "Consistent grouping")],
    "orders": [("no_approved", "Missing order_approved_at", "Kept as NULL", "Payment not captured"),
               ("no_carrier", "Missing order_delivered_carrier_date", "Kept as NULL", "Not yet handed to carrier"),
               ("no_delivered", "Missing order_delivered_customer_date", "Kept as NULL", "Not yet delivered"),
               ("bad_status", "Unknown order_status values", "Flagged", "Unexpected categorical values")],
    "order_items": [("bad_price", "Items with price <= 0", "Flagged", "Not a valid sale"),
                    ("bad_freight", "Items with freight_value < 0", "Flagged", "Negative freight is not valid")],
    "order_payments": [("not_defined", "payment_type 'not_defined'", "Relabelled to 'unknown'", "Value is unknown, not missing"),
                       ("zero_value", "Zero payment_value rows", "Kept, flagged by is_zero_payment", "Fully discounted rows"),
                       ("cc_zero", "Credit card with 0 installments", "Set to 1", "Zero installments is impossible")],
    "order_reviews": [("dedup", "Several reviews per order", "Kept the newest per order", "Final stated opinion"),
                      ("null_text", "NULL review title/message", "Filled with ''", "Neutral for text operations")],
    "products": [("renamed", "Misspelt column names", "Renamed", "Source typo"),
                 ("null_cat", "Missing product_category_name", "Filled with 'unknown'", "Still real revenue"),
                 ("zero_weight", "Zero product_weight_g", "Set to NULL", "Impossible weight")],
    "sellers": [("normalised", "City/state normalisation", "trim+lower city, trim+upper state", "Consistency")],
    "category_translation": [("appended", "Missing category translations", "Appended fixed rows", "No NULL English names")],
}

COUNTS = {
    "dup": "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM fx_geolocation GROUP BY geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state) g)",
    "outlier": "(SELECT count(*) FILTER (WHERE coalesce(geolocation_lat < -35.0 OR geolocation_lat > 5.5 OR geolocation_lng < -74.0 "
               "OR geolocation_lng > -28.0, false)) FROM (SELECT DISTINCT * FROM fx_geolocation) d)",
    ("customers", "normalised"): "(SELECT count(*) FROM fx_customers)",
    "no_approved": "(SELECT count(*) FILTER (WHERE order_approved_at IS NULL) FROM fx_orders)",
    "no_carrier": "(SELECT count(*) FILTER (WHERE order_delivered_carrier_date IS NULL) FROM fx_orders)",
    "no_delivered": "(SELECT count(*) FILTER (WHERE order_delivered_customer_date IS NULL) FROM fx_orders)",
    "bad_status": "(SELECT count(*) FILTER (WHERE NOT coalesce(order_status IN ('delivered', 'shipped', 'canceled', 'unavailable', "
                  "'invoiced', 'processing', 'created', 'approved'), false)) FROM fx_orders)",
    "bad_price": "(SELECT count(*) FILTER (WHERE price <= 0) FROM fx_order_items)",
    "bad_freight": "(SELECT count(*) FILTER (WHERE freight_value < 0) FROM fx_order_items)",
    "not_defined": "(SELECT count(*) FILTER (WHERE payment_type = 'not_defined') FROM fx_order_payments)",
    "zero_value": "(SELECT count(*) FILTER (WHERE payment_value = 0) FROM fx_order_payments)",
    "cc_zero": "(SELECT count(*) FILTER (WHERE payment_type = 'credit_card' AND payment_installments = 0) FROM fx_order_payments)",
    "dedup": "(SELECT count(*) - count(DISTINCT order_id) FROM fx_order_reviews)",
    "null_text": "(SELECT count(*) FILTER (WHERE review_comment_title IS NULL) + count(*) FILTER (WHERE review_comment_message IS NULL) "
                 "FROM fx_order_reviews)",
    "renamed": "2",
    "null_cat": "(SELECT count(*) FILTER (WHERE product_category_name IS NULL) FROM fx_products)",
    "zero_weight": "(SELECT count(*) FILTER (WHERE product_weight_g = 0) FROM fx_products)",
    ("sellers", "normalised"): "(SELECT count(*) FROM fx_sellers)",
    "appended": "3",
}


def _q(s: str) -> str:
    return s.replace("'", "''")


def _row(table: str, key: str, issue: str, action: str, reason: str) -> str:
    cnt = COUNTS.get((table, key), COUNTS.get(key))
    return (f"SELECT '{table}' AS \"table\", '{_q(issue)}' AS issue, CAST({cnt} AS BIGINT) AS rows_affected, "
            f"'{_q(action)}' AS action, '{_q(reason)}' AS reason")


CLEANLOG_SQL = {"c11_cleaning_log": "SELECT * FROM (" + "\nUNION ALL ".join(
    _row(t, *item) for t, items in ITEMS.items() for item in items) + ") z"}
