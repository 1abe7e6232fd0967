"""Oracle SQL for cleaning outputs and warehouse tables."""

from souklens.oracle.base import r
from souklens.oracle.quality import EXTRA

MONEY = ("product_revenue", "freight_revenue", "order_revenue", "payment_total", "price", "freight_value", "item_revenue",
         "gross_sales")


def cast_money(cols: list[str], alias: str = "") -> str:
    return ", ".join(f"CAST({alias}{c} AS DOUBLE) AS {c}" if c in MONEY else f"{alias}{c}" for c in cols)


FO = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
      "order_delivered_customer_date", "order_estimated_delivery_date", "delivery_days", "estimated_delivery_days",
      "delivery_delay_days", "is_delayed", "order_year", "order_year_month", "item_count", "product_revenue", "freight_revenue",
      "order_revenue", "payment_total", "payment_rows", "installment_max", "payment_methods", "primary_payment_type", "review_score"]
FS = ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value", "customer_id",
      "order_status", "order_purchase_timestamp", "delivery_days", "is_delayed", "order_year", "order_year_month", "item_revenue"]
DS = ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", "item_count", "product_revenue", "freight_revenue",
      "order_count", "gross_sales"]

MODEL_SQL = {
    "c03_geolocation_zip": "WITH " + EXTRA + "SELECT geolocation_zip_code_prefix, " + r("geolocation_lat", 6) + " AS geolocation_lat, "
    + r("geolocation_lng", 6) + " AS geolocation_lng, geolocation_city, geolocation_state FROM cl_geo_zip",
    "c12_row_counts": """SELECT *, rows_before - rows_after AS rows_removed FROM (
  SELECT 'customers' AS "table", (SELECT count(*) FROM fx_customers) AS rows_before, (SELECT count(*) FROM cl_customers) AS rows_after
  UNION ALL SELECT 'geolocation', (SELECT count(*) FROM fx_geolocation), (SELECT count(*) FROM cl_geo)
  UNION ALL SELECT 'orders', (SELECT count(*) FROM fx_orders), (SELECT count(*) FROM cl_orders)
  UNION ALL SELECT 'order_items', (SELECT count(*) FROM fx_order_items), (SELECT count(*) FROM cl_items)
  UNION ALL SELECT 'order_payments', (SELECT count(*) FROM fx_order_payments), (SELECT count(*) FROM cl_payments)
  UNION ALL SELECT 'order_reviews', (SELECT count(*) FROM fx_order_reviews), (SELECT count(*) FROM cl_reviews)
  UNION ALL SELECT 'products', (SELECT count(*) FROM fx_products), (SELECT count(*) FROM cl_products)
  UNION ALL SELECT 'sellers', (SELECT count(*) FROM fx_sellers), (SELECT count(*) FROM cl_sellers)
  UNION ALL SELECT 'category_translation', (SELECT count(*) FROM fx_category_translation), (SELECT count(*) FROM cl_translation)
) z""",
    "d05_fact_orders": "SELECT " + cast_money(FO) + " FROM fact_orders",
    "d06_fact_sales": "SELECT " + cast_money(FS) + " FROM fact_sales",
    "d07_dim_customer": "SELECT * FROM dim_customer",
    "d08_dim_product": "SELECT * FROM dim_product",
    "d09_dim_seller": "SELECT " + cast_money(DS) + " FROM dim_seller",
    "d10_dim_date": "WITH " + EXTRA + """SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  monthname(date) AS month_name, 'Q' || CAST(quarter(date) AS VARCHAR) AS quarter, strftime(date, '%Y-%m') AS year_month FROM dim_date""",
    "d11_dim_geography": "WITH " + EXTRA + "SELECT * FROM dim_geography",
}
