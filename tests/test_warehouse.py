"""S5 round trip: jobs over the materialised warehouse equal jobs over the raw inputs; its layout and its checks."""

import re

import pytest

from souklens import registry
from souklens.operators import enrich, star
from souklens.plans import quality
from souklens.plans.context import Layers
from souklens.sources.io import build_warehouse, require_keys
from souklens.sources.warehouse import database

SF = "/root/testdata/sf0.001"
# raw-audit jobs read the raw inputs themselves
RAW_ONLY = {"c11_cleaning_log", "c12_row_counts", "v14_null_counts"}
JOBS = ["q01_delivered_revenue", "q03_top_categories", "q07_seller_performance", "k1_kpi_summary", "l05_state_revenue",
        "e1_orders_enriched", "e2_order_items_enriched", "e3_customer_analytics", "e5_seller_analytics",
        "a14_logistics", "a16_freight_pct_by_category", "r11_rfm_table", "h1_cohort_retention", "i1_seller_scorecard",
        "w10_monthly_growth", "x10_delivery_kpis", "y01_filtered_kpis", "m12_lorenz_curve", "v01_post_clean_validation",
        "v10_script_check", "c01_customers", "d05_fact_orders", "d11_dim_geography", "o7_opportunities",
        "v04_v09_warehouse_checks", "f20_filter_sizes", "f21_order_filter", "f22_item_filter"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    wh = str(tmp_path_factory.mktemp("warehouse"))
    raw = Layers(spark, SF)
    written = build_warehouse(raw, wh)
    assert {"fact_orders", "orders_enriched", "geolocation_zip"} <= set(written)
    return raw, wh, written


@pytest.fixture(scope="module")
def layers(spark, built):
    return built[0], Layers.from_warehouse(spark, built[1])


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOBS)
def test_job_over_warehouse_equals_raw(layers, name):
    raw, wh = layers
    a, b = registry.run(name, raw), registry.run(name, wh)
    assert a.columns == b.columns
    assert _rows(a) == _rows(b)


def test_fact_time_filter_prunes_partitions(layers):
    _, wh = layers
    plan = _plan(wh.star["fact_orders"].where("order_year = 1995"))
    assert "PartitionFilters: [isnotnull(order_year" in plan and "= 1995)" in plan


@pytest.mark.parametrize("name", ["f21_order_filter", "f22_item_filter"])
def test_date_filters_prune_partitions(layers, name):
    plan = _plan(registry.run(name, layers[1]))
    assert re.search(r"PartitionFilters: \[[^\]]*order_year_month#\d+ >= 1995-01", plan)


def test_day_filter_prunes_orders_and_items(layers):
    from souklens.plans import pages

    for spec in (pages.EXAMPLE_FILTERS["date"], pages.EXAMPLE_FILTERS["all"]):
        bundle = pages._bundle(layers[1], spec)
        for table in ("orders", "items"):
            assert re.search(r"PartitionFilters: \[[^\]]*order_year_month#\d+ >= 1995-01", _plan(bundle[table])), table


def test_order_grain_joins_need_no_exchange(spark, layers):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = layers[1].clean
        plans = {"D5": star.fact_orders(c["orders"], c["order_items"], c["order_payments"], c["order_reviews"]),
                 "D6": star.fact_sales(c["order_items"], c["orders"]), "V7": quality.mismatched_orders(layers[1]),
                 "E1": enrich.orders_enriched(c["orders"], c["customers"], c["order_payments"], c["order_items"])}
        for name, df in plans.items():
            assert "hashpartitioning(order_id" not in _plan(df), name
            assert "Bucketed: true" in _plan(df), name
        assert "hashpartitioning" not in _plan(plans["D5"]) + _plan(plans["D6"]) + _plan(plans["V7"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_written_checks_equal_the_queries(built):
    raw, _, written = built
    jobs = ("v01_post_clean_validation", "v02_v03_table_checks", "v04_v09_warehouse_checks")
    want = sorted((name, *r) for name in jobs for r in registry.run(name, raw).collect())
    assert sorted(tuple(r) for r in written.checks.collect()) == want


def test_observed_numbers_are_not_read_again(spark, built):
    """The range checks' columns are neither scanned nor aggregated once observed."""
    _, wh, written = built
    L = Layers.from_warehouse(spark, wh)
    seen = {k: v for m in written.observed.values() for k, v in m.items() if k != "rows"}
    full, known = (_plan(quality.warehouse_check_rows(quality.warehouse_numbers(L, s))) for s in (None, seen))
    assert "delivery_seconds" in full and "payment_total" in full
    assert "delivery_seconds" not in known and not re.search(r"FileScan[^\n]*payment_total", known)


def test_another_session_reopens_the_layout(spark, built):
    raw, wh, _ = built
    want = _rows(quality.v04_v09_warehouse_checks(raw))
    spark.sql(f"DROP DATABASE {database(wh)} CASCADE")  # as in a session that never wrote it
    again = Layers.from_warehouse(spark, wh)
    assert _rows(quality.v04_v09_warehouse_checks(again)) == want
    plan = _plan(again.star["fact_sales"].where("order_year = 1995").groupBy("order_id").count())
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan and "= 1995)" in plan


def test_failing_checks_are_found(spark, built):
    """Repeated keys, orphans, a wrong revenue and a wrong payment total each fail their check and no other."""
    raw = built[0]
    c = {n: raw.clean[n] for n in raw.clean}
    order = c["orders"].where("order_status = 'delivered'").orderBy("order_id").limit(1)
    key = order.first()["order_id"]
    status = {r["check"]: r["status"] for r in quality.v04_v09_warehouse_checks(raw).collect()}
    assert set(status.values()) == {"PASS"}

    def failing(**tables):
        L = raw.with_clean(**tables)
        return {r["check"] for r in quality.v04_v09_warehouse_checks(L).collect() if r["status"] == "FAIL"}

    assert failing(products=c["products"].union(c["products"].limit(1))) == {"products.product_id unique"}
    assert failing(order_reviews=c["order_reviews"].selectExpr("* EXCEPT (order_id)", "concat('x', order_id) AS order_id")) == {"order_reviews -> orders"}
    without = c["orders"].where(c["orders"].order_id != key)
    assert failing(orders=without) == {"order_items -> orders", "order_payments -> orders", "order_reviews -> orders",
                                       "fact_sales -> fact_orders"} - (set() if c["order_reviews"].where(f"order_id = '{key}'").count()
                                                                       else {"order_reviews -> orders"})
    v1 = {r["check"] for r in quality.v01_post_clean_validation(raw.with_clean(customers=c["customers"].limit(10))).collect() if r["status"] == "FAIL"}
    assert v1 == {"orders→customers FK"}


def test_wrong_sums_fail_over_stored_facts(spark, built):
    from pyspark.sql import functions as F

    L = Layers.from_warehouse(spark, built[1])
    facts = L.star["fact_orders"]
    key = facts.where("order_status = 'delivered'").agg(F.min("order_id")).first()[0]
    changed = facts.withColumn("order_revenue", F.when(F.col("order_id") == key, F.col("order_revenue") + 5).otherwise(F.col("order_revenue")))
    changed = changed.withColumn("payment_total", F.when(F.col("order_id") == key, F.lit(0).cast("decimal(28,2)")).otherwise(F.col("payment_total")))
    for stored in (True, False):  # V7 joined in place, and out of the ladder
        L.stored = stored
        star_tables = dict(L.star) | {"fact_orders": changed}
        W = Layers(spark, built[1])
        W.stored = stored
        W.__dict__.update(raw={}, clean=L.clean, star=star_tables, enriched=L.enriched)
        if not stored:
            W.with_clean = lambda **tables: W
        bad = {r["check"] for r in quality.v04_v09_warehouse_checks(W).collect() if r["status"] == "FAIL"}
        assert bad == {"Fact revenue reconciliation", "Order revenue matches sales grain", "Payment totals not duplicated"}


def test_strict_build_names_the_tables(spark, built, tmp_path):
    raw = built[0]
    customers = raw.clean["customers"]
    with pytest.raises(ValueError, match="customers: 1 values of customer_id"):
        build_warehouse(raw.with_clean(customers=customers.union(customers.limit(1))), str(tmp_path / "wh"), strict=True)
    assert not (tmp_path / "wh").exists()
    require_keys({"customers": customers})
    nulls = spark.createDataFrame([(None,), ("a",), ("b",), ("b",)], "seller_id string")
    with pytest.raises(ValueError, match="sellers: 2 values of seller_id repeat or are missing"):
        require_keys({"sellers": nulls})


def test_raw_audit_jobs_are_listed(layers):
    assert RAW_ONLY <= set(registry.names())
