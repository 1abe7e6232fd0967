"""How often rows are moved: the shared steps exchange each table no more than the keys ask for."""

import contextlib

import pytest
from pyspark.sql import functions as F

from souklens.functions.reuse import releasing
from souklens.operators.enrich import seller_sales
from souklens.operators.star import payment_summary
from souklens.plans import cohort, growth, quality, report, rfm, sellers
from souklens.plans.context import Layers
from souklens.operators.summary import delivered_rows
from souklens.sources import fixtures
from souklens.sources.schema import conform

SMALL = "/root/testdata/sf0.001"


@contextlib.contextmanager
def _large_tables(spark):
    """Plans as for tables that are too large to be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _count(plan, key):
    return plan.count(f"Exchange hashpartitioning({key}#")


def _exchanges(df):
    return _plan(df).count("Exchange hashpartitioning(")


@pytest.fixture
def lines(spark, tmp_path):
    rows = [(1, 2, 3, 1, 4.0, 1000.5, 0.01, "A"), (1, 2, 3, 2, 5.0, 99.0, 0.02, "A"), (1, 2, 3, 3, None, 7.0, None, None),
            (403, 2, 3, 1, 4.0, 10.0, 0.01, "A"), (403, 2, 3, 2, 13.0, 10.0, 0.01, "N"), (305, 2, 3, 1, 1.0, 5.0, 0.0, "N"),
            (2, 9, 9, None, 12.0, None, 0.5, "R"), (2, 9, 9, None, 1.0, 8.0, 0.5, "N"), (None, 5, 5, 1, 2.0, 3.0, 0.1, "A"),
            (None, 5, None, 1, 2.0, 3.0, 0.1, "N"), (None, None, 5, 2, 25.0, 3.0, 0.1, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_tax double, l_returnflag string").withColumn(
        "l_shipdate", F.lit("2020-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("table", ["order_items", "order_payments"])
def test_reading_gives_the_rows_of_the_view(spark, lines, table):
    view = conform(table, spark.sql(fixtures.FIXTURE_SQL[table], lineitem=spark.read.parquet(f"{lines}/lineitem.parquet")))
    got = fixtures.fixture_frame(spark, lines, table)
    assert got.schema == view.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, view.collect()))


def test_numbering_and_join_share_one_exchange(spark):
    with _large_tables(spark):
        L = Layers(spark, SMALL)
        joined = L.clean["orders"].select("order_id", "order_status").join(L.clean["order_items"], "order_id")
        assert _exchanges(joined) == 2  # one for each side


def test_seller_sums_move_the_items_once(spark):
    with _large_tables(spark):
        c = Layers(spark, SMALL).clean
        plan = _plan(seller_sales(c["order_items"], c["orders"], c["order_reviews"]))
    assert not any("l_orderkey" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)
    assert _count(plan, "order_id") == 3  # items, orders, reviews
    assert _count(plan, "seller_id") == 1


def test_customers_meet_orders_not_items(spark):
    with _large_tables(spark):
        c = Layers(spark, SMALL).clean
        plan = _plan(delivered_rows(c["orders"], c["customers"], c["order_items"], c["order_reviews"], c["products"],
                                    c["category_translation"], c["sellers"]).select("price", "customer_state", "first_of_category"))
    by_customer = [plan.split("\n")[k + 1] for k, line in enumerate(plan.split("\n")) if "Exchange hashpartitioning(customer_id" in line]
    assert by_customer and not any("price" in line for line in by_customer)


def test_flag_summary_keeps_only_what_it_reads(spark):
    result = releasing(lambda: sellers.i8_flag_summary(Layers(spark, SMALL)))
    plan = _plan(result)
    assert "InMemoryRelation" in plan or "InMemoryTableScan" in plan
    assert "n_customers_served" not in plan and "seller_city" not in plan


@contextlib.contextmanager
def _whole_plans(spark):
    """Plans with their reused exchanges, before anything runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _rows_sent(df, exchange):
    """Columns of what goes into the exchanges whose line holds ``exchange``: the line's own and its child's."""
    lines = _plan(df).split("\n")
    return [line + lines[k + 1] for k, line in enumerate(lines) if exchange in line]


def test_numbering_moves_the_lines_own_columns(spark):
    with _large_tables(spark):
        sent = _rows_sent(Layers(spark, SMALL).clean["order_items"], "Exchange hashpartitioning(order_id")
    assert len(sent) == 1 and "l_extendedprice" in sent[0]
    assert not any(made in sent[0] for made in ("AS product_id", "AS seller_id", "AS price", "AS freight_value"))


def test_items_come_back_with_one_name(spark):
    with _large_tables(spark):
        c = Layers(spark, SMALL).clean
        sent = _rows_sent(delivered_rows(c["orders"], c["customers"], c["order_items"], c["order_reviews"], c["products"], c["category_translation"],
                                         c["sellers"]), "Exchange hashpartitioning(order_id")
    back = [x for x in sent if "seller_state" in x]
    assert back and not any("category" in x for x in back)


def test_opportunities_number_the_items_once(spark):
    with _large_tables(spark), _whole_plans(spark):
        plan = _plan(growth.o7_opportunities(Layers(spark, SMALL)))
    assert [line for line in plan.split("\n") if "ReusedExchange" in line and "l_extendedprice" in line]
    assert not any("AS price" in x for x in _rows_sent(growth.o7_opportunities(Layers(spark, SMALL)), "Exchange hashpartitioning(order_id"))


def test_order_sums_are_hashed_and_customers_narrow(spark):
    with _large_tables(spark):
        L = Layers(spark, SMALL)
        assert "SortAggregate" not in _plan(quality._order_rows(L))
        L.stored = True  # all in one plan, nothing cached
        plan = _plan(quality.warehouse_numbers(L))
    by_customer = [line for line in plan.split("\n") if "Aggregate(keys=[customer_id" in line or "SortAggregate(key=[customer_id" in line]
    assert by_customer and not any("payment_total" in line or "n_i" in line or "seconds" in line for line in by_customer)


def test_payments_are_moved_once_by_order(spark):
    with _large_tables(spark):
        plan = _plan(payment_summary(Layers(spark, SMALL).clean["order_payments"]))
    assert plan.count("Exchange hashpartitioning(") == plan.count("FileScan parquet")
    assert _count(plan, "order_id") == plan.count("Exchange hashpartitioning(") and "Window" not in plan


def test_seller_insights_read_the_numbered_items(spark):
    """The sellers' sums take the summary's exchange of the items, and none is cached apart."""
    with _large_tables(spark), _whole_plans(spark):
        L = Layers(spark, SMALL)
        sent = _rows_sent(report._of_summary(L).select("key").unionByName(report._sellers(L).select(F.col("domain").alias("key"))),
                          "Exchange hashpartitioning(order_id")
        plan = _plan(report._sellers(L))
    assert sum("l_extendedprice" in x for x in sent) and not any("AS price" in x for x in sent)
    assert "InMemoryRelation" not in plan and "InMemoryTableScan" not in plan


def test_segments_keep_only_what_they_read(spark):
    with _large_tables(spark):
        result = releasing(lambda: rfm.r13_segment_summary(Layers(spark, SMALL)))
        plan, whole = _plan(result), releasing(lambda: rfm.compute_rfm(Layers(spark, SMALL)))
    assert "InMemoryTableScan" in plan and "customer_state" not in plan and "first_order_date" not in plan
    assert {"customer_state", "customer_city", "first_order_date", "last_order_date", "recency_days"} <= set(whole.columns)


def test_cohorts_need_no_join_by_person(spark):
    with _large_tables(spark), _whole_plans(spark):
        cells = _plan(cohort.cohort_long(Layers(spark, SMALL)))
    assert "Window" in cells and not [x for x in cells.split("\n") if "SortMergeJoin [customer_unique_id" in x]


def test_smoke_reads_the_months_once_and_keeps_narrow_sellers(spark):
    result = releasing(lambda: quality.v13_engine_smoke(Layers(spark, SMALL)))
    plan = _plan(result)
    assert "n_customers_served" not in plan and "top_category" not in plan and "customer_city" not in plan
    assert plan.count("rev_flag") and "InMemoryTableScan" in plan
