"""Hand-made frames for the semantic traps the jobs must reproduce."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from souklens.functions.buckets import fixed_bucket, histogram, with_quintile, with_quintiles
from souklens.functions.numeric import pct, rnd, share_if
from souklens.functions.stats import asc, desc_ts, first_by, mode_by_count, sorted_set_join
from souklens.operators import clean as C
from souklens.operators import star as D


def _bins(spark, values, reverse=False):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
    out = with_quintile(df, "v", "b", reverse=reverse).orderBy("id")
    return [r.b for r in out.collect()]


def test_quintiles_unique_edges(spark):
    assert _bins(spark, list(range(1, 11))) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert _bins(spark, list(range(1, 11)), reverse=True) == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]


def test_quintiles_repeated_edges_fall_back_to_equal_width(spark):
    # mostly 1 → quantile edges repeat → equal-width bins over [1, 6]
    vals = [1.0] * 8 + [2.0, 6.0]
    assert _bins(spark, vals) == [1] * 8 + [1, 5]
    vals = [1.0] * 8 + [3.5, 6.0]  # 3.5 sits in (3, 4]
    assert _bins(spark, vals)[8] == 3


def test_quintiles_all_equal_land_in_bin_three(spark):
    assert _bins(spark, [7.0] * 5) == [3] * 5


def test_quintiles_many_columns_one_pass(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(1, 11)], "id int, a double, b double")
    out = with_quintiles(df, [("a", "qa", False), ("b", "qb", True)]).orderBy("id").collect()
    assert [r.qa for r in out] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert {r.qb for r in out} == {3}


def test_first_by_newest_nulls_last_ties_by_id(spark):
    t1, t2 = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
    df = spark.createDataFrame([("o1", "r2", t2), ("o1", "r1", t2), ("o1", "r0", t1), ("o2", "r9", None), ("o2", "r8", t1)],
                               "order_id string, review_id string, ts timestamp_ntz")
    out = first_by(df, ["order_id"], desc_ts("ts") + asc("review_id"), ["review_id"]).orderBy("order_id").collect()
    assert [r.review_id for r in out] == ["r1", "r8"]


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b"), ("s", "a"), ("s", None), ("t", None)],
                               "seller_id string, cat string")
    out = {r.seller_id: r.top for r in mode_by_count(df, ["seller_id"], "cat", "top").collect()}
    assert out == {"s": "a"}


def test_sorted_set_join(spark):
    df = spark.createDataFrame([("o", "voucher"), ("o", "boleto"), ("o", "voucher")], "k string, t string")
    assert df.groupBy("k").agg(sorted_set_join("t", ", ").alias("m")).first().m == "boleto, voucher"


def test_fixed_bucket_drops_lowest_edge_and_outside(spark):
    df = spark.createDataFrame([(0.0,), (0.01,), (10.0,), (500.0,), (500.5,)], "x double")
    out = [r.b for r in df.select(fixed_bucket("x", [0, 10, 500], ["a", "b"]).alias("b")).collect()]
    assert out == [None, "a", "a", "b", None]


def test_histogram_last_bin_closed_and_zero_width(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    h = {r.bin: r["count"] for r in histogram(df, "x", 2, "h").collect()}
    assert h == {0: 1, 1: 2}
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r["count"]) for r in histogram(one, "x", 5, "h").collect()] == [(2, 2)]


def test_share_keeps_nulls_in_denominator(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (1,)], "d int")
    assert df.agg(rnd(share_if(F.col("d") == 1)).alias("p")).first().p == 50.0


def test_zero_base_growth_is_null(spark):
    df = spark.createDataFrame([(Decimal("5.00"), Decimal("0.00"))], "a decimal(18,2), b decimal(18,2)")
    assert df.select(pct(F.col("a") - F.col("b"), "b").alias("g")).first().g is None


def test_round_half_up_on_decimal_value(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.005,)], "x double")
    assert [r.y for r in df.select(rnd("x").alias("y")).collect()] == [1.01, 2.68, -1.01]


def test_geolocation_dedup_bounds_and_null_coordinates(spark):
    rows = [(1, -10.0, -50.0, " Sao Paulo", "sp"), (1, -10.0, -50.0, " Sao Paulo", "sp"),
            (2, 10.0, -50.0, "x", "rj"), (3, None, None, "y", "mg"), (4, -10.0, -50.0, "SAO PAULO ", "SP")]
    df = spark.createDataFrame(rows, "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
                                     "geolocation_city string, geolocation_state string")
    out = C.clean_geolocation(df).orderBy("geolocation_zip_code_prefix").collect()
    assert [r.geolocation_zip_code_prefix for r in out] == [1, 3, 4]
    assert out[0].geolocation_city == "sao paulo" and out[0].geolocation_state == "SP"


def test_payment_cleaning(spark):
    df = spark.createDataFrame([("o", 1, "not_defined", 2, Decimal("0.00")), ("o", 2, "credit_card", 0, Decimal("3.00"))],
                               "order_id string, payment_sequential int, payment_type string, payment_installments int, "
                               "payment_value decimal(18,2)")
    out = C.clean_order_payments(df).orderBy("payment_sequential").collect()
    assert [(r.payment_type, r.payment_installments, r.is_zero_payment) for r in out] == [
        ("unknown", 2, True), ("credit_card", 1, False)]


def test_primary_payment_type_tie_is_alphabetical(spark):
    df = spark.createDataFrame([("o", 1, "voucher", 1, Decimal("5.00")), ("o", 2, "boleto", 1, Decimal("5.00")),
                                ("p", 1, "voucher", 1, Decimal("9.00")), ("p", 2, "boleto", 1, Decimal("5.00"))],
                               "order_id string, payment_sequential int, payment_type string, payment_installments int, "
                               "payment_value decimal(18,2)")
    out = {r.order_id: r.primary_payment_type for r in D.payment_summary(df).collect()}
    assert out == {"o": "boleto", "p": "voucher"}


def test_warehouse_delay_flag_unknown_is_zero(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([("a", t, None, t), ("b", t, t + dt.timedelta(days=3), t + dt.timedelta(days=1))],
                               "order_id string, order_purchase_timestamp timestamp_ntz, "
                               "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    out = {r.order_id: (r.is_delayed, r.delivery_days) for r in D.prepare_orders(df).collect()}
    assert out == {"a": (0, None), "b": (1, 3.0)}


def test_typed_csv_roundtrip_and_unknown_name(spark, tmp_path):
    import pytest

    from souklens.plans.context import Layers
    from souklens.sources import io

    L = Layers(spark, "/root/testdata/sf0.001")
    base = str(tmp_path)
    for name in ("orders", "order_items"):
        L.raw[name].write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{base}/{name}.csv")
    back = io.load_table(spark, "orders", base)
    assert back.schema.simpleString() == L.raw["orders"].schema.simpleString()
    assert back.count() == L.raw["orders"].count()
    assert back.exceptAll(L.raw["orders"]).count() == 0
    with pytest.raises(ValueError):
        io.load_table(spark, "nope", base)


def test_run_script_keeps_going(spark):
    from souklens.sources import io

    out = io.run_script(spark, "SELECT 1 AS a; SELECT * FROM missing_table_xyz; SELECT 1 WHERE false -- c\n;").collect()
    assert [(r.statement, r.status) for r in out] == [(1, "ok"), (2, "error"), (3, "empty")]


def test_order_filter_end_bound_is_midnight_and_day_filter_is_inclusive(spark):
    from souklens.operators.filters import FilterSpec, apply_order_filters, filter_orders_by_day

    ts = [dt.datetime(2020, 1, 1, 0, 0), dt.datetime(2020, 1, 31, 0, 0), dt.datetime(2020, 1, 31, 10, 0),
          dt.datetime(2020, 2, 1, 0, 0)]
    o = spark.createDataFrame([(f"o{i}", t, "SP", "delivered") for i, t in enumerate(ts)],
                              "order_id string, order_purchase_timestamp timestamp_ntz, customer_state string, order_status string")
    window = (dt.date(2020, 1, 1), dt.date(2020, 1, 31))
    # the end date's later orders fall outside; payment types are accepted and ignored
    kept = apply_order_filters(o, window, None, ["delivered"], ["voucher"]).select("order_id").collect()
    assert sorted(r.order_id for r in kept) == ["o0", "o1"]
    # whole calendar days on both ends
    kept = filter_orders_by_day(o, FilterSpec(date_range=window)).select("order_id").collect()
    assert sorted(r.order_id for r in kept) == ["o0", "o1", "o2"]
