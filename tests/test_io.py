"""Sources and sinks: S2, S4, S6, S8-S11, F12, rejected cells, table sizes."""

import json
from pathlib import Path

import pytest

from souklens import registry
from souklens.plans.context import Layers
from souklens.sources import io

SF = "/root/testdata/sf0.001"
ORDERS = ("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
          "order_delivered_customer_date,order_estimated_delivery_date\n")


def _csv(folder, name, text):
    (folder / f"{name}.csv").write_text(text, encoding="utf-8")


def test_load_checked_lists_every_lost_cell(spark, tmp_path):
    _csv(tmp_path, "orders", ORDERS
         + "a,c1,delivered,2018-01-02 03:04:05,,,,2018-02-01 00:00:00\n"
         + "b,c2,delivered,02/01/2018,2018-13-01 00:00:00,,,2018-02-01 00:00:00\n"
         + "c,c3,shipped,2018-01-02 03:04:05\n"
         + "d,c4,shipped,2018-01-02 03:04:05,,,,,extra\n")
    typed, rejected = io.load_checked(spark, "orders", str(tmp_path))
    assert sorted(map(tuple, rejected.collect())) == [
        ("orders", "_corrupt_record", "c,c3,shipped,2018-01-02 03:04:05"), ("orders", "_corrupt_record", "d,c4,shipped,2018-01-02 03:04:05,,,,,extra"),
        ("orders", "order_approved_at", "2018-13-01 00:00:00"), ("orders", "order_purchase_timestamp", "02/01/2018")]
    assert typed.schema.simpleString() == io.load_table(spark, "orders", str(tmp_path)).schema.simpleString()
    assert sorted(map(str, typed.collect())) == sorted(map(str, io.load_table(spark, "orders", str(tmp_path)).collect()))
    assert rejected.select("table").count() == 4  # a query that needs one column sees the same lines

    _csv(tmp_path, "order_payments", "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
         "a,1,boleto,one,10.50\nb,x,boleto,1,abc\nc,,voucher,,\nd,2,voucher, 3 ,1.005\n")
    typed, rejected = io.load_checked(spark, "order_payments", str(tmp_path))
    assert sorted(map(tuple, rejected.collect())) == [("order_payments", "payment_installments", "one"),
                                                      ("order_payments", "payment_sequential", "x"), ("order_payments", "payment_value", "abc")]
    assert [r.payment_installments for r in typed.orderBy("order_id").collect()] == [None, 1, None, 3]
    with pytest.raises(ValueError):
        io.load_checked(spark, "nope", str(tmp_path))


def test_given_tables_have_no_rejects(spark, tmp_path):
    L = Layers(spark, SF)
    L.raw["orders"].write.option("header", True).option("timestampNTZFormat", io.TIME_FORMAT).csv(str(tmp_path / "orders.csv"))
    typed, rejected = io.load_checked(spark, "orders", str(tmp_path))
    assert rejected.count() == 0 and typed.exceptAll(L.raw["orders"]).count() == 0 and typed.count() == L.raw["orders"].count()


def test_load_processed_coerces_and_lists(spark, tmp_path):
    # Unparsable cells become NULL, and are listed
    _csv(tmp_path, "t", "id,when,late,n\n1,2018-01-02 03:04:05,1.0,7\n2,yesterday,maybe,\n3,,,8x\n")
    path = str(tmp_path / "t.csv")
    rows = io.load_processed(spark, path, ["when"], {"late": "double", "n": "int"}).orderBy("id").collect()
    assert [(str(r.when), r.late, r.n) for r in rows] == [("2018-01-02 03:04:05", 1.0, 7), ("None", None, None), ("None", None, None)]
    lost = io.rejected_cells(spark, path, "t", ["when"], {"late": "double", "n": "int"}).collect()
    assert sorted(map(tuple, lost)) == [("t", "late", "maybe"), ("t", "n", "8x"), ("t", "when", "yesterday")]
    assert io.load_processed(spark, path).dtypes == [("id", "string"), ("when", "string"), ("late", "string"), ("n", "string")]
    assert io.rejected_cells(spark, path, "t").count() == 0


def test_load_all_tables_and_views(spark, tmp_path):
    # S2
    from souklens.sources.schema import RAW_SCHEMAS

    for name, st in RAW_SCHEMAS.items():
        _csv(tmp_path, name, ",".join(st.fieldNames()) + "\n")
    _csv(tmp_path, "sellers_2018", "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,12,x,SP\n")
    tables = io.load_all_tables(spark, str(tmp_path), {"sellers": "sellers_2018.csv"}, register_views=True)
    assert set(tables) == set(RAW_SCHEMAS)
    assert all(df.schema.simpleString() == RAW_SCHEMAS[n].simpleString() for n, df in tables.items())
    # Parameters are bound, not spliced
    got = io.run_query(spark, "SELECT seller_id FROM sellers WHERE seller_state = :state LIMIT :n", {"state": "SP", "n": 1}).collect()
    assert [r.seller_id for r in got] == ["s1"]
    assert io.run_query(spark, "SELECT * FROM sellers WHERE seller_state = :state", {"state": "SP' OR '1'='1"}).count() == 0
    for name in RAW_SCHEMAS:
        spark.catalog.dropTempView(name)


def test_kpis_and_csv_read_back(spark, tmp_path):
    # S8, S10
    L = Layers(spark, SF)
    names = io.export_kpis(L, str(tmp_path))
    assert names == ["k1_kpi_summary", "k2_monthly_performance", "k3_category_performance", "k4_state_performance", "k5_payment_performance"]
    for name in names:
        back = spark.read.option("header", True).csv(str(tmp_path / name))
        want = registry.run(name, L)
        assert back.columns == want.columns
        assert sorted(map(tuple, back.collect()), key=str) == sorted(
            (tuple(None if v is None else str(v) for v in r) for r in want.select([want[c].cast("string") for c in want.columns]).collect()), key=str)


def test_text_report_keeps_its_order(spark, tmp_path):
    # S11
    lines = spark.createDataFrame([(k, f"line {k}") for k in range(200)], "seq int, line string").repartition(7)
    io.export_text(lines, str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "report").glob("part-*")))
    assert text.splitlines() == [f"line {k}" for k in range(200)]


def test_metrics_document_holds_every_job(spark, tmp_path):
    # One file, read back equal to A1 to A25
    from souklens.plans.eda import EDA_JOBS

    L = Layers.shared(spark, SF)
    io.export_metrics(L, str(tmp_path / "metrics"))
    (file,) = Path(tmp_path / "metrics").glob("part-*")
    document = json.loads(file.read_text())
    assert set(document) == {*EDA_JOBS, "a25_eda_insights"}
    for name in ("a02_status_distribution", "a05_business_kpis", "a14_logistics", "a22_correlation_matrix", "a25_eda_insights"):
        want = sorted((r.asDict(recursive=True) for r in registry.run(name, L).collect()), key=repr)
        assert sorted(json.loads(json.dumps(document[name])), key=repr) == [json.loads(json.dumps(x, default=str)) for x in want], name


def test_stored_tables_have_their_size(spark, tmp_path):
    # Rows, columns and bytes of the written tables
    from souklens.plans import quality
    from souklens.sources.warehouse import build_warehouse

    wh = tmp_path / "wh"
    build_warehouse(Layers.shared(spark, SF), str(wh), buckets=2)
    L = Layers.from_warehouse(spark, str(wh))
    rows = {r["table"]: r for r in quality.v11_table_inventory(L).collect()}
    assert set(rows) == set(quality.WAREHOUSE_TABLES)
    for t, r in rows.items():
        assert r["bytes"] == sum(p.stat().st_size for p in (wh / t).rglob("*.parquet")), t
    raw = {r["table"]: (r["rows"], r["columns"], r["bytes"]) for r in quality.v11_table_inventory(Layers.shared(spark, SF)).collect()}
    assert raw == {t: (r["rows"], r["columns"], None) for t, r in rows.items()}
