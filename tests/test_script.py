"""V10 over the suite and over scripts of our own."""

from pyspark.sql import functions as F

from souklens.operators import star
from souklens.plans import script as module
from souklens.plans.context import Layers
from souklens.plans.script import EXPECTED_STATEMENTS, v10_script_check
from souklens.plans.sqlsuite import SUITE, shared_tables
from souklens.sources.inline import local_table

SF = "/root/testdata/sf0.001"
SCRIPT = """-- orders by status
SELECT order_status, count(*) AS n FROM {fact_orders} GROUP BY order_status;
SELECT sum(item_revenue) AS revenue FROM {fact_sales} -- all items
"""


def test_suite_check_rows(spark):
    rows = v10_script_check(Layers(spark, SF)).collect()
    assert len(rows) == EXPECTED_STATEMENTS + 2
    assert rows[0].detail == "Queries found: 18" and all(r.status == "PASS" for r in rows)


def test_suite_reads_each_source_once(spark, monkeypatch):
    """18 queries, but the facts and what more than one query makes of them are computed by the first that asks."""
    read = []

    def once(df):
        stack, done = [df._jdf.queryExecution().optimizedPlan()], 0
        while stack:
            p = stack.pop()
            done += p.nodeName() == "InMemoryRelation"
            read.extend(f for f in ("lineitem", "orders", "events") if f"/{f}.parquet" in p.toString()
                        and p.nodeName().startswith(("LogicalRelation", "Relation")))
            stack.extend(p.children().apply(i) for i in range(p.children().size()))
        assert done, "a query reads no shared table"
        return run_in_full(df)

    run_in_full = module.run_in_full
    monkeypatch.setattr(module, "run_in_full", once)
    rows = v10_script_check(Layers(spark, SF)).collect()
    assert all(r.status == "PASS" for r in rows), rows
    assert not read
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_shared_tables_give_the_same_rows(spark):
    L = Layers(spark, SF)
    with module.reusing():
        w = shared_tables(L.star)
        for name in ("q04_repeat_customers", "q05_top_customers", "q12_category_share", "q15_top_products"):
            assert sorted(map(repr, SUITE[name](w).collect())) == sorted(map(repr, SUITE[name](L.star).collect())), name


def test_suite_over_facts_that_fail_gives_fail_rows(spark):
    L = Layers(spark, SF)
    bad = L.clean["orders"].withColumn("order_status", F.raise_error(F.lit("no orders")).cast("string"))
    rows = v10_script_check(L.with_clean(orders=bad)).collect()
    assert len(rows) == EXPECTED_STATEMENTS + 2
    assert rows[1].status == "FAIL" and "no orders" in rows[1].detail and rows[-1].status == "FAIL"


def test_payment_summary_adds_up_once(spark):
    """The sums by type make the order's, too; an order or a type that is not known keeps its old row."""
    df = local_table(spark, [("a", 1, "x", 2, 5), ("a", 2, "x", 7, 1), ("a", 3, "y", 1, 6), ("a", 4, None, 9, 50), ("b", 1, None, 3, 4),
                             ("c", 1, "z", 1, None), (None, 1, "x", 1, 3)],
                     "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(18)")
    out = star.payment_summary(df.withColumn("payment_value", F.col("payment_value").cast("decimal(18,2)")))
    assert out.schema["payment_total"].dataType.simpleString() == "decimal(28,2)"
    assert {tuple(str(v) for v in r) for r in out.collect()} == {
        ("a", "62.00", "4", "9", "x, y", "x"), ("b", "4.00", "1", "3", "", "None"), ("c", "None", "0", "1", "z", "z"),
        ("None", "3.00", "1", "1", "x", "None")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_script_that_runs(spark):
    rows = v10_script_check(Layers(spark, SF), SCRIPT, expected=2).collect()
    assert [r.status for r in rows] == ["PASS"] * 4 and rows[2].detail == "1 rows"


def test_statement_that_does_not_resolve(spark):
    rows = v10_script_check(Layers(spark, SF), SCRIPT + ";SELECT no_such_column FROM {fact_orders}", expected=2).collect()
    assert rows[0].status == "FAIL" and rows[0].detail == "Queries found: 3"
    assert [r.status for r in rows[1:4]] == ["PASS", "PASS", "FAIL"] and "no_such_column" in rows[3].detail
    assert rows[-1].status == "FAIL" and rows[-1].detail.startswith("Query 3:")


def test_statement_that_fails_only_when_it_runs(spark):
    """The failing column would be dropped by a bare count."""
    bad = "SELECT order_id, raise_error(order_status) AS x FROM {fact_orders}"
    rows = v10_script_check(Layers(spark, SF), SCRIPT + ";" + bad, expected=3).collect()
    assert [r.status for r in rows] == ["PASS", "PASS", "PASS", "FAIL", "FAIL"]


def test_local_table_is_a_local_relation(spark):
    t = local_table(spark, [(1, "a'b"), (2, None)], "k int, v string")
    assert [tuple(r) for r in t.orderBy("k").collect()] == [(1, "a'b"), (2, None)]
    assert t.schema.simpleString() == "struct<k:int,v:string>"
    assert "LocalTableScan" in t._jdf.queryExecution().executedPlan().toString()
    assert t.select(F.sum("k")).first()[0] == 3
