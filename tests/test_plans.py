"""Plan hygiene for every registered job: no cartesian products, no Python
evaluation, and every nested-loop join broadcasts a side of at most one row."""

import pytest

from souklens import registry

SF = "/root/testdata/sf0.001"


def test_no_cartesian_product_or_python_eval(spark):
    # one plan at a time, keeping only its text
    for name, q in registry.spark_queries().items():
        text = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text, name
        assert "EvalPython" not in text, name


def _nodes(plan):
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        kids = p.children()
        stack.extend(kids.apply(i) for i in range(kids.size()))


def _at_most_one_row(p) -> bool:
    m = p.maxRows()
    return m.isDefined() and m.get() <= 1


def test_joins_without_keys_have_a_one_row_side(spark):
    # every join without equi-join keys (the one-row totals, edges and medians
    # cross-joined back, possibly with a filter folded into the condition) has
    # a side Catalyst proves to hold at most one row
    equi = getattr(spark._jvm.org.apache.spark.sql.catalyst.planning, "ExtractEquiJoinKeys$").__getattr__("MODULE$")
    seen = 0
    for name, q in registry.spark_queries().items():
        opt = q(spark, SF)._jdf.queryExecution().optimizedPlan()
        for p in _nodes(opt):
            if p.nodeName() == "Join" and equi.unapply(p).isEmpty():
                seen += 1
                assert _at_most_one_row(p.left()) or _at_most_one_row(p.right()), name
    assert seen > 0


SCORE_JOBS = ("q10_review_vs_delay", "a04_review_distribution", "e3_customer_analytics", "i1_seller_scorecard")
PRICE_JOBS = ("a14_logistics", "a17_freight_price_corr", "w10_monthly_growth", "w13_growth_headline", "w14_rolling_revenue")


def test_score_jobs_do_not_read_review_texts(spark):
    qs = registry.spark_queries()
    for name in SCORE_JOBS:
        text = qs[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "review_comment_message" not in text and "review_comment_title" not in text, name


def test_price_jobs_read_neither_products_nor_sellers(spark):
    qs = registry.spark_queries()
    for name in PRICE_JOBS:
        text = qs[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "part.parquet" not in text and "supplier.parquet" not in text, name


def test_no_cartesian_product_with_broadcast_off(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, q in registry.spark_queries().items():
            if name == "v10_script_check":  # runs its queries while it is built
                continue
            assert "CartesianProduct" not in q(spark, SF)._jdf.queryExecution().executedPlan().toString(), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_building_a_plan_starts_no_job(spark):
    sc = spark.sparkContext
    sc.setJobGroup("plans", "building plans")
    try:
        for name, q in registry.spark_queries().items():
            if name != "v10_script_check":
                q(spark, SF)
        assert not list(sc.statusTracker().getJobIdsForGroup("plans"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def _scans(spark, name) -> tuple[dict, int]:
    """Files that the physical plan scans, with how often, and its joins; broadcasts off, before any reuse."""
    import re
    from collections import Counter

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.spark_queries()[name](spark, SF)
        found, joins, stack = Counter(), 0, [df._jdf.queryExecution().executedPlan()]
        while stack:
            p = stack.pop()
            if p.nodeName().startswith("AdaptiveSparkPlan"):
                stack.append(p.inputPlan())
                continue
            if m := re.search(r"FileScan parquet.*?/(\w+)\.parquet\]", p.simpleString(1000)):
                found[m[1]] += 1
            joins += "Join" in p.nodeName()
            kids = p.children()
            stack.extend(kids.apply(i) for i in range(kids.size()))
        return found, joins
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name,most,joins", [
    ("o7_opportunities", {"lineitem": 2, "part": 2, "orders": 5}, 14), ("e5_seller_analytics", {"lineitem": 1, "part": 2}, 6),
    ("v04_v09_warehouse_checks", {"lineitem": 0, "orders": 6}, 10),  # items and payments are cached for the job, read once each
    ("v01_post_clean_validation", {"lineitem": 4, "orders": 5}, 12), ("v14_orders_without_children", {"lineitem": 2, "orders": 1}, 0)])
def test_tables_are_read_a_bounded_number_of_times(spark, name, most, joins):
    found, n = _scans(spark, name)
    assert {t: k for t, k in found.items() if k > most.get(t, 99)} == {}
    assert n <= joins


def test_cached_tables_leave_with_their_job(spark):
    import gc

    def stored():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    gc.collect()
    before = stored()
    df = registry.spark_queries()["v04_v09_warehouse_checks"](spark, SF)
    rows = sorted(map(tuple, df.collect()))
    assert stored() == before + 2
    later = df.where("status = 'PASS'")
    del df
    gc.collect()
    assert stored() == before
    assert len(later.collect()) == len(rows)  # a plan that outlives the job computes them again
