"""Reports as rules over one table of numbers; masks and summaries on hand-made rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souklens.operators import summary
from souklens.operators.keys import Source, key_masks, keys_of, orphans_of, rows_of
from souklens.plans import report
from souklens.plans.context import Layers

SF = "/root/testdata/sf0.001"
DAY = dt.timedelta(days=1)


def test_rules_are_data(spark):
    rules = [("own", 1, 1, "month", 1, 2, "{key}", "", "{revenue:2} of {total.1.revenue:2}, {month.last.key} is last"),
             ("own", 2, 1, "total", 1, 1, "", "", "{state.1.key}: {state.1.share:p2}%, {nothing.1.key}, {score:p1}"),
             ("other", 1, 1, "total", 1, 1, "", "", "not asked for")]
    L = Layers.shared(spark, SF)
    got = report.report(L, "own", rules).orderBy("section", "rank").collect()
    numbers = {(r["domain"], r["rank"]): r for r in report.report_rows(L, rules).collect()}
    assert not {d for d, _ in numbers} & set(report.OWN_DOMAINS)  # domains that no rule quotes are not computed
    last = max(k for d, k in numbers if d == "month")
    total = numbers["total", 1]["revenue"]
    for r, k in zip(got, (1, 2)):
        month = numbers["month", k]
        assert (r["title"], r["key"]) == (month["key"], month["key"])
        assert r["text"] == f"{month['revenue']:,.2f} of {total:,.2f}, {numbers['month', last]['key']} is last"
    assert got[2]["text"].endswith(f", n/a, {numbers['total', 1]['score']:.1f}") and got[2]["text"].startswith(numbers["state", 1]["key"])
    assert len(got) == 3
    ranked = [numbers["state", k]["revenue"] for k in range(1, max(k for d, k in numbers if d == "state") + 1)]
    assert ranked == sorted(ranked, reverse=True)
    assert numbers["state", 1]["share"] == pytest.approx(100 * ranked[0] / sum(ranked)) and numbers["state", len(ranked)]["cum"] == pytest.approx(100)


def test_every_section_is_there(spark):
    L = Layers.shared(spark, SF)
    assert {r[1] for r in report.RULES if r[0] == "N2"} == set(range(11))
    assert sorted(r[1] for r in report.RULES if r[0] == "N3") == list(range(1, 11))
    assert sorted(r[1] for r in report.RULES if r[0] == "A25") == list(range(1, 13))
    lines = report.n02_report_lines(L).collect()
    assert sorted(r["seq"] for r in lines) == list(range(1, len(lines) + 1)) and not any("{" in r["line"] for r in lines)


def _frames(spark, orders, items, reviews):
    o = spark.createDataFrame([(i, f"c{i}", s, dt.datetime(2018, 1, 5), None if d is None else dt.datetime(2018, 1, 5) + d * DAY, dt.datetime(2018, 1, 15))
                               for i, s, d in orders], "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
                              "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    c = spark.createDataFrame([(f"c{i}", "SP" if k % 2 else "RJ") for k, (i, _, _) in enumerate(orders)], "customer_id string, customer_state string")
    it = spark.createDataFrame([(o_, n, p, s, Decimal(a), Decimal(b)) for o_, n, p, s, a, b in items], "order_id string, order_item_id int, product_id string, "
                               "seller_id string, price decimal(18,2), freight_value decimal(18,2)")
    r = spark.createDataFrame(reviews, "order_id string, review_score int")
    p = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p3", None)], "product_id string, product_category_name string")
    t = spark.createDataFrame([("x", "Ex")], "product_category_name string, product_category_name_english string")
    s = spark.createDataFrame([("s1", "SP"), ("s2", None)], "seller_id string, seller_state string")
    return o, c, it, r, p, t, s


def test_summary_counts_orders_once(spark):
    orders = [("a", "delivered", 20), ("b", "delivered", 3), ("c", "canceled", 3), ("d", "delivered", None)]
    items = [("a", 1, "p1", "s1", "10.00", "1.00"), ("a", 2, "p1", "s2", "20.00", "2.00"), ("a", 3, "p2", "s1", "5.00", "0.50"),
             ("b", 1, "p3", "s2", "7.00", "0.70"), ("c", 1, "p1", "s1", "99.00", "9.00")]
    rows = summary.delivered_rows(*_frames(spark, orders, items, [("a", 1), ("b", 5), ("d", 4)]))
    got = {(r["dim"], r["key"]): r for r in summary.delivered_summary(rows).collect()}
    total = got["total", None]
    assert (total["n_orders"], total["n_items"], total["order_value_n"], total["known"], total["late"]) == (3, 4, 2, 2, 1)  # d has no items
    assert total["revenue"] == total["order_value_sum"] == Decimal("46.20")
    assert (total["score_sum"], total["score_n"], total["order_score_sum"], total["order_score_n"]) == (8, 4, 10, 3)
    assert (got["category", "Ex"]["n_orders"], got["category", "Ex"]["n_items"]) == (1, 2) and got["category", None]["n_items"] == 2
    assert {k: got["label", k]["n_orders"] for d, k in got if d == "label"} == {"Ex": 1, "y": 1, "Unknown": 1, None: 0}
    assert got["seller_state", "SP"]["n_orders"] == 1 and got["seller_state", "SP"]["n_items"] == 2
    assert {k: got["delivery_bin", k]["n_orders"] for d, k in got if d == "delivery_bin"} == {"0-5d": 1, "15-20d": 1, None: 1}
    assert {k: got["punctuality", k]["order_score_sum"] for d, k in got if d == "punctuality"} == {"late": 1, "on time": 5, None: 4}


def test_masks_of_null_and_repeated_keys(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x", 1), ("z", 2), (None, 3)], "k string, v int")
    m = key_masks([Source("a", a, {"k": "k"}), Source("b", b, {"k": "k", "v": "v"}, {"total": F.col("v")})])
    r = m.agg(rows_of("a", "k").alias("rows"), keys_of("a", "k").alias("keys"), orphans_of("a", "b", "k").alias("ab"),
              orphans_of("b", "a", "k").alias("ba"), keys_of("b", "v").alias("vs"), F.sum("total").cast("int").alias("total")).first()
    assert tuple(r) == (4, 2, 2, 2, 3, 6)  # a NULL key has no parent, on either side
    assert {x["key"]: x["mask"] for x in m.where("domain = 'k'").collect()} == {"x": 3, "y": 1, "z": 2, None: 3}
    empty = key_masks([Source("a", a.limit(0), {"k": "k"}), Source("b", b.limit(0), {"k": "k"})])
    assert tuple(empty.agg(rows_of("a", "k"), keys_of("a", "k"), orphans_of("a", "b", "k")).first()) == (0, 0, 0)


def test_ladder_equals_direct_counts(spark):
    from souklens.operators import enrich

    orders = [(f"o{k}", "delivered" if k % 4 else "shipped", 3) for k in range(40)]
    items = [(f"o{k}", n, f"p{1 + (k + n) % 3}", "s1" if (k * n) % 5 else "s2", f"{k}.10", "1.00") for k in range(40) for n in range(1, 4)]
    o, _, it, r, p, t, s = _frames(spark, orders, items, [(f"o{k}", 1 + k % 5) for k in range(0, 40, 3)])
    p = p.withColumns({c: F.lit(1.0) for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")})
    got = {x["seller_id"]: x for x in enrich.seller_analytics(s.withColumn("seller_city", F.lit("c")), it, o, r, p, t).collect()}
    sold = [x for x in items if int(x[0][1:]) % 4]
    names = {"p1": "Ex"}
    for seller in ("s1", "s2"):
        mine = [x for x in sold if x[3] == seller]
        scores = [1 + int(x[0][1:]) % 5 for x in mine if int(x[0][1:]) % 3 == 0]
        row = got[seller]
        assert (row["total_items_sold"], row["n_unique_orders"], row["n_unique_products"]) == (len(mine), len({x[0] for x in mine}), len({x[2] for x in mine}))
        assert row["total_product_revenue"] == sum(Decimal(x[4]) for x in mine)
        assert row["avg_review_score"] == pytest.approx(sum(scores) / len(scores))
        assert row["top_category"] == ("Ex" if any(x[2] in names for x in mine) else "unknown")
