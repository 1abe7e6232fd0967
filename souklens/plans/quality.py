"""Data-quality and validation checks (V1-V14) as (check, status, detail) rows.

Uniqueness and orphan checks come from key-presence masks (``operators.keys``)
and sums over the same rows: each table is read once, the numbers end in one
row, and that row is spread into the checks.  Nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.numeric import money, pct, rnd
from souklens.functions.quantiles import exact_quantiles
from souklens.functions.reuse import reused
from souklens.operators.keys import Source, key_masks, keys_of, orphans_of, rows_of
from souklens.operators.summary import summary_of
from souklens.plans.context import Layers
from souklens.sources.inline import local_table


# Fixed value: the category name of products without one.
UNCATEGORISED = "Unknown / Uncategorized"


# The names of the checks of V1 and of V4 to V9, in order.
V1_CHECKS = [
    "customers PK",
    "orders PK",
    "products PK",
    "sellers PK",
    "order_reviews one-per-order",
    "orders→customers FK",
    "order_items→orders FK",
    "order_items→products FK",
    "order_items→sellers FK",
    "order_payments→orders FK",
    "orders_enriched grain = 1 row per order",
    "items_enriched row count matches order_items",
    "Revenue consistency: sum(order_items) ≈ sum(orders_enriched.total_order_revenue)",
    "orders dates are datetime",
    "No negative delivery_days",
]
V49_CHECKS = [
    "customers.customer_id unique",
    "orders.order_id unique",
    "products.product_id unique",
    "sellers.seller_id unique",
    "fact_orders.order_id unique",
    "fact_sales order_id + order_item_id unique",
    "order_items -> orders",
    "order_payments -> orders",
    "order_reviews -> orders",
    "fact_sales -> fact_orders",
    "fact_orders -> dim_customer",
    "Fact revenue reconciliation",
    "Order revenue matches sales grain",
    "Payment totals not duplicated",
    "Customer population is valid",
    "Repeat customer calculation is valid",
    "Delivered order count",
    "Average delivery days valid",
    "Delayed orders are within delivered orders",
    "No invalid quarter values",
    "Delivered orders > 0",
    "Revenue > 0",
    "AOV > 0",
]


def _n(c) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def _m(c) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 2)


def _check(name: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), F.when(passed, "PASS").otherwise("FAIL").alias("status"), detail.alias("detail"))


def _checks(one: DataFrame, checks: list[Column]) -> DataFrame:
    """The one row of numbers spread into one row for each check."""
    return one.select(F.explode(F.array(*checks)).alias("r")).select("r.*")


def _known(one: DataFrame, observed: dict | None) -> DataFrame:
    """The one row with observed numbers in place of its own; what only they
    needed is then neither aggregated nor read."""
    return one.withColumns({k: F.lit(v) for k, v in observed.items() if k in one.columns}) if observed else one


def _none(count: str, name: str, text: str) -> Column:
    """A check that a count is zero."""
    return _check(name, F.col(count) == 0, F.format_string(text, _n(count)))


def item_measures() -> dict[str, Column]:
    """V1's item sums, as aggregates: also observed while the table is written."""
    return {"price": F.coalesce(F.sum("price"), F.lit(0)), "freight": F.coalesce(F.sum("freight_value"), F.lit(0))}


def order_enriched_measures() -> dict[str, Column]:
    """V1's sums over orders_enriched."""
    return {"oe_revenue": F.coalesce(F.sum("total_order_revenue"), F.lit(0)), "negative": F.count_if(F.col("delivery_seconds") < 0)}


def v01_post_clean_validation(L: Layers, observed: dict | None = None) -> DataFrame:
    """V1: the 15 post-cleaning checks.  Sums and counts that were observed
    while the tables were written are not read again."""
    c = L.clean
    masks = key_masks([
        Source("customers", c["customers"], {"customer": "customer_id"}),
        Source("orders", c["orders"], {"order": "order_id", "customer": "customer_id"}),
        Source("products", c["products"], {"product": "product_id"}),
        Source("sellers", c["sellers"], {"seller": "seller_id"}),
        Source("reviews", c["order_reviews"], {"order": "order_id"}),
        Source("items", c["order_items"], {"order": "order_id", "product": "product_id", "seller": "seller_id"},
               {"price": F.col("price"), "freight": F.col("freight_value")}),
        Source("payments", c["order_payments"], {"order": "order_id"}),
        Source("oe", L.enriched["orders_enriched"], {"order": "order_id"},
               {"oe_revenue": F.col("total_order_revenue"), "negative": (F.col("delivery_seconds") < 0).cast("int")}),
        Source("ie", L.enriched["order_items_enriched"], {"order": "order_id"})])
    unique = [("customers", "customer"), ("orders", "order"), ("products", "product"), ("sellers", "seller"), ("reviews", "order"), ("oe", "order")]
    links = [("orders", "customers", "customer"), ("items", "orders", "order"), ("items", "products", "product"),
             ("items", "sellers", "seller"), ("payments", "orders", "order")]
    total = {name: F.coalesce(F.sum(name), F.lit(0)) for name in ("price", "freight", "oe_revenue", "negative")}
    one = masks.agg(
        *[rows_of(t, d).alias(f"rows_{t}") for t, d in unique], *[keys_of(t, d).alias(f"keys_{t}") for t, d in unique],
        *[orphans_of(child, parent, d).alias(f"{child}_{parent}") for child, parent, d in links],
        rows_of("ie", "order").alias("rows_ie"), rows_of("items", "order").alias("rows_items"),
        *[t.cast("decimal(38,2)").alias(name) for name, t in total.items()])
    one = _known(one, observed).withColumns({
        "a": (F.col("price") + F.col("freight")).cast("decimal(38,2)"), "b": F.col("oe_revenue").cast("decimal(38,2)"),
        "negative": F.col("negative").cast("long")}).withColumn("d", F.abs(F.col("a") - F.col("b")))

    def one_per_key(table: str, name: str, text: str = "%s unique / %s rows") -> Column:
        return _check(name, F.col(f"rows_{table}") == F.col(f"keys_{table}"), F.format_string(text, _n(f"keys_{table}"), _n(f"rows_{table}")))

    dates = c["orders"].schema["order_purchase_timestamp"].dataType
    return _checks(one, [
        one_per_key("customers", V1_CHECKS[0]), one_per_key("orders", V1_CHECKS[1]), one_per_key("products", V1_CHECKS[2]),
        one_per_key("sellers", V1_CHECKS[3]),
        one_per_key("reviews", V1_CHECKS[4], "%s unique order_id / %s rows"),
        _none("orders_customers", V1_CHECKS[5], "%s orphan orders"),
        _none("items_orders", V1_CHECKS[6], "%s orphan items"),
        _none("items_products", V1_CHECKS[7], "%s orphan items (product)"),
        _none("items_sellers", V1_CHECKS[8], "%s orphan items (seller)"),
        _none("payments_orders", V1_CHECKS[9], "%s orphan payments"),
        one_per_key("oe", V1_CHECKS[10]),
        _check(V1_CHECKS[11], F.col("rows_ie") == F.col("rows_items"),
               F.format_string("items_enriched=%s, order_items=%s", _n("rows_ie"), _n("rows_items"))),
        _check(V1_CHECKS[12], F.col("d") < 1.0,
               F.format_string("order_items sum=R$%s, enriched sum=R$%s, diff=R$%s", _m("a"), _m("b"), _m("d"))),
        _check(V1_CHECKS[13], F.lit(dates.typeName().startswith("timestamp")), F.lit(dates.simpleString())),
        _none("negative", V1_CHECKS[14], "%s orders with negative delivery days")])


def _is_delivered() -> Column:
    return F.coalesce(F.col("order_status") == "delivered", F.lit(False))


def fact_order_measures() -> dict[str, Column]:
    """V6, V8 and V9 from fact_orders alone, as aggregates: also observed while the table is written."""
    dlv, q = _is_delivered(), F.quarter("order_purchase_timestamp")
    return {"rows_fact_orders": F.count(F.lit(1)), "payment_total": F.coalesce(F.sum("payment_total"), F.lit(0)),
            "delivered": F.count_if(dlv), "revenue": F.coalesce(F.sum(F.when(dlv, F.col("order_revenue"))), F.lit(0)),
            "seconds": F.sum(F.when(dlv, F.col("delivery_seconds"))), "seconds_n": F.count(F.when(dlv, F.col("delivery_seconds"))),
            "late": F.count_if(dlv & (F.col("is_delayed") == 1)), "bad_quarters": F.count_if(dlv & ~q.between(1, 4)),
            "quarters": F.bit_or(F.when(dlv, F.pow(F.lit(2), q).cast("int")))}


def fact_sales_measures() -> dict[str, Column]:
    """V6 from fact_sales alone."""
    return {"rows_fact_sales": F.count(F.lit(1)),
            "sold": F.coalesce(F.sum(F.when(_is_delivered(), F.col("item_revenue"))), F.lit(0))}


def _order_rows(L: Layers) -> DataFrame:
    """One row per fact, with ``nth`` of its order, and per order_id without
    one: the fact's own numbers beside those that the other tables add up to
    by order_id.  Only fixed-width numbers are added up, so the aggregate is a
    hash table with one narrow entry an order; the facts join it as they are.
    A NULL order_id meets no other."""
    s, c = L.star, L.clean
    dlv, q = _is_delivered(), F.quarter("order_purchase_timestamp")
    facts = s["fact_orders"].select(
        "order_id", "customer_id", F.row_number().over(Window.partitionBy("order_id").orderBy("order_id")).alias("nth"),
        F.col("payment_total").alias("_total"), dlv.alias("_d"),
        F.when(dlv, F.col("order_revenue")).alias("_rev"), F.when(dlv, F.col("delivery_seconds")).alias("_sec"),
        (dlv & F.coalesce(F.col("is_delayed") == 1, F.lit(False))).alias("_late"),
        F.when(dlv, F.pow(F.lit(2), q).cast("int")).alias("_q"), (dlv & ~q.between(1, 4)).alias("_badq"))
    sales = (s["fact_sales"].groupBy("order_id", "order_item_id")
             .agg(F.count(F.lit(1)).alias("n_fs"), F.sum(F.when(_is_delivered(), F.col("item_revenue"))).alias("_sold"))
             .select("order_id", "n_fs", F.lit(1).alias("n_pair"), "_sold"))
    parts = [sales, c["orders"].select("order_id", F.lit(1).alias("n_o")), c["order_items"].select("order_id", F.lit(1).alias("n_i")),
             c["order_payments"].select("order_id", F.lit(1).alias("n_p"), F.col("payment_value").alias("_paid")),
             c["order_reviews"].select("order_id", F.lit(1).alias("n_r"))]
    sums = (reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).groupBy("order_id")
            .agg(*[F.sum(n).alias(n) for n in ("n_fs", "n_pair", "n_o", "n_i", "n_p", "n_r", "_sold", "_paid")]))
    rows = facts.join(sums, "order_id", "full_outer")
    return rows.select(F.col("order_id").isNotNull().alias("known"), *rows.columns[1:])


def _order_totals() -> dict[str, Column]:
    """What adds up over ``_order_rows``; an order's sums count on one of its rows."""
    known, here = F.col("known"), F.coalesce("nth", F.lit(1)) == 1
    has_order = F.coalesce(F.col("n_o") > 0, F.lit(False))

    def once(value: str, holds: Column | None = None) -> Column:
        return F.sum(F.when(here if holds is None else here & holds, F.col(value)))

    off = F.abs(F.coalesce("_sold", F.lit(0)) - F.col("_rev")) > 0.01
    alone = ~known | ~has_order
    sums = {"rows_orders": once("n_o"), "keys_orders": F.count_if(here & known & has_order), "rows_fact_orders": F.count("nth"),
            "keys_fact_orders": F.count_if(known & (F.col("nth") == 1)), "rows_fact_sales": once("n_fs"), "keys_fact_sales": once("n_pair"),
            "items_orders": once("n_i", alone), "payments_orders": once("n_p", alone), "reviews_orders": once("n_r", alone),
            "sales_facts": F.sum(F.when(F.col("nth").isNull(), F.col("n_fs"))), "paid": F.sum(F.when(known & (F.col("nth") == 1), F.col("_paid"))),
            "payment_total": F.sum("_total"), "mismatched": F.count_if(F.col("_d") & off), "sold": once("_sold"),
            "delivered": F.count_if("_d"), "revenue": F.sum("_rev"), "seconds": F.sum("_sec"), "seconds_n": F.count("_sec"),
            "late": F.count_if("_late"), "bad_quarters": F.count_if("_badq")}
    return {**{name: F.coalesce(total, F.lit(0)) for name, total in sums.items()}, "quarters": F.bit_or("_q")}


def mismatched_orders(L: Layers) -> DataFrame:
    """V7 alone, as one row: delivered orders whose items do not add up to
    their revenue.  Over a bucketed warehouse the aggregate and the join start
    from the files, without an exchange on order_id."""
    sold = (L.star["fact_sales"].where(F.col("order_status") == "delivered").groupBy("order_id").agg(F.sum("item_revenue").alias("_sold")))
    off = F.abs(F.coalesce("_sold", F.lit(0)) - F.col("order_revenue")) > 0.01
    return (L.star["fact_orders"].where(F.col("order_status") == "delivered").select("order_id", "order_revenue")
            .join(sold, "order_id", "left").agg(F.count_if(off).alias("mismatched")))


def warehouse_numbers(L: Layers, observed: dict | None = None) -> DataFrame:
    """All numbers of V4-V9 as one row: sums over the orders, and a ladder of
    the few numbers that customers need, by customer_id together with the
    customers, then by person, then in total.  Where the facts are computed and
    not stored, they and the checks share the items, and both sums share the
    orders' rows; where they are stored, V7 is joined in place."""
    if not L.stored:
        L = L.with_clean(order_items=reused(L.clean["order_items"].select("order_id", "order_item_id", "price", "freight_value")))
    c, s = L.clean, L.star
    orders = _order_rows(L) if L.stored else reused(_order_rows(L))
    totals = orders.agg(*[total.alias(name) for name, total in _order_totals().items()])
    facts = s["fact_orders"].withColumn("_d", _is_delivered()) if L.stored else orders.where(F.col("nth").isNotNull())
    parts = [facts.select("customer_id", F.lit(1).alias("n_fo"), F.col("_d").cast("int").alias("n_d")),
             c["customers"].select("customer_id", F.lit(1).alias("n_c")),
             s["dim_customer"].select("customer_id", F.lit(1).alias("n_dim"), F.col("customer_unique_id").alias("person"))]
    by_customer = (reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).groupBy("customer_id")
                   .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_fo", "n_d", "n_c", "n_dim")], F.max("person").alias("person")))
    known = F.col("customer_id").isNotNull()
    more = ["rows_customers", "keys_customers", "facts_customers"]
    by_person = (by_customer.select(
        "person", "n_d", F.col("n_c").alias("rows_customers"), (known & (F.col("n_c") > 0)).cast("long").alias("keys_customers"),
        F.when(~known | (F.col("n_dim") == 0), F.col("n_fo")).alias("facts_customers"), (known & (F.col("n_dim") > 0)).alias("has_dim"))
        .groupBy("has_dim", "person").agg(*[F.sum(n).alias(n) for n in ["n_d", *more]]))
    buyer = F.col("has_dim") & (F.col("n_d") > 0)
    one = totals.crossJoin(F.broadcast(by_person.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in more],
        F.count_if(buyer).alias("persons"), F.count_if(buyer & (F.col("n_d") > 1)).alias("repeaters"))))
    for t, key in (("products", "product_id"), ("sellers", "seller_id")):
        one = one.crossJoin(F.broadcast(c[t].agg(F.count(F.lit(1)).alias(f"rows_{t}"), F.count_distinct(key).alias(f"keys_{t}"))))
    if L.stored:
        one = one.drop("mismatched").crossJoin(F.broadcast(mismatched_orders(L)))
    return _known(one, observed)


def warehouse_check_rows(one: DataFrame) -> DataFrame:
    """V4-V9 from their numbers."""
    one = one.withColumns({
        "days": F.col("seconds") / (F.nullif(F.col("seconds_n"), F.lit(0)) * 86400.0), "rate": pct("repeaters", "persons"),
        "aov": F.col("revenue").cast("double") / F.nullif(F.col("delivered"), F.lit(0)),
        "revenue_off": F.abs(F.col("revenue") - F.col("sold")), "nq": F.coalesce(F.bit_count("quarters"), F.lit(0))})

    def unique(table: str, name: str) -> Column:
        return _check(name, F.col(f"rows_{table}") == F.col(f"keys_{table}"), F.format_string("Rows: %s", _n(f"rows_{table}")))

    return _checks(one, [
        unique("customers", V49_CHECKS[0]), unique("orders", V49_CHECKS[1]),
        unique("products", V49_CHECKS[2]), unique("sellers", V49_CHECKS[3]),
        unique("fact_orders", V49_CHECKS[4]), unique("fact_sales", V49_CHECKS[5]),
        *[_none(n, name, "Orphan rows: %s") for n, name in (
            ("items_orders", V49_CHECKS[6]), ("payments_orders", V49_CHECKS[7]),
            ("reviews_orders", V49_CHECKS[8]), ("sales_facts", V49_CHECKS[9]),
            ("facts_customers", V49_CHECKS[10]))],
        # V6: delivered revenue at order grain equals revenue at item grain
        _check(V49_CHECKS[11], F.col("revenue_off") < 0.01,
               F.format_string("fact_orders=R$%s, fact_sales=R$%s, diff=R$%s", _m("revenue"), _m("sold"), _m("revenue_off"))),
        # V7: per delivered order, item revenue vs order revenue (tolerance 0.01)
        _none("mismatched", V49_CHECKS[12], "Mismatched delivered orders: %s"),
        # V8: payment totals equal the payment rows (no duplication by joins)
        _check(V49_CHECKS[13], F.abs(F.col("payment_total") - F.col("paid")) < 0.01,
               F.format_string("fact_orders=R$%s, order_payments=R$%s", _m("payment_total"), _m("paid"))),
        # V9: sanity ranges
        _check(V49_CHECKS[14], F.col("persons") > 0, F.format_string("Customers: %s", _n("persons"))),
        _check(V49_CHECKS[15], F.coalesce((F.col("rate") >= 0) & (F.col("rate") <= 100), F.lit(False)),
               F.format_string("Repeat rate: %.2f%%", rnd(F.coalesce(F.col("rate"), F.lit(0.0))))),
        _check(V49_CHECKS[16], F.col("delivered") > 0, F.format_string("Delivered orders: %s", _n("delivered"))),
        _check(V49_CHECKS[17], F.coalesce(F.col("days") >= 0, F.lit(False)),
               F.format_string("Average delivery: %.2f days", rnd(F.coalesce(F.col("days"), F.lit(0.0))))),
        _check(V49_CHECKS[18], (F.col("late") >= 0) & (F.col("late") <= F.col("delivered")),
               F.format_string("Delayed: %s", _n("late"))),
        _check(V49_CHECKS[19], F.col("bad_quarters") == 0, F.format_string("Distinct quarters: %d", "nq")),
        _check(V49_CHECKS[20], F.col("delivered") > 0, _n("delivered")),
        _check(V49_CHECKS[21], F.col("revenue") > 0, F.format_string("R$ %s", _m("revenue"))),
        _check(V49_CHECKS[22], F.coalesce(F.col("aov") > 0, F.lit(False)),
               F.format_string("R$ %s", _m(rnd(F.coalesce(F.col("aov"), F.lit(0.0))))))])


def v04_v09_warehouse_checks(L: Layers) -> DataFrame:
    """V4 uniqueness, V5 orphans, V6 reconciliation, V7 per-order mismatch,
    V8 payment totals, V9 sanity ranges."""
    return warehouse_check_rows(warehouse_numbers(L))


def written_checks(L: Layers, observed: dict[str, dict]) -> DataFrame:
    """The rows of V1 to V9 for a warehouse that was just written, with the job
    that each belongs to: counts, sums and ranges as observed on the written
    rows, the rest from one pass over the keys."""
    seen = {f"rows_{t}": m["rows"] for t, m in observed.items()} | {k: v for m in observed.values() for k, v in m.items() if k != "rows"}
    v1 = {"rows_reviews": seen["rows_order_reviews"], "rows_oe": seen["rows_orders_enriched"], "rows_ie": seen["rows_order_items_enriched"],
          "rows_items": seen["rows_order_items"], **seen}
    jobs = {"v01_post_clean_validation": v01_post_clean_validation(L, v1),
            "v02_v03_table_checks": v02_v03_table_checks(L, rows={t: m["rows"] for t, m in observed.items()}),
            "v04_v09_warehouse_checks": warehouse_check_rows(warehouse_numbers(L, seen))}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("job"), "*") for name, df in jobs.items()])


WAREHOUSE_TABLES = ["customers", "orders", "order_items", "order_payments", "order_reviews", "products", "sellers",
                    "geolocation", "geolocation_zip", "category_translation", "fact_orders", "fact_sales", "dim_customer",
                    "dim_product", "dim_seller", "dim_date", "dim_geography"]


def _table(L: Layers, name: str) -> DataFrame | None:
    return L.star[name] if name in L.star else L.clean[name] if name in L.clean else None


def v02_v03_table_checks(L: Layers, expected: dict[str, int | None] | None = None, rows: dict[str, int] | None = None) -> DataFrame:
    """V2/V3: for each expected table whether it exists, and whether it has the
    expected number of rows, as (check, status, detail) rows.  ``expected``
    maps table names to row counts; None asks for one row at least.  Without
    it every warehouse table is expected, with rows.  ``rows`` gives counts
    that are known already; such tables are not read."""
    parts = []
    for name, least in (expected or dict.fromkeys(WAREHOUSE_TABLES)).items():
        df = _table(L, name)
        parts.append(local_table(L.spark, [(f"Table exists: {name}", "FAIL" if df is None else "PASS",
                                            "missing" if df is None else "found")],
                                 "check string, status string, detail string"))
        if df is None:
            continue
        n = local_table(L.spark, [(rows[name],)], "n long") if rows and name in rows else df.agg(F.count(F.lit(1)).alias("n"))
        good = F.col("n") > 0 if least is None else F.col("n") == least
        want = "at least 1" if least is None else str(least)
        parts.append(n.select(F.lit(f"Row count: {name}").alias("check"), F.when(good, "PASS").otherwise("FAIL").alias("status"),
                              F.format_string(f"%d rows, expected {want}", F.col("n")).alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def stored_size(df: DataFrame) -> DataFrame:
    """One row: number and bytes of the files behind a stored table, from the
    scan's hidden file metadata (no column is read)."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def v11_table_inventory(L: Layers) -> DataFrame:
    """Every warehouse table with its rows and columns and, where it is
    stored, its bytes (NULL for a table that is only defined)."""
    parts = []
    for t in WAREHOUSE_TABLES:
        df = _table(L, t)
        size = stored_size(df).select("bytes") if L.stored else local_table(L.spark, [(None,)], "bytes long")
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(size)).select(
            F.lit(t).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), "bytes"))
    return reduce(DataFrame.unionByName, parts)


def _digested(df: DataFrame, columns: list[str]) -> DataFrame:
    """128 bits of each row's ``columns``.  NULLs leave a hash as it is, so
    which columns are NULL is hashed too."""
    cols = [F.col(c) for c in columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return df.select(F.xxhash64(F.lit(1), *cols, nulls).alias("h1"), F.xxhash64(F.lit(2), nulls, *cols[::-1]).alias("h2"))


def v14_duplicates(L: Layers) -> DataFrame:
    """Repeated rows of every raw table, and repeated review keys.  Rows
    are compared by digests, so the wide text rows are not moved; all tables
    share one aggregate over (what, digest)."""
    what = {t: (t, L.raw[t].columns) for t in L.raw}
    what |= {"order_reviews.review_id": ("order_reviews", ["review_id"]), "order_reviews.order_id": ("order_reviews", ["order_id"])}
    rows = reduce(DataFrame.unionByName, [_digested(L.raw[t], cols).select(F.lit(name).alias("what"), "h1", "h2") for name, (t, cols) in what.items()])
    per = rows.groupBy("what", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("what").agg(F.sum("n").alias("rows"), (F.sum("n") - F.count(F.lit(1))).alias("repeats"),
                                   F.count_if(F.col("n") > 1).alias("repeated_values"),
                                   F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_involved"))


def v14_outliers(L: Layers, reach: float = 1.5) -> DataFrame:
    """Per numeric column of the raw tables the quartiles, the fences
    ``reach`` quartile distances beyond them and the rows outside.  One
    distributed pass over the counts of distinct values gives all quartiles;
    the fences (one row per column) are joined back to those counts."""
    parts = []
    for t in L.raw:
        cols = [c for c, kind in L.raw[t].dtypes if kind in ("int", "bigint", "double") or kind.startswith("decimal")]
        if cols:
            stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
            parts.append(L.raw[t].selectExpr(f"'{t}' as `table`", f"stack({len(cols)}, {stack}) as (`column`, v)"))
    keys = ["table", "column"]
    values = reduce(DataFrame.unionByName, parts).where(F.col("v").isNotNull())
    q = exact_quantiles(values, "v", [0.25, 0.5, 0.75], keys=keys).select(
        *keys, *[rnd(F.col("_q")[k], 6).alias(n) for k, n in enumerate(("q1", "median", "q3"))])
    fences = q.withColumns({"low_fence": rnd(F.col("q1") - reach * (F.col("q3") - F.col("q1")), 6),
                            "high_fence": rnd(F.col("q3") + reach * (F.col("q3") - F.col("q1")), 6)})
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    v = rnd("v", 6)
    return counts.join(F.broadcast(fences), keys).groupBy(*keys, *fences.columns[2:]).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(v < F.col("low_fence"), F.col("n"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(v > F.col("high_fence"), F.col("n"))), F.lit(0)).alias("above"))


def v14_orders_without_children(L: Layers) -> DataFrame:
    """Orders without items, payments or reviews, by status (raw tables)."""
    raw = L.raw
    children = ["order_items", "order_payments", "order_reviews"]
    o = raw["orders"].select("order_id", F.struct("order_status").alias("is_order"))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True),
                  [o, *[raw[t].select("order_id", F.lit(1 << k).alias("bit")) for k, t in enumerate(children)]])
    # every order row keeps its own status; the children are one mask per key
    per = (rows.groupBy("order_id", "is_order").agg(F.count_if(F.col("is_order").isNotNull()).alias("n"), F.bit_or("bit").alias("bits"))
           .groupBy("order_id").agg(F.collect_list(F.when(F.col("is_order").isNotNull(), F.struct("is_order.order_status", "n"))).alias("orders"),
                                    F.bit_or("bits").alias("bits"))
           .select(F.explode("orders").alias("o"),
                   F.when(F.col("order_id").isNull(), F.lit(0)).otherwise(F.coalesce("bits", F.lit(0))).alias("bits")))
    return per.groupBy(F.col("o.order_status").alias("order_status")).agg(
        F.sum("o.n").alias("orders"),
        *[F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(1 << k) == 0, F.col("o.n"))), F.lit(0)).alias(f"without_{t[6:]}")
          for k, t in enumerate(children)])


def v14_null_counts(L: Layers) -> DataFrame:
    """NULL count per column of every raw table (one aggregate per table)."""
    parts = []
    for t, df in ((t, L.raw[t]) for t in L.raw):
        cols = df.columns
        one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols], F.count(F.lit(1)).alias("__rows"))
        stack = ", ".join(f"'{c}', `{c}`" for c in cols)
        parts.append(one.selectExpr(f"'{t}' as table", f"stack({len(cols)}, {stack}) as (column, nulls)", "__rows as rows"))
    return reduce(DataFrame.unionByName, parts)


QUALITY_JOBS = {"v01_post_clean_validation": v01_post_clean_validation,
                "v04_v09_warehouse_checks": v04_v09_warehouse_checks, "v02_v03_table_checks": v02_v03_table_checks,
                "v11_table_inventory": v11_table_inventory,
                "v14_orders_without_children": v14_orders_without_children, "v14_null_counts": v14_null_counts,
                "v14_duplicates": v14_duplicates, "v14_outliers": v14_outliers}


def v13_engine_smoke(L: Layers) -> DataFrame:
    """Shapes of the RFM table, cohort matrix, scorecard and growth
    series, plus the peak month and the repeat rate, as one row."""
    from souklens.plans import cohort, growth, rfm, sellers

    r = rfm.compute_rfm(L, []).agg(F.count(F.lit(1)).alias("rfm_rows"))
    c = cohort.cohort_long(L).agg(F.count_distinct("cohort_ym").alias("cohorts"),
                                  (F.max("period_number") + 1).alias("periods"))
    s = sellers.seller_scorecard(L, []).agg(F.count(F.lit(1)).alias("scorecard_rows"))
    # a row per month, computed once for both readings
    m = reused(growth.monthly_growth(L)).agg(F.count(F.lit(1)).alias("growth_months"))
    g = growth.w13_growth_headline(L).select(F.col("peak_month"))
    h = cohort.h6_h7_repeat_summary(L).select(F.col("repeat_rate_pct"))
    return r.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(s)).crossJoin(F.broadcast(m)).crossJoin(F.broadcast(g)).crossJoin(F.broadcast(h))


QUALITY_JOBS["v13_engine_smoke"] = v13_engine_smoke


def v12_spot_checks(L: Layers) -> DataFrame:
    """Spot metrics as (check, value) rows: totals, duplicates on the
    enriched tables and the double-count difference."""
    e, c = L.enriched, L.clean
    oe, ie = e["orders_enriched"], e["order_items_enriched"]
    dlv = F.col("order_status") == "delivered"
    o = oe.agg(F.count(F.lit(1)).alias("total_orders"), F.count_if(dlv).alias("delivered_orders"),
               F.sum("total_order_revenue").alias("_oe_rev"),
               rnd(F.sum(F.when(dlv, F.col("total_order_revenue"))).cast("double") /
                   F.count(F.when(dlv, F.col("total_order_revenue")))).alias("avg_order_value"),
               rnd(F.sum("delivery_seconds") / (F.count("delivery_seconds") * 86400.0)).alias("avg_delivery_days"),
               rnd(pct(F.count_if(F.col("is_delayed") == 1), F.count("is_delayed"))).alias("late_rate_pct"),
               (F.count(F.lit(1)) - F.count_distinct("order_id")).alias("dup_orders_enriched"))
    i = ie.agg(F.sum("item_revenue").alias("_it_rev"), F.sum(F.when(dlv, F.col("item_revenue"))).alias("_del_rev"))
    ca = e["customer_analytics"].agg(F.count_distinct("customer_unique_id").alias("unique_customers"),
                                     F.count_if("is_repeat_buyer").alias("repeat_buyers"),
                                     rnd(pct(F.count_if("is_repeat_buyer"), F.count(F.lit(1)))).alias("repeat_pct"),
                                     (F.count(F.lit(1)) - F.count_distinct("customer_unique_id")).alias("dup_customer_analytics"))
    pa = e["product_analytics"].agg((F.count(F.lit(1)) - F.count_distinct("product_id")).alias("dup_product_analytics"))
    sa = e["seller_analytics"].agg((F.count(F.lit(1)) - F.count_distinct("seller_id")).alias("dup_seller_analytics"))
    rv = c["order_reviews"].agg(rnd(F.avg("review_score"), 4).alias("avg_review_score"),
                                (F.count(F.lit(1)) - F.count_distinct("order_id")).alias("dup_order_reviews"))
    one = o.crossJoin(F.broadcast(i)).crossJoin(F.broadcast(ca)).crossJoin(F.broadcast(pa)).crossJoin(F.broadcast(sa)).crossJoin(F.broadcast(rv)).select(
        "*", money("_it_rev").alias("total_revenue_all_items"), money("_del_rev").alias("revenue_delivered"),
        money(F.abs(F.coalesce(F.col("_oe_rev"), F.lit(0)) - F.coalesce(F.col("_it_rev"), F.lit(0)))).alias("double_count_diff"))
    names = ["total_orders", "delivered_orders", "unique_customers", "repeat_buyers", "repeat_pct", "total_revenue_all_items",
             "revenue_delivered", "avg_order_value", "avg_review_score", "avg_delivery_days", "late_rate_pct",
             "dup_orders_enriched", "dup_customer_analytics", "dup_product_analytics", "dup_seller_analytics",
             "dup_order_reviews", "double_count_diff"]
    stack = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    return one.selectExpr(f"stack({len(names)}, {stack}) as (check, value)")


QUALITY_JOBS["v12_spot_checks"] = v12_spot_checks


def v12_spot_lists(L: Layers, top: int = 5) -> DataFrame:
    """The payment mix, the top categories and states by delivered
    revenue, the purchase span, delivery extremes and gaps of the enriched
    tables, as (list, key, value, share) rows; times as epoch seconds."""
    s = summary_of(L)
    w = Window.partitionBy("dim").orderBy(F.desc("_v"), "key")
    tops = (s.where(F.col("dim").isin("category", "customer_state") & F.col("key").isNotNull())
            .withColumn("_v", F.when(F.col("dim") == "category", F.col("revenue")).otherwise(F.coalesce("order_value_sum", F.lit(0))))
            .withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
            .select(F.concat(F.lit("top "), F.when(F.col("dim") == "category", "categories").otherwise("states")).alias("list"), "key",
                    money("_v").alias("value"), F.lit(None).cast("double").alias("share")))
    pay = L.clean["order_payments"].where(F.col("payment_type").isNotNull()).groupBy("payment_type").agg(F.count(F.lit(1)).alias("n"))
    mix = pay.crossJoin(F.broadcast(pay.agg(F.sum("n").alias("_t")))).select(
        F.lit("payment mix").alias("list"), F.col("payment_type").alias("key"), F.col("n").cast("double").alias("value"), rnd(pct("n", "_t"), 1).alias("share"))
    oe, ie = L.enriched["orders_enriched"], L.enriched["order_items_enriched"]
    seconds = F.unix_timestamp(F.col("order_purchase_timestamp").cast("timestamp"))
    one = oe.agg(F.min(seconds).alias("first purchase"), F.max(seconds).alias("last purchase"),
                 rnd(F.min("delivery_days")).alias("least delivery days"), rnd(F.max("delivery_days")).alias("most delivery days"),
                 F.count_if(F.col("delivery_days") < 0).alias("negative delivery days"),
                 F.count_if(F.col("total_order_revenue").isNull()).alias("orders without revenue")).crossJoin(F.broadcast(
        ie.agg(F.count_if(F.col("product_category_name_english").isNull()).alias("items without category"),
               F.count_if(F.col("product_category_name_english") == UNCATEGORISED).alias("items uncategorised"))))
    stack = ", ".join(f"'{n}', cast(`{n}` as double)" for n in one.columns)
    rest = one.selectExpr("'enriched tables' as list", f"stack({len(one.columns)}, {stack}) as (key, value)", "cast(null as double) as share")
    return tops.unionByName(mix).unionByName(rest)


QUALITY_JOBS["v12_spot_lists"] = v12_spot_lists
