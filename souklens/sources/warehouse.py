"""The written warehouse, laid out for joins on order_id, and its checks.

Tables at order grain are bucketed and sorted by order_id, so joins and
aggregates on it start from the files without an exchange; facts are also
partitioned by purchase year and the enriched tables by month, so time filters
open only their folders.  Each of them is exchanged once, when it is written.

While a table is written its counts, sums and ranges are observed on the rows
that go to the files, so the checks that need no keys cost no scan.  What is
left (unique keys, orphans, per-order sums) is one pass over the written keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Partition columns of the materialised tables: facts by purchase year, the
# enriched order and item tables by purchase month (time filters prune files).
WAREHOUSE_PARTITIONS = {"fact_orders": ["order_year"], "fact_sales": ["order_year"],
                        "orders_enriched": ["order_year_month"], "order_items_enriched": ["order_year_month"]}
BUCKET_KEY = "order_id"
BUCKETED = ("orders", "order_items", "order_payments", "order_reviews", "fact_orders", "fact_sales", "orders_enriched",
            "order_items_enriched")
CLEAN_OUTPUTS = ("customers", "orders", "order_items", "order_payments", "order_reviews", "products", "sellers",
                 "geolocation", "geolocation_zip", "category_translation")
# Enriched tables that most jobs read and that are worth storing; the
# per-entity ones (E3-E5) are cheap aggregates of these and the cleaned tables.
MATERIALISED_ENRICHED = ("orders_enriched", "order_items_enriched")
PRIMARY_KEYS = {"customers": ["customer_id"], "orders": ["order_id"], "products": ["product_id"], "sellers": ["seller_id"]}
LAYOUT = "_layout"
_LAYOUT_SCHEMA = "name string, layer string, format string, buckets int, partitions array<string>, schema string"


@dataclass
class Warehouse:
    """What was written: the tables, what was observed of each, and the check
    rows (job, check, status, detail) of V1 to V9."""

    tables: list[str] = field(default_factory=list)
    observed: dict[str, dict] = field(default_factory=dict)
    checks: DataFrame | None = None

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)


def database(out_dir: str) -> str:
    """The catalog database that a warehouse folder's tables are registered in."""
    return "souklens_" + hashlib.sha256(out_dir.rstrip("/").encode()).hexdigest()[:12]


def require_keys(tables: dict[str, DataFrame], keys: dict[str, list[str]] = PRIMARY_KEYS) -> None:
    """Fail with the tables whose key repeats or is NULL (strict C1, C4, C8,
    C9): one job over the key counts of all tables."""
    from functools import reduce

    def counted(name: str, df: DataFrame) -> DataFrame:
        missing = F.exists(F.array(*[F.col(k).isNull() for k in keys[name]]), lambda x: x)
        return df.select(F.lit(name).alias("name"), F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys[name])]))
                         .alias("key"), missing.alias("missing"))

    per = reduce(DataFrame.unionByName, [counted(n, df) for n, df in tables.items()]).groupBy("name", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("missing").alias("missing"))
    bad = per.where((F.col("n") > 1) | F.col("missing")).groupBy("name").count().collect()  # one row per table at most
    if bad:
        raise ValueError("; ".join(f"{r['name']}: {r['count']} values of {', '.join(keys[r['name']])} repeat or are missing"
                                   for r in sorted(bad)))


def _measures(name: str) -> dict[str, Column]:
    """What is observed while a table is written."""
    from souklens.plans import quality

    more = {"fact_orders": quality.fact_order_measures, "fact_sales": quality.fact_sales_measures,
            "order_items": quality.item_measures, "orders_enriched": quality.order_enriched_measures}
    return {"rows": F.count(F.lit(1)), **(more[name]() if name in more else {})}


def build_warehouse(layers, out_dir: str, fmt: str = "parquet", strict: bool = False, buckets: int | None = None) -> Warehouse:
    """Write the cleaned source tables, the seven warehouse tables and the
    enriched order/item tables (full replace of each table).  Read them back
    with ``Layers.from_warehouse`` so later jobs start from these tables
    instead of cleaning and joining the raw inputs again.  ``buckets`` is the
    number of order_id buckets (as many as shuffle partitions by default).
    ``strict`` fails before anything is written when a primary key repeats or
    is missing."""
    from souklens.plans import quality
    from souklens.plans.context import Layers

    spark = layers.spark
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    db, done, layout = database(out_dir), Warehouse(), []
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    if strict:
        require_keys({name: layers.clean[name] for name in PRIMARY_KEYS})

    def write(name: str, layer: str, df: DataFrame) -> None:
        by = WAREHOUSE_PARTITIONS.get(name, [])
        seen = Observation(f"{db}_{name}")
        rows = df.repartition(n, BUCKET_KEY) if name in BUCKETED else df
        # observed last, on the rows of the writing tasks: a task that is run again counts once
        w = rows.observe(seen, *[c.alias(k) for k, c in _measures(name).items()]).write.mode("overwrite").format(fmt)
        w = w.option("path", f"{out_dir}/{name}").partitionBy(*by) if by else w.option("path", f"{out_dir}/{name}")
        if name in BUCKETED:
            w = w.bucketBy(n, BUCKET_KEY).sortBy(BUCKET_KEY)
        w.saveAsTable(f"{db}.{name}")
        done.tables.append(name)
        done.observed[name] = seen.get
        layout.append((name, layer, fmt, n if name in BUCKETED else 0, by, df.schema.json()))

    def finished(some: tuple[str, ...] | list[str], layer: str) -> dict[str, DataFrame]:
        return {name: _stored(spark, db, name, getattr(layers, layer)[name]) for name in some}

    for name in CLEAN_OUTPUTS:
        write(name, "clean", layers.clean[name])
    # the rest is built from the cleaned tables just written, so cleaning runs once
    later = layers.with_clean(**finished(CLEAN_OUTPUTS, "clean"))
    for name in later.star:
        write(name, "star", later.star[name])
    for name in MATERIALISED_ENRICHED:
        write(name, "enriched", later.enriched[name])
    spark.createDataFrame(layout, _LAYOUT_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{out_dir}/{LAYOUT}")
    done.checks = quality.written_checks(Layers.from_warehouse(spark, out_dir), done.observed)
    return done


def _stored(spark: SparkSession, db: str, name: str, shape: DataFrame) -> DataFrame:
    """A written table with the columns, their order and types, of the lazily defined one."""
    df = spark.table(f"{db}.{name}")
    return df.select([F.col(f.name) if df.schema[f.name].dataType == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
                      for f in shape.schema.fields])


def open_warehouse(spark: SparkSession, out_dir: str) -> dict[str, dict[str, DataFrame]]:
    """The tables of a written warehouse by layer.  In a session that does not
    know them they are registered from the folder's layout, with their buckets
    and partitions; no data is read."""
    from pyspark.sql.types import StructType
    import json

    db = database(out_dir)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    out: dict[str, dict[str, DataFrame]] = {}
    for r in spark.read.schema(_LAYOUT_SCHEMA).json(f"{out_dir}/{LAYOUT}").collect():  # one row per table
        shape = StructType.fromJson(json.loads(r["schema"]))
        if not spark.catalog.tableExists(f"{db}.{r['name']}"):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)
            by = f" PARTITIONED BY ({', '.join(r['partitions'])})" if r["partitions"] else ""
            into = f" CLUSTERED BY ({BUCKET_KEY}) SORTED BY ({BUCKET_KEY}) INTO {r['buckets']} BUCKETS" if r["buckets"] else ""
            spark.sql(f"CREATE TABLE {db}.{r['name']} ({columns}) USING {r['format']}{by}{into} LOCATION '{out_dir}/{r['name']}'")
            if r["partitions"]:
                spark.sql(f"ALTER TABLE {db}.{r['name']} RECOVER PARTITIONS")
        out.setdefault(r["layer"], {})[r["name"]] = spark.table(f"{db}.{r['name']}").select(*shape.fieldNames())
    return out
