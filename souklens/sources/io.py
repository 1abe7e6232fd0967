"""Sources and sinks (S1-S11); the warehouse itself is in ``warehouse``.

Scans are typed (no inference); sinks write partitioned files in parallel.
Nothing here funnels data through a single task: CSV/JSON/text exports are
ordinary distributed writes (one file per partition).
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.sources.schema import RAW_SCHEMAS
from souklens.sources.warehouse import (CLEAN_OUTPUTS, MATERIALISED_ENRICHED, PRIMARY_KEYS,  # noqa: F401
                                        WAREHOUSE_PARTITIONS, build_warehouse, require_keys)

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIMESTAMP_COLUMNS = {
    "orders": ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "order_items": ["shipping_limit_date"],
    "order_reviews": ["review_creation_date", "review_answer_timestamp"],
}


def load_table(spark: SparkSession, name: str, base_dir: str, files: Mapping[str, str] | None = None) -> DataFrame:
    """Typed CSV scan of one raw table by logical name (``{name}.csv``
    unless ``files`` maps it); an unknown name raises ValueError."""
    if name not in RAW_SCHEMAS:
        raise ValueError(f"Unknown table: {name}. Known: {sorted(RAW_SCHEMAS)}")
    path = f"{base_dir}/{(files or {}).get(name, name + '.csv')}"
    return (spark.read.schema(RAW_SCHEMAS[name]).option("header", True).option("mode", "PERMISSIVE")
            .option("timestampNTZFormat", TIME_FORMAT).csv(path))


CORRUPT = "_corrupt_record"
REJECTED = "table string, column string, raw string"


def _coerced(column: str, kind: str, time_format: str | None = None) -> Column:
    """A text cell as ``kind``; NULL where it is none."""
    if kind.startswith("timestamp"):
        return F.try_to_timestamp(F.col(column), *([F.lit(time_format)] if time_format else [])).cast("timestamp_ntz")
    return F.expr(f"try_cast(trim(`{column}`) AS {kind})")


def _rejected(df: DataFrame, name: str, kinds: Mapping[str, str], time_format: str | None = None) -> DataFrame:
    """(table, column, raw) for every cell that holds text which is not of its
    column's kind, and for every line that does not have the table's columns."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"), _coerced(c, k, time_format).isNull().alias("lost"))
             for c, k in kinds.items() if k != "string"]
    if CORRUPT in df.columns:
        cells.append(F.struct(F.lit(CORRUPT).alias("column"), F.col(CORRUPT).alias("raw"), F.lit(True).alias("lost")))
    if not cells:
        return df.sparkSession.createDataFrame([], REJECTED)
    return df.select(F.explode(F.array(*cells)).alias("c")).where(F.col("c.raw").isNotNull() & F.col("c.lost")).select(
        F.lit(name).alias("table"), "c.column", "c.raw")


def load_checked(spark: SparkSession, name: str, base_dir: str, files: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 with an account of what coercion loses: the typed table, as
    ``load_table`` gives it, and the rejected cells (table, column, raw).
    Lines with too few or too many cells are listed whole, as column
    ``_corrupt_record``; their readable cells stay in the table."""
    if name not in RAW_SCHEMAS:
        raise ValueError(f"Unknown table: {name}. Known: {sorted(RAW_SCHEMAS)}")
    kinds = {f.name: f.dataType.simpleString() for f in RAW_SCHEMAS[name].fields}
    text = (spark.read.schema(", ".join(f"`{c}` string" for c in [*kinds, CORRUPT])).option("header", True).option("mode", "PERMISSIVE")
            # a line is judged by all of its cells, whichever columns a query needs
            .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
            .csv(f"{base_dir}/{(files or {}).get(name, name + '.csv')}"))
    typed = text.select(*[(F.col(c) if k == "string" else _coerced(c, k, TIME_FORMAT)).alias(c) for c, k in kinds.items()])
    return typed, _rejected(text, name, kinds, TIME_FORMAT)


def load_all_tables(spark: SparkSession, base_dir: str, files: Mapping[str, str] | None = None,
                    register_views: bool = False) -> dict[str, DataFrame]:
    """All nine raw tables (optionally also as temp views)."""
    out = {n: load_table(spark, n, base_dir, files) for n in RAW_SCHEMAS}
    if register_views:
        for n, df in out.items():
            df.createOrReplaceTempView(n)
    return out


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """S3: full replace of one table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def load_processed(spark: SparkSession, path: str, timestamp_cols: list[str] = (), numeric_cols: Mapping[str, str] = {},
                   fmt: str = "csv") -> DataFrame:
    """Re-read a processed table with lenient coercion: unparsable
    timestamps and numbers become NULL instead of failing.
    ``rejected_cells`` lists them."""
    df = _processed(spark, path, fmt)
    casts = {c: _coerced(c, k) for c, k in _kinds(timestamp_cols, numeric_cols).items()}
    return df.withColumns(casts) if casts else df


def rejected_cells(spark: SparkSession, path: str, name: str, timestamp_cols: list[str] = (), numeric_cols: Mapping[str, str] = {},
                   fmt: str = "csv") -> DataFrame:
    """S4's account: (table, column, raw) of the cells that ``load_processed``
    turns to NULL."""
    return _rejected(_processed(spark, path, fmt), name, _kinds(timestamp_cols, numeric_cols))


def _processed(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)


def _kinds(timestamp_cols: list[str], numeric_cols: Mapping[str, str]) -> dict[str, str]:
    return {**dict.fromkeys(timestamp_cols, "timestamp_ntz"), **numeric_cols}


def run_query(spark: SparkSession, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """A parametrised statement (``:name`` markers, e.g. ``LIMIT :limit``)."""
    return spark.sql(text, args=dict(params or {}))


def split_statements(script: str) -> list[str]:
    """Statements of a ';'-separated script, comments and blanks dropped."""
    no_comments = re.sub(r"--[^\n]*", "", script)
    return [s.strip() for s in no_comments.split(";") if s.strip()]


def run_in_full(df: DataFrame) -> int:
    """Run a query with all its columns and return its number of rows.  The
    hash of every row keeps the optimizer from dropping what is only counted."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.hash(F.to_json(F.struct("*")))).alias("h")).first()["n"]


def run_script(spark: SparkSession, script: str) -> DataFrame:
    """Run every statement with all its columns, keep going on errors; one
    status row per statement (index, status, rows, error).  Each statement is
    a distributed job; only its row count returns to the driver."""
    rows = []
    for i, stmt in enumerate(split_statements(script), start=1):
        try:
            df = spark.sql(stmt)
            n = run_in_full(df) if df.columns else 0
            rows.append((i, "ok" if n else "empty", n, None))
        except Exception as e:  # noqa: BLE001 - reported per statement, as the runner's contract
            rows.append((i, "error", None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "statement int, status string, rows long, error string")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header (one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_kpis(layers, out_dir: str) -> list[str]:
    """The five KPI tables (K1-K5) as CSV, one folder each."""
    from souklens.plans.kpi import KPI_JOBS

    names = [n for n in KPI_JOBS if n[:1] == "k" and n[1:2].isdigit()]
    for name in names:
        export_csv(KPI_JOBS[name](layers.star), f"{out_dir}/{name}")
    return names


def metrics_document(layers) -> DataFrame:
    """The exploratory metrics (A1-A25) as one JSON value: an object with
    the rows of each job, in one row.  Each job's rows (all bounded: groups,
    bins, top lists, a sample) are gathered by an aggregate and the one-row
    parts are joined; nothing is collected."""
    from souklens.plans.eda import EDA_JOBS
    from souklens.plans.report import a25_eda_insights

    parts = [job(layers).agg(F.sort_array(F.collect_list(F.struct("*"))).alias(name))
             for name, job in {**EDA_JOBS, "a25_eda_insights": a25_eda_insights}.items()]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))
    return one.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def export_metrics(layers, path: str) -> None:
    """The metrics document as one file of text."""
    metrics_document(layers).coalesce(1).write.mode("overwrite").text(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def export_text(lines: DataFrame, path: str, order_col: str = "seq", text_col: str = "line") -> None:
    """Text report; lines are range-partitioned by their sequence number
    so the files read back in order without a single-task sort."""
    lines.repartitionByRange(order_col).sortWithinPartitions(order_col).select(text_col).write.mode("overwrite").text(path)
