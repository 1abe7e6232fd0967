"""V10: "the analytical suite has 18 queries and every one runs".

A query runs in full only if all its columns are computed: a bare row count
lets Catalyst drop them.  ``run_in_full`` therefore counts rows together with
a hash of every output column.  Queries are run one after the other, so a
query that fails, when it is analysed or only when it runs, gives a FAIL row
and the others still run.  What several queries of the suite read is computed
by the first that asks for it and released when the last has ended.  This is
the one check that starts Spark jobs while it is built: its result is whether
they end well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from souklens.functions.reuse import reusing
from souklens.plans.context import Layers
from souklens.plans.sqlsuite import SUITE, shared_tables
from souklens.sources.inline import local_table
from souklens.sources.io import run_in_full, split_statements

EXPECTED_STATEMENTS = 18
WAREHOUSE_VIEWS = ("fact_orders", "fact_sales", "dim_customer", "dim_product", "dim_seller", "dim_date", "dim_geography")


def statements(L: Layers, script: str) -> list[Callable[[], DataFrame]]:
    """The statements of a script of Spark SQL; ``{fact_orders}``-style names
    stand for the warehouse tables."""
    def bound(text: str) -> DataFrame:
        return L.spark.sql(text, **{v: L.star[v] for v in WAREHOUSE_VIEWS if "{" + v + "}" in text})

    return [lambda t=t: bound(t) for t in split_statements(script)]


def v10_script_check(L: Layers, script: str | None = None, expected: int = EXPECTED_STATEMENTS) -> DataFrame:
    """V10 as (check, status, detail) rows: the number of queries, one row per
    query with its result size or its error, and the verdict over all.
    ``script`` is the text of a script; without one the suite Q1-Q18 is run."""
    star = shared_tables(L.star, L.stored)
    queries = [lambda job=job: job(star) for job in SUITE.values()] if script is None else statements(L, script)
    rows = [(f"{expected} analytical SQL queries found", "PASS" if len(queries) == expected else "FAIL",
             f"Queries found: {len(queries)}")]
    errors = []
    with reusing():
        for i, query in enumerate(queries, start=1):
            try:
                rows.append((f"Query {i} executes", "PASS", f"{run_in_full(query())} rows"))
            except Exception as e:  # noqa: BLE001 - any failure of a query is this check's result
                errors.append(f"Query {i}: {e}")
                rows.append((f"Query {i} executes", "FAIL", str(e)))
    rows.append(("All analytical SQL queries execute", "FAIL" if errors else "PASS",
                 " | ".join(errors) or "No SQL execution errors"))
    return local_table(L.spark, rows, "check string, status string, detail string")


SCRIPT_JOBS = {"v10_script_check": v10_script_check}
