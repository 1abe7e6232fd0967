"""Small fixed tables (lookup maps, labels, title rows) as local relations.

``spark.sql("SELECT ... FROM VALUES ...")`` folds into a ``LocalRelation``:
the rows travel inside the plan, Catalyst knows their exact size (so a join
against one is a broadcast with a proven bound), and no RDD or Python worker
is involved, unlike ``createDataFrame`` from a Python list.  Values are bound
as named parameters, so no literal is ever spliced into SQL text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _fields(ddl: str) -> list[tuple[str, str]]:
    out = []
    for part in ddl.split(","):
        name, typ = part.strip().split(None, 1)
        out.append((name, typ.strip()))
    return out


def local_table(spark: SparkSession, rows: Sequence[Sequence[object]], ddl: str) -> DataFrame:
    """``rows`` (tuples in ``ddl`` column order, e.g. ``"R int, F int,
    segment string"``) as a local relation with exactly that schema."""
    fields = _fields(ddl)
    if not rows:
        return spark.createDataFrame([], ddl)
    args: dict[str, object] = {}
    tuples = []
    for i, row in enumerate(rows):
        if len(row) != len(fields):
            raise ValueError(f"row {i} has {len(row)} values, schema has {len(fields)}")
        marks = []
        for j, v in enumerate(row):
            args[f"v{i}_{j}"] = v
            marks.append(f":v{i}_{j}")
        tuples.append("(" + ", ".join(marks) + ")")
    cols = ", ".join(f"c{j}" for j in range(len(fields)))
    proj = ", ".join(f"CAST(c{j} AS {t}) AS `{n}`" for j, (n, t) in enumerate(fields))
    return spark.sql(f"SELECT {proj} FROM VALUES {', '.join(tuples)} AS t({cols})", args=args)
