"""Tables written to the cluster's shared folder, to cut lineage and to keep results that several jobs read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[str] | None] = ContextVar("folders of the scratch that is open", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only a local session without that setting (tests) gets a folder of its
    own; on a cluster a missing setting is an error, since executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks get in bytes and in rows: texts are long, and a batch is held on both
    sides of the pipe.  Settings that the session already has are kept."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later stages neither recompute it nor depend on
    the executors that made it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    def __init__(self) -> None:
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` is needed after the block: the folders that it reads stay."""
        self.kept.append(df)
        return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that ``cut`` writes inside the block leave the shared folder at its end, but for those that the DataFrames
    given to ``keep`` read (they pass to the scratch around this one, if any).  Everything else that is needed later has to
    be written by then."""
    outer, made, own = _MADE.get(), [], Scratch()
    token = _MADE.set(made)
    try:
        yield own
    finally:
        _MADE.reset(token)
    read = {p for df in own.kept for p in _folders(df)}
    for path in made:
        if path.rpartition("/")[2] not in read:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        elif outer is not None:
            outer.append(path)


def _folders(df: DataFrame) -> Iterator[str]:
    """Names of the folders that a DataFrame's plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            roots = leaf.relation().location().rootPaths()
            yield from (roots.apply(k).getName() for k in range(roots.size()))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
