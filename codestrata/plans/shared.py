"""Intermediate tables in the folder that all executors share, and size checks.

Iterative plans cut their lineage here: a table written once is read back by any
executor, so losing one costs a re-read and not a recomputation of the history.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dir: list[str] = []
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; any other
    master is refused, since a machine-local folder would not outlive its executor.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="codestrata-"))
        atexit.register(_drop, _local_dir[0])
    return "file://" + _local_dir[0]


def _drop(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """(a DataFrame written to the shared folder and read back, its path); it stays until it is dropped."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codestrata/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends here."""
    out, path = written(df, name)
    if _scratch:
        _scratch[-1].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes within are dropped at its end, also after an error.

    What is computed from them must be written with ``written`` before.
    """
    _scratch.append([])
    try:
        yield
    finally:
        drop(spark, *_scratch.pop())


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder; a path that is gone already is no error."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_table(df: DataFrame) -> bool:
    """Whether a DataFrame is a written table as it is, read back with no further work than a projection."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.children().isEmpty() and "Relation" in plan.nodeName() or plan.nodeName() == "Project" and plan.children().head().children().isEmpty() and "Relation" in plan.children().head().nodeName()


def settled(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame whose partitions hold the same rows in the same order whenever they are
    computed again: itself if it is a narrow plan over files, else a written table.

    Rows that come out of a shuffle may change places when a lost executor's work is redone.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df, name) if "Exchange" in plan or "Scan ExistingRDD" in plan else df


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of a DataFrame's size, None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


def slices(df: DataFrame, column: str, bytes_per_slice: int, bytes_per_stored: float = 2.0) -> int:
    """How many slices of about ``bytes_per_slice`` text bytes a column makes.

    Takes the optimizer's size of the stored column where it has one (no job), else
    sums the lengths. ``bytes_per_stored``: text bytes for each stored byte.
    """
    size = plan_bytes(df.select(column))
    if size is None:
        size = df.agg(F.sum(F.octet_length(F.col(column).cast("string"))).alias("b")).first()["b"] or 0
        bytes_per_stored = 1.0
    return max(1, -(-int(size * bytes_per_stored) // bytes_per_slice))


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows are within the limit.

    Beyond it the join is left to shuffle, with AQE's skew handling.
    """
    return F.broadcast(df) if rows <= limit else df
