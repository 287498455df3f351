"""Session helpers: a tuned local session, and shipping of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, driver_memory: str = "12g", app: str = "codestrata") -> SparkSession:
    """A session on this machine. On a cluster use the cluster's own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", driver_memory).config("spark.driver.host", "127.0.0.1")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers of a session.

    Arrow batches are set to 2,000 rows where neither application nor session names a number: rows here
    hold whole texts, and an executor keeps several batches of each task in memory.

    Nothing is done where PYTHONPATH already leads to it; otherwise the package is
    zipped once per application and distributed by the driver's file server.
    """
    set_here = spark._jsparkSession.sessionState().conf().settings().containsKey(BATCH_ROWS)
    if not set_here and not spark.sparkContext.getConf().contains(BATCH_ROWS):
        spark.conf.set(BATCH_ROWS, "2000")
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.samefile(os.getcwd(), root):
        return spark
    sc = spark.sparkContext
    if getattr(sc, "_codestrata_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp(prefix="codestrata-ship-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted([*PACKAGE.rglob("*.py"), *PACKAGE.rglob("*.txt")]):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._codestrata_shipped = True
    return spark
