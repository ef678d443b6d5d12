"""What driver and executors share: the package itself, and a folder for tables. How rows and trees are dealt with in tasks."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once a context, unless their PYTHONPATH has it."""
    context = spark.sparkContext
    if str(ROOT.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and not getattr(context, "_codecorpus", False):
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.addPyFile(shutil.make_archive(f"{base}/codecorpus", "zip", ROOT.parent, "codecorpus"))
        context._codecorpus = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a temporary folder, but in local mode alone: on a cluster executors don't share one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or (spark.sparkContext.getCheckpointDir() or "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def dealt(rows: DataFrame, each: int, *columns: str) -> DataFrame:
    """Rows dealt by columns over partitions of about `each` rows, at least one for a core. Their number is counted first, and Spark
    doesn't merge such partitions, so what a task holds of them doesn't grow with the table."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(parts, *columns)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cyclic garbage collector, which would run over and over through a tree that is being made and holds no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
