"""Session defaults: UTC, adaptive execution, ANSI left at Spark's default."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Masters whose executor is the driver itself.
LOCAL = re.compile(r"local(\[|$)")


def get_spark(app: str = "gridcast", cpus: int | None = None) -> SparkSession:
    """The running session, or a local one with the settings the engine is tested under."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # spark-submit has set master, memory and partitions already
        cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g")
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark context, so they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_gridcast_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="gridcast-"), "gridcast.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    context.addPyFile(path)
    context._gridcast_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a temporary one if driver and executors are one process (master local), else ValueError.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_gridcast_shared", None)
    if not found:
        if not LOCAL.match(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._gridcast_shared = f"file://{tempfile.mkdtemp(prefix='gridcast-shared-')}"
    return found.rstrip("/")
