"""Session defaults and shared-folder helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: settings every job here relies on; a cluster keeps its own sizes
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # call-site capture costs several round trips per column function
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "jobmarket", master: str | None = None, **conf) -> SparkSession:
    """Create or fetch a session carrying :data:`DEFAULTS` plus ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staging tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="jobmarket-")
    context.setCheckpointDir(path)
    return path


def ship(spark: SparkSession) -> None:
    """Send the sources of this library to the executors, once per application; their Python workers import it."""
    context = spark.sparkContext
    if getattr(context, "_jobmarket_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="jobmarket-")) / "jobmarket.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._jobmarket_shipped = True
