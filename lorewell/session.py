"""Session settings the jobs are tuned for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Rule expressions have hundreds of nodes; do not record a stack trace for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, wherever it was imported from."""
    context = spark.sparkContext
    if getattr(context, "_lorewell_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lorewell-package-")) / "lorewell.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted([*root.rglob("*.py"), *root.rglob("*.json")]):
            target.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._lorewell_shipped = True


def build_session(app: str = "lorewell", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above. ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = master[6:-1] if master.startswith("local[") else "1"
            cores = str(os.cpu_count() or 1) if cores == "*" else cores
            builder = builder.config("spark.sql.shuffle.partitions", cores)
            builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            builder = builder.config("spark.driver.memory", os.environ.get("LOREWELL_DRIVER_MEMORY", "8g"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
