"""Session settings, and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "mastwire") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MASTWIRE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("MASTWIRE_SHARED_FOLDER") or tempfile.mkdtemp(prefix="spark-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so lost executors cannot undo the cut.

    The folder is the one the session names in ``spark.checkpoint.dir``; a session without it is
    refused, except one on this machine alone.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
