"""Spark session for local runs and tests; on a cluster pass your own session around."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "voltlake", **conf: str) -> SparkSession:
    """Local session with a UTC clock and adaptive execution; ANSI mode stays on."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        # Checkpoint files go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Python call sites on every column cost more than planning does.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return with_local_folder(spark)



SHARED = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share; only the session names it."""
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"set {SHARED} to a folder that driver and executors share")
    return folder.rstrip("/")


def with_local_folder(spark: SparkSession) -> SparkSession:
    """For runs in one process whose session names no shared folder: a temporary one that goes when Python ends."""
    context = spark.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if local and not spark.conf.get(SHARED, None) and not context.getCheckpointDir():
        folder = tempfile.mkdtemp(prefix="voltlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return spark
