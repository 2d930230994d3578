"""Spark session settings shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskloom") -> SparkSession:
    """Build (or reuse) a session tuned for these jobs.

    * AQE on: runtime coalescing of shuffle partitions, skew-join splitting and the
      size-checked broadcast of join sides that turn out small at run time.
    * ANSI on (Spark default) -- the library uses ``try_*`` functions on purpose.
    * UI off: no server is opened.
    """
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names it; it is only read here (it is a core
    setting and cannot be changed at run time), and without it and without a folder set on
    the context this is an error: no folder of one machine is shared. Only a local master,
    whose driver is its sole executor, gets a scratch folder when none is set."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-ckpt-"))
    return sc.getCheckpointDir()
