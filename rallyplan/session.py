"""SparkSession settings shared by tests, the bench and scripts."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = str(Path(__file__).resolve().parents[1])


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g", name: str = "rallyplan") -> SparkSession:
    """A single-JVM session; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (elsewhere it is shipped with --py-files)."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of this machine only in local mode and where none is set, as in tests."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rallyplan-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, without their lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
