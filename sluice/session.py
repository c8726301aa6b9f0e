"""Session settings that every plan of this library assumes."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Column names are case sensitive, times are UTC, and the plan is re-optimised from run-time sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", app: str = "sluice") -> SparkSession:
    """A single-machine session, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession | None = None) -> None:
    """Lets Python workers import this package from the driver's path, where they have that path."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    held = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in held:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, held)])
