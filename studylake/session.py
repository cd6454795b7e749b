"""Session settings for a cluster run; every operator also works on a plain session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "studylake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = master[master.find("[") + 1 : -1] if "[" in master else "8"
        builder = (
            builder.master(master)
            .config("spark.driver.memory", os.environ.get("STUDYLAKE_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
