"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it; clusters without a shared installation use addPyFile."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, ROOT) if p)
    return spark


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks share."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    settings = {"spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
