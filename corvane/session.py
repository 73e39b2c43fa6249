"""Spark session for local use; on a cluster the submitted session is used as it is."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds this package.
ROOT = str(Path(__file__).resolve().parents[1])
#: Rows and bytes handed to a Python worker at once, at most; one longer row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package wherever the session was started; harmless where it is installed."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), ROOT]))
    return spark


def bounded(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and bytes, and let workers find this package.

    These settings hold for the session from here on, as its queries run later
    than this; lower ones of the caller stay.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def get_session(app: str = "corvane", master: str | None = None) -> SparkSession:
    """UTC, adaptive execution on.  ``master`` is for local runs and tests only."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()
