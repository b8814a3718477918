"""Lets Python workers find this package where they see the driver's file system; elsewhere ship it with --py-files."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Bytes of a batch that a worker gets at once, unless the session says otherwise; bounds its memory for long rows.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def ship(spark: SparkSession) -> SparkSession:
    env = spark.sparkContext.environment
    held = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in held:
        env["PYTHONPATH"] = os.pathsep.join([*held, ROOT])
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    return spark
