"""Making this package importable in Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of rows that go to a Python worker at once, in place of Spark's 64 MB: long texts stay a few at a time.
BATCH_BYTES, _DEFAULT_BATCH = 8 << 20, 64 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Put the folder that holds this package on the workers' PYTHONPATH (a no-op where it is installed there), and bound batches unless the session does so itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(_DEFAULT_BATCH):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark
