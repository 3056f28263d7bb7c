"""Observations as a stream. Harmonizing is stateless, so the batch function serves both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarn.plans.harmonize import harmonized_values


def harmonized_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """New Parquet files of native rows under ``path`` as harmonized rows."""
    return harmonized_values(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path))


def write_stream(rows: DataFrame, path: str, checkpoint: str):
    """Appends a stream to Parquet; ends when all files that are there have been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
