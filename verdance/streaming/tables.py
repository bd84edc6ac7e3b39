"""Streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdance.sources.tables import SCHEMAS
from verdance.streaming.jobs import instant


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table as a file stream; as a pattern its path may be a file or a folder of part files."""
    return spark.readStream.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}[.]parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``at``, the instant used for watermarks."""
    return table_stream(spark, sf_dir, "events").selectExpr("*", f"{instant('ts')} AS at")
