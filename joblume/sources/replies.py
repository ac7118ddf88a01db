"""Landed replies of the extraction service: ``(batch_id, response)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_replies(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Replies from parquet, or from text files with one ``batch_id<TAB>reply`` a line."""
    if format == "parquet":
        return spark.read.parquet(path).select("batch_id", "response")
    parts = F.split("value", "\t", 2)
    return (spark.read.text(path)
            .select(parts[0].try_cast("long").alias("batch_id"), F.try_element_at(parts, F.lit(2)).alias("response"))
            .where(F.col("batch_id").isNotNull()))
