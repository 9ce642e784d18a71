"""Records as they arrive: the same cleaning and scoring on a stream, duplicates dropped within a delay.

Cleaning, validation and scoring keep no state, so the batch functions run on a stream unchanged. What needs state is
knowing a case number again: Spark keeps the numbers seen within the watermark's delay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..jobs.flows import score_records


def score_stream(raw: DataFrame, as_of: Column, time_col: str = "arrived_at", delay: str = "1 day") -> DataFrame:
    """Scored records of a stream, each non-empty case number once within the delay; empty ones all pass."""
    scored = score_records(raw, as_of)
    key = F.when(F.col("case_number").isin("", "-"), F.concat(F.lit("#"), F.col("record_id").cast("string"))).otherwise(F.col("case_number"))
    return scored.withColumn("_key", key).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def level_counts(scored: DataFrame, time_col: str = "arrived_at", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Records of each confidence level and window of arrival."""
    return scored.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "confidence_level").agg(F.count("*").alias("records"))
