"""Filters and projections of the records table; all of them reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values
LEVELS = ("HIGH", "MEDIUM", "LOW", "CRITICAL")
#: fixed values
LIST_COLUMNS = ("record_id", "case_number", "hearing_date", "party_name", "advocate", "overall_confidence", "confidence_level", "needs_review")
#: fixed values
DETAIL_COLUMNS = (
    "record_id", "case_number", "hearing_date", "party_name", "advocate", "case_number_confidence", "date_confidence", "party_name_confidence", "advocate_confidence",
    "overall_confidence", "confidence_level", "needs_review", "is_duplicate", "validation_passed", "validation_issues", "page_number", "line_number",
)


def filter_case_number(records: DataFrame, text: str | None) -> DataFrame:
    """Case numbers with the text in any case; % and _ in it are wildcards."""
    return records.where(F.col("case_number").ilike(f"%{text}%")) if text else records


def filter_level(records: DataFrame, level: str | None) -> DataFrame:
    if not level:
        return records
    if level not in LEVELS:
        raise ValueError(f"Invalid confidence level: {level}")
    return records.where(F.col("confidence_level") == level)


def filter_review(records: DataFrame, needs_review: bool | None) -> DataFrame:
    return records if needs_review is None else records.where(F.col("needs_review") == F.lit(needs_review))


def export_filter(records: DataFrame, level: str | None = None, needs_review: bool | None = None) -> DataFrame:
    """Exports know the level and, only where it is true, the review flag."""
    return filter_review(filter_level(records, level), True if needs_review else None)


def list_view(records: DataFrame) -> DataFrame:
    return records.select(*(F.round(c, 4).alias(c) if c == "overall_confidence" else c for c in LIST_COLUMNS))


def detail(records: DataFrame, record_id: int) -> DataFrame:
    """All columns of one record; absent ones are null."""
    value = lambda c: F.col(c) if c in records.columns else F.lit(None)
    return records.where(F.col("record_id") == record_id).select(*(F.round(value(c), 4).alias(c) if c.endswith("confidence") else value(c).alias(c) for c in DETAIL_COLUMNS))


def has_minimum() -> Column:
    """Case number and date are both there."""
    return F.coalesce((F.length("case_number") > 0) & (F.length("hearing_date") > 0), F.lit(False))


def review_queue(records: DataFrame) -> DataFrame:
    """(record_id, reason, priority, status) of records to review: critical ones have priority 3, low ones 2, others 1."""
    priority = F.when(F.col("confidence_level") == "CRITICAL", 3).when(F.col("confidence_level") == "LOW", 2).otherwise(1)
    reason = F.coalesce(F.get("validation_issues", F.lit(0)), F.concat(F.lit("confidence "), F.col("confidence_level")))
    return records.where("needs_review").select("record_id", reason.alias("reason"), priority.alias("priority"), F.lit("PENDING").alias("status"))
