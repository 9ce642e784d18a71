"""Aggregates: pages, runs, images, batches, exports, the site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean(c: str) -> Column:
    return F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))


def page_text(regions: DataFrame) -> DataFrame:
    """(image_id, raw_text, overall_confidence): texts in order, one a line, and their mean confidence."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("region_idx", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return regions.groupBy("image_id").agg(F.array_join(texts, "\n").alias("raw_text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("overall_confidence"))


def export_summary(records: DataFrame) -> DataFrame:
    """One row: total, needing review, mean confidence, the four levels, duplicates."""
    level = lambda n: F.count_if(F.col("confidence_level") == n).alias(n.lower())
    return records.agg(
        F.count("*").alias("total_records"),
        F.count_if("needs_review").alias("records_needing_review"),
        _mean("overall_confidence").alias("average_confidence"),
        *(level(n) for n in ("HIGH", "MEDIUM", "LOW", "CRITICAL")),
        F.count_if("is_duplicate").alias("duplicates_found"),
    )


def run_stats(records: DataFrame) -> DataFrame:
    """Per run: records, those that need review, duplicates, mean confidence."""
    return records.groupBy("run_id").agg(F.count("*").alias("total_records"), F.count_if("needs_review").alias("records_requiring_review"), F.count_if("is_duplicate").alias("duplicates"), _mean("overall_confidence").alias("average_confidence"))


def image_results(records: DataFrame, image_col: str = "image_id") -> DataFrame:
    """Per image: records, those of high confidence, those to review (flagged or edited by hand)."""
    edited = F.coalesce(F.col("review_status") == "edited", F.lit(False)) if "review_status" in records.columns else F.lit(False)
    return records.groupBy(image_col).agg(F.count("*").alias("record_count"), F.count_if(F.col("overall_confidence") >= 0.85).alias("high_confidence"), F.count_if(F.coalesce("needs_review", F.lit(False)) | edited).alias("needs_review"))


def batch_totals(records: DataFrame, image_col: str = "image_id") -> DataFrame:
    """One row over all images."""
    sums = ("record_count", "high_confidence", "needs_review")
    return image_results(records, image_col).agg(F.count("*").alias("images"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))


def accuracy_report(records: DataFrame) -> DataFrame:
    """Records accepted, for review and duplicate, with their percentages."""
    review, duplicate = F.coalesce("needs_review", F.lit(False)), F.coalesce("is_duplicate", F.lit(False))
    counted = records.agg(F.count("*").alias("total"), F.count_if(~review & ~duplicate).alias("accepted"), F.count_if(review & ~duplicate).alias("review"), F.count_if(duplicate).alias("duplicates"))
    percent = lambda c: F.when(F.col("total") > 0, F.col(c) * 100.0 / F.col("total")).otherwise(0.0).alias(f"{c}_percent")
    return counted.select("*", *(percent(c) for c in ("accepted", "review", "duplicates")))


def site_stats(documents: DataFrame, records: DataFrame) -> DataFrame:
    """One row: documents, records, mean confidence."""
    return documents.agg(F.count("*").alias("total_documents")).join(records.agg(F.count("*").alias("total_records"), _mean("overall_confidence").alias("average_confidence")))


def group_by_field(records: DataFrame, field: str) -> DataFrame:
    """(group_value, count); records without the column are of the group unknown."""
    value = F.col(field).cast("string") if field in records.columns else F.lit("unknown")
    return records.groupBy(F.coalesce(value, F.lit("unknown")).alias("group_value")).agg(F.count("*").alias("count"))


def group_members(records: DataFrame, field: str, id_col: str = "record_id") -> DataFrame:
    """(group_value, members in order); gathers each group, so only for fields whose groups are known to be small."""
    value = F.col(field).cast("string") if field in records.columns else F.lit("unknown")
    return records.groupBy(F.coalesce(value, F.lit("unknown")).alias("group_value")).agg(F.sort_array(F.collect_list(id_col)).alias("members"))
