"""Joins of OCR passes and of documents, runs and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizing import broadcast_if_small, parts


def merge_ocr(primary: DataFrame, secondary: DataFrame, dealt: bool = False) -> DataFrame:
    """Boxes of two passes over the same images, matched by lower-cased text within an image.

    A primary box keeps its text and polygon and gets the mean confidence with the first matching secondary box;
    secondary boxes without a match follow. source tells primary from secondary rows. Both passes are read once, as one
    table that is dealt by image_id alone, so that layout stages after it need no other exchange. dealt: both passes are already
    dealt by image_id to as many tasks, as the fixture's are; then no box is dealt again (where that does not hold, Spark deals them itself).
    """
    values = [c for c in primary.columns if c in secondary.columns and c not in ("confidence", "engine")]
    # under a name of its own the key carries how it was dealt into the union, also past a filter that rules nulls out
    image = "_image" if dealt else "image_id"
    engine = lambda df, name: F.col("engine") if "engine" in df.columns else F.lit(name)
    side = lambda df, name: df.select(F.col("image_id").alias(image), *(c for c in values if c != "image_id"), "confidence", engine(df, "paddle" if name == "primary" else name).alias("engine"), F.lit(name).alias("source"), F.lower(F.coalesce("text", F.lit(""))).alias("_key"))
    both = side(primary, "primary").unionByName(side(secondary, "secondary"))
    both = both if dealt else both.repartition(parts(both), "image_id")
    same, is_first = Window.partitionBy(image, "_key"), F.col("source") == "primary"
    both = both.withColumn("_other", F.min(F.when(~is_first, F.struct("region_idx", "confidence"))).over(same)).withColumn("_met", F.max(is_first).over(same))
    matched = is_first & F.col("_other").isNotNull() & F.col("_other.confidence").isNotNull()
    confidence = F.when(matched, (F.col("confidence") + F.col("_other.confidence")) / 2.0).otherwise(F.col("confidence"))
    kept = both.where(is_first | ~F.col("_met"))
    return kept.select(*(F.col(image if c == "image_id" else c).alias(c) for c in values), confidence.alias("confidence"), F.when(matched, "paddle+secondary").otherwise(F.col("engine")).alias("engine"), "source")


def page_confidence(merged: DataFrame) -> DataFrame:
    """(image_id, overall_confidence): the mean of the merged boxes."""
    return merged.groupBy("image_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("overall_confidence"))


def records_of_documents(documents: DataFrame, runs: DataFrame, records: DataFrame) -> DataFrame:
    """records with run and document beside them; the smaller tables are broadcast after a check of their rows."""
    meta = runs.join(broadcast_if_small(documents), runs.document_id == documents.doc_id).select("run_id", "doc_id", "filename")
    return records.join(broadcast_if_small(meta), "run_id")
