"""Confidence arithmetic of fields, records and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

HIGH, MEDIUM, LOW = 0.85, 0.70, 0.50


def _plus(flag: Column, points: float) -> Column:
    return F.when(flag, points).otherwise(0.0)


def record_level(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").when(score >= LOW, "LOW").otherwise("CRITICAL")


def field_level(score: Column) -> Column:
    """Three levels: anything below medium is LOW."""
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def display_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def weighted_confidence(case: Column, date: Column, party: Column, advocate: Column) -> Column:
    return case * 0.40 + date * 0.30 + party * 0.20 + advocate * 0.10


def record_confidence(case: Column, date: Column, party: Column, advocate: Column, issues: Column) -> Column:
    """struct(overall, level, needs_review, and the weighted share of each field).

    Each issue that names an error takes a fifth off, each other one that names a warning a tenth, in their order.
    """
    penalty = lambda a, x: a * F.when(F.contains(F.lower(x), F.lit("error")), 0.8).when(F.contains(F.lower(x), F.lit("warning")), 0.9).otherwise(1.0)
    overall = F.aggregate(F.coalesce(issues, F.array().cast("array<string>")), weighted_confidence(case, date, party, advocate), penalty)
    overall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall))
    shares = ((case * 0.40).alias("case_number"), (date * 0.30).alias("date"), (party * 0.20).alias("party_name"), (advocate * 0.10).alias("advocate"))
    return let(overall, lambda x: F.struct(x.alias("overall"), record_level(x).alias("level"), (x < MEDIUM).alias("needs_review"), *shares))


def field_confidence(raw: Column, format_valid: Column, pattern_match: Column, consistency: Column) -> Column:
    return F.least(raw * 0.5 + _plus(format_valid, 0.2) + _plus(pattern_match, 0.15) + consistency * 0.15, F.lit(1.0))


def case_number_confidence(ocr: Column, valid_format: Column, normalized: Column, secondary_match: Column) -> Column:
    return F.least(ocr * 0.4 + _plus(valid_format, 0.35) + _plus(normalized, 0.15) + _plus(secondary_match, 0.1), F.lit(1.0))


def date_confidence(ocr: Column, valid: Column, logical: Column, format_match: Column) -> Column:
    return F.least(ocr * 0.4 + _plus(format_match, 0.25) + _plus(valid, 0.2) + _plus(logical, 0.15), F.lit(1.0))


def text_field_confidence(ocr: Column, length_ok: Column, special: Column) -> Column:
    return F.greatest(F.least(ocr * 0.7 + _plus(length_ok, 0.2) - _plus(special, 0.1), F.lit(1.0)), F.lit(0.0))


def image_quality_score(sharpness: Column, contrast: Column, brightness: Column, noise: Column) -> Column:
    """0 to 100."""
    one = F.lit(1.0)
    parts = F.least(sharpness / 100.0, one) * 0.4 + F.least(contrast / 50.0, one) * 0.3 + F.greatest(one - noise * 2, F.lit(0.0)) * 0.2 + F.least(brightness / 200.0, one) * 0.1
    return parts * 100
