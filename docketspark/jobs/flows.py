"""The three jobs: extract records from text boxes, de-duplicate and order a batch, browse and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as S
from ..functions import dates as T
from ..functions import text as C
from ..functions import validation as V
from ..operators import dedupe, layout, merge, order, query, summary


def clean_fields(raw: DataFrame) -> DataFrame:
    """raw records with case_number, hearing_date, party_name, advocate; what can't be corrected stays as its stripped text."""
    return raw.withColumns(
        {
            "case_number": F.coalesce(C.correct_case_number(F.col("raw_case_number")), C.strip(F.col("raw_case_number")), F.lit("")),
            "hearing_date": F.coalesce(T.correct_date(F.col("raw_hearing_date")), C.strip(F.col("raw_hearing_date")), F.lit("")),
            "party_name": C.clean_party_name(F.col("raw_party_name")),
            "advocate": C.clean_advocate_name(F.col("raw_advocate")),
        }
    )


def field_results(as_of: Column, parsed: Column | None = None) -> dict[str, Column]:
    return {
        "case_number": V.validate_case_number(F.col("case_number"), F.col("case_number_confidence")),
        "hearing_date": V.validate_date(F.col("hearing_date"), F.col("date_confidence"), as_of, parsed),
        "party_name": V.validate_party_name(F.col("party_name"), F.col("party_name_confidence")),
        "advocate": V.validate_advocate(F.col("advocate"), F.col("advocate_confidence")),
    }


def _staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns worked out in a step of their own.

    The step is a generator of one row: the optimizer neither merges it with others nor repeats its expressions in a filter on them, so each
    is compiled to methods small enough for the JVM to optimize.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def validate_records(cleaned: DataFrame, as_of: Column) -> DataFrame:
    """cleaned with validation_issues, validation_passed (no issue) and has_issues (a field asks for review)."""
    results = field_results(as_of, F.col("_parsed"))
    named = _staged(cleaned, {"_parsed": T.parse_date(F.col("hearing_date"))})
    for k, v in results.items():
        named = _staged(named, {f"_{k}": v})
    each = [F.col(f"_{k}") for k in results]
    review = each[0]["requires_review"]
    for r in each[1:]:
        review = review | r["requires_review"]
    out = _staged(named, {"validation_issues": V.issues(*each)}).withColumn("has_issues", review)
    return out.withColumn("validation_passed", F.size("validation_issues") == 0).drop("_parsed", *(f"_{k}" for k in results))


def assess_records(validated: DataFrame) -> DataFrame:
    """validated with overall_confidence, confidence_level, low_confidence and needs_review; absent confidences are 0.7, 0.7, 0.7, 0.6."""
    default = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in validated.columns else F.lit(d)
    issues = F.col("validation_issues") if "validation_issues" in validated.columns else F.array().cast("array<string>")
    score = S.record_confidence(default("case_number_confidence", 0.7), default("date_confidence", 0.7), default("party_name_confidence", 0.7), default("advocate_confidence", 0.6), issues)
    flagged = F.coalesce("has_issues", F.lit(False)) if "has_issues" in validated.columns else F.lit(False)
    out = validated.withColumn("_score", score)
    return out.withColumns({"overall_confidence": F.col("_score.overall"), "confidence_level": F.col("_score.level"), "low_confidence": F.col("_score.needs_review"), "needs_review": flagged | F.col("_score.needs_review")}).drop("_score")


def score_records(raw: DataFrame, as_of: Column) -> DataFrame:
    """Cleaned, validated and scored records: one pass over the rows, no exchange."""
    return assess_records(validate_records(clean_fields(raw), as_of))


def finished_records(raw: DataFrame, as_of: Column, id_col: str = "record_id") -> DataFrame:
    return dedupe.mark_duplicates(score_records(raw, as_of), id_col)


def extract(regions: DataFrame, as_of: Column, secondary: DataFrame | None = None) -> DataFrame:
    """Text boxes, of one OCR pass or two, to finished records with image_id and row_idx."""
    boxes = regions if secondary is None else merge.merge_ocr(regions, secondary)
    raw = layout.cells_to_records(layout.rows_from_regions(boxes))
    keyed = raw.withColumn("record_id", F.col("image_id") * 1_000_000 + F.col("row_idx"))
    return finished_records(keyed, as_of)


def run_report(raw: DataFrame, as_of: Column) -> DataFrame:
    """Totals of each run over its finished records."""
    return summary.run_stats(finished_records(raw, as_of))


def ordered_batch(records: DataFrame, mode: str = "review", sort_mode: str = "prefix_number_year") -> DataFrame:
    """Duplicates marked and handled, then sorted by case number."""
    return order.sort_by_mode(dedupe.handle_duplicates(dedupe.mark_duplicates(records), mode), sort_mode)


def browse(records: DataFrame, case_number: str | None = None, level: str | None = None, needs_review: bool | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the list view after its filters."""
    found = query.filter_review(query.filter_level(query.filter_case_number(records, case_number), level), needs_review)
    return order.page(query.list_view(found), limit, offset)
