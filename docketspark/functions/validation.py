"""Checks of the four record fields.

Each gives struct(field_name, value, status, confidence, messages, requires_review); status is valid, warning, error or
empty. A confidence below 0.70 always asks for review. Messages are put together without lambdas, so that all of it is compiled; give
it columns rather than long expressions, as values are named several times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import is_logical_date, parse_date
from .text import is_empty, let, strip

MIN_CONFIDENCE = 0.70
#: no field has more messages
MOST_MESSAGES = 4
#: fixed values: the forms of the fields and, below, the texts of messages and their limits
CASE_FORMAT = r"(?U)^[A-Z]+\.?[A-Z]?\.?[A-Z]?/\d+/\d{4}$"
DATE_FORMAT = r"(?U)^\d{2}-\d{2}-\d{4}$"
UNUSUAL = r"(?U)[^a-zA-Z0-9\s.,()'\-&]"


def _texts(items: list[tuple[Column, Column]]) -> Column:
    """The texts whose condition holds, in order."""
    none = F.array().cast("array<string>")
    return F.concat(*(F.when(held, F.array(text)).otherwise(none) for held, text in items))


def _result(field: str, value: Column, status: Column, confidence: Column, messages: list[tuple[Column, Column]], review: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field_name"),
        value.alias("value"),
        status.alias("status"),
        confidence.cast("double").alias("confidence"),
        _texts(messages).alias("messages"),
        review.alias("requires_review"),
    )


def _empty(field: str, value: Column, status: str, confidence: float, message: str, review: bool) -> Column:
    return _result(field, value, F.lit(status), F.lit(confidence), [(F.lit(True), F.lit(message))], F.lit(review))


def _low(confidence: Column) -> tuple[Column, tuple[Column, Column]]:
    low = F.coalesce(confidence < MIN_CONFIDENCE, F.lit(False))
    return confidence < MIN_CONFIDENCE, (low, F.format_string("Low OCR confidence: %.2f", confidence))


def validate_case_number(value: Column, confidence: Column) -> Column:
    wrong = ~value.rlike(CASE_FORMAT)
    low, message = _low(confidence)
    status = F.when(wrong, "error").when(low, "warning").otherwise("valid")
    checked = _result("case_number", value, status, confidence, [(wrong, F.concat(F.lit("Case number format invalid: "), value)), message], wrong | low)
    return F.when(is_empty(value), _empty("case_number", value, "empty", 0.0, "Case number is empty", True)).otherwise(checked)


def validate_date(value: Column, confidence: Column, as_of: Column, parsed: Column | None = None) -> Column:
    """A date that is not logical ends as a warning even where its format is an error. parsed is parse_date(value), where a column has it."""
    if parsed is None:
        return let(parse_date(value), lambda found: validate_date(value, confidence, as_of, found))
    wrong = ~value.rlike(DATE_FORMAT)
    invalid = F.coalesce(~parsed["is_valid"], F.lit(False))
    illogical = F.coalesce(parsed["is_valid"] & ~is_logical_date(parsed["date_obj"], as_of), F.lit(False))
    low, message = _low(confidence)
    status = F.when(illogical, "warning").when(wrong | invalid, "error").when(low, "warning").otherwise("valid")
    messages = [
        (wrong, F.concat(F.lit("Date format invalid: "), value, F.lit(" (expected DD-MM-YYYY)"))),
        (invalid, F.concat(F.lit("Date is invalid: "), value)),
        (illogical, F.concat(F.lit("Date is not logical: "), value)),
        message,
    ]
    checked = _result("hearing_date", value, status, confidence, messages, wrong | invalid | illogical | low)
    return F.when(is_empty(value), _empty("hearing_date", value, "empty", 0.0, "Date is empty", True)).otherwise(checked)


def validate_party_name(value: Column, confidence: Column, allow_empty: bool = False) -> Column:
    """Low confidence asks for review but leaves the status."""
    n = F.length(strip(value))
    short, long, unusual = n < 3, n > 500, value.rlike(UNUSUAL)
    low, message = _low(confidence)
    status = F.when(short, "error").when(long | unusual, "warning").otherwise("valid")
    messages = [
        (short, F.format_string("Party name too short: %d chars", n)),
        (long, F.format_string("Party name too long: %d chars", n)),
        (unusual, F.lit("Party name contains unusual characters")),
        message,
    ]
    nothing = _empty("party_name", F.lit("-"), "empty", 1.0, "Party name is empty", False) if allow_empty else _empty("party_name", value, "error", 0.0, "Party name is required but empty", True)
    return F.when(is_empty(value), nothing).otherwise(_result("party_name", value, status, confidence, messages, short | long | unusual | low))


def validate_advocate(value: Column, confidence: Column, allow_empty: bool = True) -> Column:
    n = F.length(strip(value))
    short, long = n < 2, n > 300
    low, message = _low(confidence)
    status = F.when(short | long, "warning").otherwise("valid")
    messages = [(short, F.format_string("Advocate name too short: %d chars", n)), (long, F.format_string("Advocate name too long: %d chars", n)), message]
    nothing = _empty("advocate", F.lit("-"), "empty", 1.0, "Advocate not specified", False) if allow_empty else _empty("advocate", value, "error", 0.0, "Advocate is required but empty", True)
    return F.when(is_empty(value), nothing).otherwise(_result("advocate", value, status, confidence, messages, short | long | low))


def issues(*results: Column) -> Column:
    """Messages of results that are not valid or ask for review, as "status: message"; an accepted empty field gives none."""

    def texts(r: Column) -> list[tuple[Column, Column]]:
        told = ~((r["status"] == "empty") & ~r["requires_review"])
        return [(told & (F.size(r["messages"]) > k), F.concat(r["status"], F.lit(": "), F.get(r["messages"], k))) for k in range(MOST_MESSAGES)]

    return _texts([t for r in results for t in texts(r)])
