"""Case numbers, party and advocate names, multi-line fields.

White space and word borders are Unicode throughout, as in the OCR engines' own texts: patterns carry (?U).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the case number prefixes that count as known
KNOWN_PREFIXES = ("CRLA", "CRL", "CRLM", "CRL.M.P", "CRL.A", "SC", "WP", "WMP", "OS", "AS", "SA", "MFA", "IA", "RFA")
CASE_PATTERN = r"^([A-Z]+\.?[A-Z]?\.?[A-Z]?)/([0-9]+)/([0-9]{4})$"
#: letter and digit that OCR takes for each other, as replaced over a whole text
CASE_SWAPS = (("O", "0"), ("0", "O"), ("I", "1"), ("1", "I"), ("S", "5"), ("5", "S"))
ABBREVIATIONS = ("ADPP", "APP", "ASP", "SP")
#: the characters that are white space in Unicode, as (?U)\s matches them
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends, by a set of characters, which costs less than a pattern."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_spaces(c: Column) -> Column:
    """White space of any kind and length as one space; a plain pattern first tells the many texts that have nothing to collapse."""
    return F.when(c.rlike("[^!-~ ]|  "), F.regexp_replace(c, r"(?U)\s+", " ")).otherwise(c)


def is_empty(c: Column) -> Column:
    """Null, blank or a dash."""
    return F.coalesce(strip(c).isin("", "-"), F.lit(True))


def normalize_case_number(c: Column) -> Column:
    """Upper case, no white space, and / for | and backslash."""
    upper = F.upper(strip(c))
    return F.translate(F.when(upper.rlike("[^!-~]"), F.regexp_replace(upper, r"(?U)\s+", "")).otherwise(upper), "|\\", "//")


def _known(prefix: Column) -> Column:
    return F.replace(prefix, F.lit("."), F.lit("")).isin(*KNOWN_PREFIXES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _without_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def parse_case_number(c: Column) -> Column:
    """struct(raw_text, prefix, number, year, is_valid, normalized, confidence); null where the text has another form.

    is_valid says that the prefix, its dots removed, is a known one; the year's range does not matter.
    """

    def parsed(t: Column) -> Column:
        prefix, number, year = (F.split_part(t, F.lit("/"), F.lit(i)) for i in (1, 2, 3))
        return F.struct(
            strip(c).alias("raw_text"),
            prefix.alias("prefix"),
            number.try_cast("decimal(38,0)").alias("number"),
            year.try_cast("int").alias("year"),
            _known(prefix).alias("is_valid"),
            F.concat_ws("/", prefix, _without_zeros(number), _without_zeros(year)).alias("normalized"),
            F.when(_known(prefix), 0.95).otherwise(0.70).alias("confidence"),
        )

    return let(normalize_case_number(c), lambda t: F.when(t.rlike(CASE_PATTERN), parsed(t)))


def valid_case_number(parsed: Column) -> Column:
    """A known prefix, a number above 0 and a year from 1950 to 2100, of a parsed case number; false for null."""
    return F.coalesce(parsed["is_valid"] & (parsed["number"] > 0) & parsed["year"].between(1950, 2100), F.lit(False))


def _known_case_number(t: Column) -> Column:
    prefix, number, year = (F.split_part(t, F.lit("/"), F.lit(i)) for i in (1, 2, 3))
    return F.when(t.rlike(CASE_PATTERN) & _known(prefix), F.concat_ws("/", prefix, _without_zeros(number), _without_zeros(year)))


def correct_case_number(c: Column) -> Column:
    """The first of the text and its letter-digit swaps that reads as a case number of a known prefix; else null.

    Swaps touch no sign that normalizing does, so the text is normalized once.
    """
    return let(normalize_case_number(c), lambda t: F.coalesce(_known_case_number(t), *(_known_case_number(F.replace(t, F.lit(a), F.lit(b))) for a, b in CASE_SWAPS)))


def join_multiline(lines: Column, join_char: str = " ") -> Column:
    """Non-blank lines, stripped, as one line; several get their white space collapsed, a single one keeps it."""
    kept = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), strip), lambda x: x != "")
    return let(kept, lambda k: F.when(F.size(k) == 0, "").when(F.size(k) == 1, F.get(k, 0)).otherwise(strip(collapse_spaces(F.array_join(k, join_char)))))


def clean_party_name(c: Column) -> Column:
    """White space collapsed, vs in any case as Vs; a dot before a space stays, one before a letter goes."""
    return strip(F.regexp_replace(collapse_spaces(F.coalesce(c, F.lit(""))), r"(?iU)\bvs\.?\b", "Vs"))


def clean_advocate_name(c: Column) -> Column:
    """White space collapsed, the prosecutors' abbreviations in upper case."""
    text = F.coalesce(c, F.lit(""))
    out = collapse_spaces(text)
    for short in ABBREVIATIONS:
        out = F.regexp_replace(out, rf"(?iU)\b{short}\.?\b", short)
    # all abbreviations hold one of these pairs; the patterns' borders of words cost most of the cleaning
    some = F.contains(F.upper(text), F.lit("SP")) | F.contains(F.upper(text), F.lit("PP"))
    return strip(F.when(some, out).otherwise(collapse_spaces(text)))


def normalize_special_chars(c: Column) -> Column:
    """Long dashes as hyphens."""
    return F.translate(F.coalesce(c, F.lit("")), "–—", "--")


def is_dash(c: Column) -> Column:
    return F.coalesce(strip(c).isin("-", "--", "—", "–"), F.lit(False))


def is_valid_text(c: Column, min_length: int = 3, max_length: int = 500, allow_empty: bool = False) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text.isin("", "-", "--"), F.lit(allow_empty)).otherwise(F.length(text).between(min_length, max_length))


def process_multiline(lines: Column, field_type: Column | str) -> Column:
    """Joined lines, a dash for nothing, cleaned by the type of field: party, advocate or text."""
    kind = F.lit(field_type) if isinstance(field_type, str) else field_type
    clean = lambda t: F.when(kind == "party", clean_party_name(t)).when(kind == "advocate", clean_advocate_name(t)).otherwise(normalize_special_chars(t))
    return let(join_multiline(lines), lambda t: F.when(t == "", "-").otherwise(clean(t)))


def process_line(line: Column, field_type: str) -> Column:
    """process_multiline of the lines of a text; the many texts of one line take no list and no lambda."""
    text = strip(F.coalesce(line, F.lit("")))
    clean = {"party": clean_party_name, "advocate": clean_advocate_name}.get(field_type, normalize_special_chars)
    return F.when(F.contains(text, F.lit("\n")), process_multiline(F.split(text, "\n"), field_type)).when(text == "", "-").otherwise(clean(text))


def natural_sort_key(c: Column) -> Column:
    """array<struct<s, n>>: texts in lower case and digit runs as numbers, by turns, beginning with a text."""
    text = F.lower(F.coalesce(c, F.lit("")))
    parts = F.regexp_extract_all(text, F.lit(r"(\D*)(\d*)"), 0)
    digits = lambda x: F.regexp_extract(x, r"(\d+)$", 1)
    key = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\D*)", 1).alias("s"), digits(x).try_cast("decimal(38,0)").alias("n")))
    return F.filter(key, lambda k: (k["s"] != "") | k["n"].isNotNull())


