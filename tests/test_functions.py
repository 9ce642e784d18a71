"""Golden cases of the column functions."""

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from docketspark import oracle
from docketspark.functions import confidence as S
from docketspark.functions import dates as T
from docketspark.functions import text as C
from docketspark.functions import validation as V
from docketspark.functions.similarity import lcs_length, token_set_ratio_of
from docketspark.operators.order import case_sort_key


#: whole words by Unicode borders: letters beyond ASCII, marks, joiners, circled letters, dots before words and before none
BORDERS = ["vs", "a vs. b", "A vs.vs.x", "évs b", "app.x adpp. asp sp.sp", "App vs sp", "\u017fp x", "x_app app", "x\u2010app\u2010y", "v\u017f. k", "\u24b6vs a", "sp.é", "  vs  vs  vs ", "ASP.ADPP.app", "e\u0301app", "vs.\u00b2", "vs.\u0663 vs", "a\u200dvs vs"]


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_parse_case_number(spark):
    got = values(spark, C.parse_case_number, ["CRLA/72/2024", "crla | 007 | 2024", "CRL.A/1/2024", "CRL.M.P/1/2024", "XYZ/1/2024", "WP/0/2024", "CRLA/72", None, "", "WP\\5\\1901"])
    assert [g and (g.normalized, g.is_valid, g.confidence) for g in got] == [
        ("CRLA/72/2024", True, 0.95), ("CRLA/7/2024", True, 0.95), ("CRL.A/1/2024", True, 0.95), ("CRL.M.P/1/2024", False, 0.70), ("XYZ/1/2024", False, 0.70), ("WP/0/2024", True, 0.95), None, None, None, ("WP/5/1901", True, 0.95)]
    valid = values(spark, lambda c: C.valid_case_number(C.parse_case_number(c)), ["WP/0/2024", "WP/1/2024", "WP/1/1949", None])
    assert valid == [False, True, False, False]


def test_correct_case_number(spark):
    assert values(spark, C.correct_case_number, ["CRLA/7O/2024", "0S/1/2026", "0S/1/1999", " wp/I/2020 ", "nothing", None]) == ["CRLA/70/2024", None, "OS/1/1999", "WP/1/2020", None, None]


def test_lines_and_names(spark):
    lines = [["Dr Rajkumar", " Radhakrishnaan and another Vs Chief", "", "medical officer"], ["a  b"], [], None, ["  "]]
    assert values(spark, C.join_multiline, lines, "array<string>") == ["Dr Rajkumar Radhakrishnaan and another Vs Chief medical officer", "a  b", "", "", ""]
    assert values(spark, C.clean_party_name, ["A vs. B", "A VS.B", " a  b ", None]) == ["A Vs. B", "A VsB", "a b", ""]
    assert values(spark, C.clean_advocate_name, ["x adpp.", "x app. y", "sp", None]) == ["x ADPP.", "x APP. y", "SP", ""]
    assert values(spark, lambda c: C.process_multiline(F.split(c, "\n"), "party"), ["", "A\nvs B"]) == ["-", "A Vs B"]
    assert values(spark, C.is_dash, ["-", " -- ", "—", "a", None]) == [True, True, True, False, False]
    assert values(spark, C.is_valid_text, ["ab", "abc", "--", None]) == [False, True, False, False]
    assert values(spark, C.normalize_special_chars, ["a–b—c", None]) == ["a-b-c", ""]


def test_natural_key(spark):
    df = spark.createDataFrame([("Case 123",), ("Case 45",), ("case 5b",), ("12x",), ("",)], "v string")
    assert [r[0] for r in df.orderBy(C.natural_sort_key(F.col("v"))).collect()] == ["", "12x", "case 5b", "Case 45", "Case 123"]


def test_dates(spark):
    got = values(spark, T.parse_date, ["16-09-2026", "16092026", "1192026", "31-02-2026", "12026", "16 09 2026", None, "29.02.2024"])
    assert [g and (g.formatted, g.is_valid, g.date_obj) for g in got] == [
        ("16-09-2026", True, date(2026, 9, 16)), ("16-09-2026", True, date(2026, 9, 16)), ("11-09-2026", True, date(2026, 9, 11)), ("31-02-2026", False, None), None, None, None, ("29-02-2024", True, date(2024, 2, 29))]
    assert values(spark, T.correct_date, ["16-O9-2O26", "I6-09-2026", "l6-09-2026", "1/2/2020", None]) == ["16-09-2026", "16-09-2026", None, "01-02-2020", None]
    assert [tuple(k) for k in values(spark, T.date_sort_key, ["05-03-2020", "-", None, "5-3", "a-b-c", "1-2-3-4"])] == [(2020, 3, 5), (9999, 99, 99), (9999, 99, 99), (9999, 99, 99), (9999, 99, 99), (3, 2, 1)]


def test_case_order(spark):
    df = spark.createDataFrame([("SC/82/2025",), ("CRLA/72/2024",), ("CRLA/12/2026",), ("CRLA/2/2026",), ("-",), (None,)], "v string")
    assert [r[0] for r in df.orderBy(case_sort_key(F.col("v")), F.col("v").asc_nulls_first()).collect()] == [None, "-", "CRLA/2/2026", "CRLA/12/2026", "CRLA/72/2024", "SC/82/2025"]


@pytest.mark.parametrize(
    ("make", "value", "confidence", "status", "review"),
    [
        (V.validate_case_number, "CRLA/1/2024", 0.9, "valid", False),
        (V.validate_case_number, "CRLA/1/2024", 0.5, "warning", True),
        (V.validate_case_number, "x", 0.9, "error", True),
        (V.validate_case_number, None, 0.9, "empty", True),
        (lambda v, c: V.validate_date(v, c, F.lit("1999-06-30").cast("date")), "1.1.2015", 0.9, "warning", True),
        (lambda v, c: V.validate_date(v, c, F.lit("1999-06-30").cast("date")), "31-02-1999", 0.9, "error", True),
        (V.validate_party_name, "ab", 0.9, "error", True),
        (V.validate_party_name, "abc", 0.5, "valid", True),
        (V.validate_party_name, "a_c", 0.9, "warning", True),
        (V.validate_party_name, "-", 0.9, "error", True),
        (V.validate_advocate, "-", 0.1, "empty", False),
        (V.validate_advocate, "x", 0.9, "warning", True),
    ],
)
def test_validation(spark, make, value, confidence, status, review):
    r = spark.createDataFrame([(value, confidence)], "v string, c double").select(make(F.col("v"), F.col("c")).alias("r")).first().r
    assert (r.status, r.requires_review) == (status, review)


def test_record_confidence(spark):
    score = lambda c, i: S.record_confidence(*(F.lit(x) for x in c), F.array(*map(F.lit, i)) if i else F.lit(None).cast("array<string>"))
    rows = spark.range(1).select(score((0.9, 0.9, 0.85, 0.80), []).alias("a"), score((0.7, 0.7, 0.7, 0.6), ["error: x", "warning: y", "other"]).alias("b")).first()
    assert (round(rows.a.overall, 9), rows.a.level, rows.a.needs_review) == (0.88, "HIGH", False)
    assert (round(rows.b.overall, 9), rows.b.level) == (round(0.69 * 0.8 * 0.9, 9), "CRITICAL")


def test_similarity():
    assert lcs_length("CRLA/72/2024", "CRLA/73/2024") == 11
    assert round(token_set_ratio_of("CRLA/72/2024", "CRLA/73/2024"), 2) == 91.67
    assert token_set_ratio_of("", "a") == 0 and token_set_ratio_of("a b", "b a") == 100 and token_set_ratio_of("a b", "b") == 100


def test_strip_takes_what_the_pattern_takes(spark):
    texts = [(f"{chr(i)}a{chr(i)} b{chr(i)}{chr(i)}",) for i in range(1, 0x3100)] + [("",), (None,), (" \t　",)]
    got = spark.createDataFrame(texts, "t string").select(C.strip(F.col("t")).alias("stripped"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("expected"))
    assert got.where(~F.col("stripped").eqNullSafe(F.col("expected"))).count() == 0


def test_sql_of_word_borders(spark):
    rows = [(i, kind, t) for i, (kind, t) in enumerate((k, t) for k in ("party", "advocate", "text") for t in BORDERS)]
    df = spark.createDataFrame(rows, "i int, field_type string, t string")
    got = dict(df.select("i", C.process_multiline(F.array("t"), F.col("field_type"))).collect())
    con = duckdb.connect()
    con.execute("create table odd (i int, field_type varchar, t varchar)")
    con.executemany("insert into odd values (?, ?, ?)", rows)
    want = dict(con.execute(f"select i, {oracle.multiline('joined')} from (select i, field_type, {oracle.strip('t')} as joined from odd)").fetchall())
    assert got == want


def test_texts_with_nothing_to_collapse_are_cleaned_as_all_others(spark):
    """The short ways past the patterns give what the patterns give, and one line what a list of one line gives."""
    texts = ["", " ", "a b", "a  b", "a b", "a\tb", " x vs.y", "K vs. M", "app.X", "AſP, adpp.", "aſp x", "x\ny", " \n ", "\n-\n", "sc / 1 / 2001", "sc /1/2001", "a\n\n b  c", "-", "café app", "\x7f\x7f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, t string")
    full = F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)\s+", " ")
    advocate = full
    for short in C.ABBREVIATIONS:
        advocate = F.regexp_replace(advocate, rf"(?iU)\b{short}\.?\b", short)
    case = F.translate(F.regexp_replace(F.upper(C.strip(F.col("t"))), r"(?U)\s+", ""), "|\\", "//")
    pairs = {"case": (C.normalize_case_number(F.col("t")), case), "advocate": (C.clean_advocate_name(F.col("t")), C.strip(advocate)), "spaces": (C.collapse_spaces(F.coalesce("t", F.lit(""))), full)}
    pairs |= {k: (C.process_line(F.col("t"), k), C.process_multiline(F.split("t", "\n"), k)) for k in ("party", "advocate", "text")}
    wrong = [(k, r.asDict()) for k, (new, old) in pairs.items() for r in df.select("t", new.alias("new"), old.alias("old")).where("not (new <=> old)").collect()]
    assert not wrong
