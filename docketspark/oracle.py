"""The registered queries once more, in SQL for DuckDB: an independent statement of what each should return.

Each function gives SQL text; a query's text is put together from common table expressions over the given tables.
"""

from __future__ import annotations

from . import fixtures as fx

#: fixed values, stated here once more so that a slip in the library shows: prefixes, patterns, signs taken for each other, words of headers and headings
KNOWN_PREFIXES = ("CRLA", "CRL", "CRLM", "CRL.M.P", "CRL.A", "SC", "WP", "WMP", "OS", "AS", "SA", "MFA", "IA", "RFA")
CASE_PATTERN = r"^([A-Z]+\.?[A-Z]?\.?[A-Z]?)/([0-9]+)/([0-9]{4})$"
CASE_SWAPS = (("O", "0"), ("0", "O"), ("I", "1"), ("1", "I"), ("S", "5"), ("5", "S"))
ABBREVIATIONS = ("ADPP", "APP", "ASP", "SP")
DATE_PATTERN = r"^(\d{1,2})[-/.]?(\d{1,2})[-/.]?(\d{4})$"
DATE_SWAPS = (("O", "0"), ("0", "O"), ("I", "1"), ("1", "I"))
HEADER_KEYWORDS = ("Case", "Number", "Party", "Advocate", "Sr", "No", "Date", "Hearing")
SECTION_PHRASES = ("Arguments", "Judgement", "For Orders", "Await Records", "For Further Proceedings", "Admission", "CMP Pending", "Service Pending", "Steps", "For Hearing", "Disposal")

AS_OF = f"DATE '{fx.AS_OF}'"
FAR = f"CAST({AS_OF} + INTERVAL 365 DAY AS DATE)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def empty(x: str) -> str:
    return f"coalesce({strip(x)} IN ('', '-'), TRUE)"


def norm_case(x: str) -> str:
    return rf"replace(replace(regexp_replace(upper({strip(x)}), '\s+', '', 'g'), '|', '/'), chr(92), '/')"


PREFIXES = "(" + ", ".join(f"'{p}'" for p in KNOWN_PREFIXES) + ")"


def case_part(n: str, i: int) -> str:
    return f"regexp_extract({n}, '{CASE_PATTERN}', {i})"


def known_case(x: str) -> str:
    n = norm_case(x)
    return (
        f"CASE WHEN regexp_matches({n}, '{CASE_PATTERN}') AND replace({case_part(n, 1)}, '.', '') IN {PREFIXES} THEN "
        f"{case_part(n, 1)} || '/' || CAST(TRY_CAST({case_part(n, 2)} AS BIGINT) AS VARCHAR) || '/' || CAST(TRY_CAST({case_part(n, 3)} AS INT) AS VARCHAR) END"
    )


def correct_case(x: str) -> str:
    text = f"upper({strip(x)})"
    return f"coalesce({known_case(text)}, " + ", ".join(known_case(f"replace({text}, '{a}', '{b}')") for a, b in CASE_SWAPS) + ")"


def date_part(x: str, i: int) -> str:
    return f"TRY_CAST(regexp_extract({strip(x)}, '{DATE_PATTERN}', {i}) AS INT)"


def valid_parts(d: str, m: str, y: str) -> str:
    leap = f"(({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0)"
    return f"coalesce({y} BETWEEN 1950 AND 2100 AND {m} BETWEEN 1 AND 12 AND {d} >= 1 AND {d} <= (CASE WHEN {m} = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END WHEN {m} IN (4, 6, 9, 11) THEN 30 ELSE 31 END), FALSE)"


def formatted(x: str) -> str:
    d, m, y = (date_part(x, i) for i in (1, 2, 3))
    return f"lpad(CAST({d} AS VARCHAR), 2, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || CAST({y} AS VARCHAR)"


def is_date(x: str) -> str:
    return f"regexp_matches({strip(x)}, '{DATE_PATTERN}')"


def valid_date(x: str) -> str:
    return f"({is_date(x)} AND {valid_parts(*(date_part(x, i) for i in (1, 2, 3)))})"


def correct_date(x: str) -> str:
    text = f"replace({strip(x)}, '/', '-')"
    one = lambda t: f"CASE WHEN {valid_date(t)} THEN {formatted(t)} END"
    return f"coalesce({one(text)}, " + ", ".join(one(f"replace({text}, '{a}', '{b}')") for a, b in DATE_SWAPS) + ")"


def date_obj(x: str) -> str:
    return f"CASE WHEN {valid_date(x)} THEN make_date({date_part(x, 3)}, {date_part(x, 2)}, {date_part(x, 1)}) END"


def clean_party(x: str) -> str:
    return strip(rf"regexp_replace({collapse(f'coalesce({x}, {chr(39) * 2})')}, '(?i)\bvs\.?\b', 'Vs', 'g')")


def clean_advocate(x: str) -> str:
    out = collapse(f"coalesce({x}, '')")
    for a in ABBREVIATIONS:
        out = rf"regexp_replace({out}, '(?i)\b{a}\.?\b', '{a}', 'g')"
    return strip(out)


#: letters, marks, digits and joiners: what stands inside a word in Unicode
WORD_SIGNS = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}"


def whole_word(x: str, word: str, by: str) -> str:
    r"""x with by for each whole word, and for the dot behind it where another word follows, as \b..\.?\b does by Unicode borders.

    chr(1) twice before and chr(2) behind each word are its borders; the first of the two may go with a dot, the other is left.
    """
    marked = rf"regexp_replace({x}, '([{WORD_SIGNS}]+)', chr(1) || chr(1) || '\1' || chr(2), 'g')"
    dotted = rf"regexp_replace({marked}, '(?i)\x01{word}\x02\.\x01', '{by}', 'g')"
    return rf"regexp_replace(regexp_replace({dotted}, '(?i)\x01{word}\x02', '{by}', 'g'), '[\x01\x02]', '', 'g')"


def multiline(t: str) -> str:
    """The cleaned line t by field_type, with Unicode borders of words."""
    advocate = collapse(t)
    for a in ABBREVIATIONS:
        advocate = whole_word(advocate, a, a)
    return f"CASE WHEN {t} = '' THEN '-' WHEN field_type = 'party' THEN {strip(whole_word(collapse(t), 'vs', 'Vs'))} WHEN field_type = 'advocate' THEN {strip(advocate)} ELSE translate({t}, '–—', '--') END"


def list_of(*cases: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN {then} END" for when, then in cases) + "], lambda m: m IS NOT NULL)"


def check_case(v: str, c: str) -> dict[str, str]:
    wrong, low = rf"NOT regexp_matches({v}, '^[A-Z]+\.?[A-Z]?\.?[A-Z]?/\d+/\d{{4}}$')", f"{c} < 0.70"
    e = empty(v)
    return {
        "status": f"CASE WHEN {e} THEN 'empty' WHEN {wrong} THEN 'error' WHEN {low} THEN 'warning' ELSE 'valid' END",
        "conf": f"CASE WHEN {e} THEN 0.0 ELSE {c} END",
        "messages": f"CASE WHEN {e} THEN ['Case number is empty'] ELSE " + list_of((wrong, f"'Case number format invalid: ' || {v}"), (low, "'Low OCR confidence'")) + " END",
        "review": f"({e} OR {wrong} OR {low})",
    }


def check_date(v: str, c: str) -> dict[str, str]:
    wrong, low, e = rf"NOT regexp_matches({v}, '^\d{{2}}-\d{{2}}-\d{{4}}$')", f"{c} < 0.70", empty(v)
    invalid = f"({is_date(v)} AND NOT {valid_date(v)})"
    late = f"coalesce(({date_obj(v)}) > {FAR}, FALSE)"
    return {
        "status": f"CASE WHEN {e} THEN 'empty' WHEN {late} THEN 'warning' WHEN {wrong} OR {invalid} THEN 'error' WHEN {low} THEN 'warning' ELSE 'valid' END",
        "conf": f"CASE WHEN {e} THEN 0.0 ELSE {c} END",
        "messages": f"CASE WHEN {e} THEN ['Date is empty'] ELSE "
        + list_of((wrong, f"'Date format invalid: ' || {v} || ' (expected DD-MM-YYYY)'"), (invalid, f"'Date is invalid: ' || {v}"), (late, f"'Date is not logical: ' || {v}"), (low, "'Low OCR confidence'"))
        + " END",
        "review": f"({e} OR {wrong} OR {invalid} OR {late} OR {low})",
    }


def check_party(v: str, c: str) -> dict[str, str]:
    n, low, e = f"length({strip(v)})", f"{c} < 0.70", empty(v)
    odd = rf"regexp_matches({v}, '[^a-zA-Z0-9\s.,()''\-&]')"
    return {
        "status": f"CASE WHEN {e} OR {n} < 3 THEN 'error' WHEN {n} > 500 OR {odd} THEN 'warning' ELSE 'valid' END",
        "conf": f"CASE WHEN {e} THEN 0.0 ELSE {c} END",
        "messages": f"CASE WHEN {e} THEN ['Party name is required but empty'] ELSE "
        + list_of((f"{n} < 3", f"'Party name too short: ' || {n} || ' chars'"), (f"{n} > 500", f"'Party name too long: ' || {n} || ' chars'"), (odd, "'Party name contains unusual characters'"), (low, "'Low OCR confidence'"))
        + " END",
        "review": f"({e} OR {n} < 3 OR {n} > 500 OR {odd} OR {low})",
    }


def check_advocate(v: str, c: str) -> dict[str, str]:
    n, low, e = f"length({strip(v)})", f"{c} < 0.70", empty(v)
    return {
        "status": f"CASE WHEN {e} THEN 'empty' WHEN {n} < 2 OR {n} > 300 THEN 'warning' ELSE 'valid' END",
        "conf": f"CASE WHEN {e} THEN 1.0 ELSE {c} END",
        "messages": f"CASE WHEN {e} THEN ['Advocate not specified'] ELSE " + list_of((f"{n} < 2", f"'Advocate name too short: ' || {n} || ' chars'"), (f"{n} > 300", f"'Advocate name too long: ' || {n} || ' chars'"), (low, "'Low OCR confidence'")) + " END",
        "review": f"(NOT {e} AND ({n} < 2 OR {n} > 300 OR {low}))",
    }


CHECKS = {"case": (check_case, "case_number", "case_number_confidence"), "date": (check_date, "hearing_date", "date_confidence"), "party": (check_party, "party_name", "party_name_confidence"), "advocate": (check_advocate, "advocate", "advocate_confidence")}


def _checked() -> str:
    out = []
    for short, (check, v, c) in CHECKS.items():
        out += [f"{sql} AS {short}_{name}" for name, sql in check(v, c).items()]
    return ", ".join(out)


def _issues() -> str:
    one = lambda s: f"CASE WHEN {s}_status = 'empty' AND NOT {s}_review THEN [] ELSE list_transform({s}_messages, lambda m: {s}_status || ': ' || m) END"
    return "list_concat(list_concat(" + one("case") + ", " + one("date") + "), list_concat(" + one("party") + ", " + one("advocate") + "))"


LEVEL = "CASE WHEN overall_confidence >= 0.85 THEN 'HIGH' WHEN overall_confidence >= 0.70 THEN 'MEDIUM' WHEN overall_confidence >= 0.50 THEN 'LOW' ELSE 'CRITICAL' END"
FACTOR = "CASE WHEN contains(lower(m), 'error') THEN 0.8::DOUBLE WHEN contains(lower(m), 'warning') THEN 0.9 ELSE 1.0 END"

RAW = f"raw AS ({fx.RECORDS_RAW})"
CLEANED = (
    f"{RAW}, cleaned AS MATERIALIZED (SELECT *, coalesce({correct_case('raw_case_number')}, {strip('raw_case_number')}, '') AS case_number, "
    f"coalesce({correct_date('raw_hearing_date')}, {strip('raw_hearing_date')}, '') AS hearing_date, "
    f"{clean_party('raw_party_name')} AS party_name, {clean_advocate('raw_advocate')} AS advocate FROM raw)"
)
WEIGHTED = "case_number_confidence * 0.40 + date_confidence * 0.30 + party_name_confidence * 0.20 + advocate_confidence * 0.10"
SCORED = (
    f"{CLEANED}, checked AS MATERIALIZED (SELECT *, {_checked()} FROM cleaned), "
    f"issued AS MATERIALIZED (SELECT *, {_issues()} AS validation_issues, (case_review OR date_review OR party_review OR advocate_review) AS has_issues FROM checked), "
    f"scored AS (SELECT *, len(validation_issues) = 0 AS validation_passed, greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_reduce(list_concat([{WEIGHTED}], list_transform(validation_issues, lambda m: {FACTOR})), lambda a, x: a * x))) AS overall_confidence FROM issued), "
    f"levelled AS MATERIALIZED (SELECT *, {LEVEL} AS confidence_level, has_issues OR overall_confidence < 0.70 AS needs_review FROM scored)"
)
RECORDS = (
    f"{SCORED}, firsts AS (SELECT case_number AS k, min(record_id) AS first_id FROM levelled WHERE case_number <> '' GROUP BY 1), "
    "records AS (SELECT levelled.*, coalesce(record_id > first_id, FALSE) AS is_duplicate, CASE WHEN record_id > first_id THEN first_id END AS duplicate_of FROM levelled LEFT JOIN firsts ON case_number = k)"
)

FLAT = f"flat AS ({fx.REGIONS_FLAT})"
BOXES = f"{FLAT}, boxes AS (SELECT image_id, region_idx, text, confidence, CAST(trunc(x_min) AS INT) AS x_min, CAST(trunc(y_min) AS INT) AS y_min, CAST(trunc(x_max) AS INT) AS x_max, CAST(trunc(y_max) AS INT) AS y_max FROM flat)"
ROWS = (
    f"{BOXES}, same AS (SELECT image_id, region_idx, x_min, y_min, x_max, y_max, last_value(text) OVER w AS text, last_value(confidence) OVER w AS confidence FROM boxes "
    "WINDOW w AS (PARTITION BY image_id, x_min, y_min, x_max, y_max ORDER BY region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "gaps AS (SELECT *, coalesce(CAST(y_min - max(y_max) OVER (PARTITION BY image_id ORDER BY y_min, region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 20 AS BIGINT), 0) AS starts FROM same), "
    "clustered AS (SELECT * EXCLUDE starts, CAST(sum(starts) OVER (PARTITION BY image_id ORDER BY y_min, region_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_idx FROM gaps), "
    "rows_ AS (SELECT *, row_number() OVER (PARTITION BY image_id, row_idx ORDER BY x_min, y_min, region_idx) - 1 AS pos FROM clustered)"
)
KEYWORDS = " + ".join(f"CAST(contains(lower(t), '{k.lower()}') AS INT)" for k in HEADER_KEYWORDS)
HEADERS = (
    f"{ROWS}, texts AS (SELECT image_id, row_idx, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS t FROM rows_ GROUP BY ALL), "
    f"headers AS (SELECT image_id, CAST(coalesce(min(CASE WHEN {KEYWORDS} >= 2 THEN row_idx END), 0) AS BIGINT) AS header_row_idx FROM texts GROUP BY 1)"
)
CELLS = f"{HEADERS}, cells AS (SELECT image_id, row_idx, pos AS col_idx, {strip('text')} AS content, confidence FROM rows_ JOIN headers USING (image_id) WHERE row_idx <> header_row_idx AND pos < 4)"
PHRASES = " OR ".join(f"contains(t, '{p}')" for p in SECTION_PHRASES)
HEADINGS = f"headings AS (SELECT image_id, row_idx FROM texts WHERE n <= 2 AND ({PHRASES}))"
BOUNDS = (
    f"{BOXES}, borders AS (SELECT image_id, x_min AS x FROM boxes UNION ALL SELECT image_id, x_max FROM boxes), "
    "bounds AS (SELECT image_id, list_reduce(list_transform(list_sort(list(x)), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] > 30 THEN list_concat(a, x) ELSE a END) AS b FROM borders GROUP BY 1)"
)

CASE_KEY = lambda v: (
    f"CASE WHEN {empty(v)} THEN '' WHEN regexp_matches({strip(v)}, '{CASE_PATTERN}') THEN {case_part(strip(v), 1)} ELSE {v} END AS prefix, "
    f"CASE WHEN NOT {empty(v)} AND regexp_matches({strip(v)}, '{CASE_PATTERN}') THEN CAST({case_part(strip(v), 2)} AS BIGINT) ELSE 0 END AS number, "
    f"CASE WHEN NOT {empty(v)} AND regexp_matches({strip(v)}, '{CASE_PATTERN}') THEN CAST({case_part(strip(v), 3)} AS INT) ELSE 0 END AS year"
)


def _date_key(v: str) -> str:
    part = lambda i: f"TRY_CAST({strip(f'split_part({v}, {chr(39)}-{chr(39)}, {i})')} AS INT)"
    good = f"NOT {empty(v)} AND {part(1)} IS NOT NULL AND {part(2)} IS NOT NULL AND {part(3)} IS NOT NULL"
    return ", ".join(f"CASE WHEN {good} THEN {part(i)} ELSE {last} END AS {name}" for i, last, name in ((3, 9999, "key_year"), (2, 99, "key_month"), (1, 99, "key_day")))


def _bool_text(c: str) -> str:
    return f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END"


def _message_sql(short: str) -> str:
    return f"WITH {CLEANED}, checked AS (SELECT *, {_checked()} FROM cleaned) SELECT record_id, {short}_status AS status, {short}_conf::DOUBLE AS confidence, array_to_string({short}_messages, '|') AS messages, {short}_review AS requires_review FROM checked"


ISSUES = "array_to_string(validation_issues, '; ')"
NATURAL = "regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+')"

SQL: dict[str, str] = {
    "flagship_run_report": f"WITH {RECORDS} SELECT run_id, count(*) AS total_records, count(*) FILTER (needs_review) AS records_requiring_review, count(*) FILTER (is_duplicate) AS duplicates, round(avg(overall_confidence), 9) AS average_confidence FROM records GROUP BY run_id",
    "k1_regions": f"WITH {FLAT} SELECT image_id, region_idx - 1 AS region_idx, text, confidence FROM (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY region_idx) AS region_idx, text, confidence FROM flat)",
    "k3_intake": f"WITH d AS ({fx.DOCUMENTS_META}), e AS (SELECT *, contains(filename, '.') AND lower(regexp_extract(filename, '[^.]*$')) IN ('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'bmp') AS typed, file_size <= 52428800 AS fits FROM d) SELECT doc_id, filename, file_size, typed AND fits AS accepted, CASE WHEN NOT typed THEN 'file type' WHEN NOT fits THEN 'file size' END AS reject_reason, CASE WHEN typed AND fits THEN 'PENDING' END AS status FROM e",
    "k4_csv_rows": f"WITH {RECORDS} SELECT case_number, hearing_date, party_name, advocate, confidence_level, {_bool_text('needs_review')} AS needs_review, {_bool_text('is_duplicate')} AS is_duplicate, '-' AS absent, {ISSUES} AS validation_issues FROM records",
    "k5_json_metadata": f"WITH {RAW} SELECT '1999-06-30T00:00:00' AS exported_at, count(*) AS total_records, '1.0' AS format_version FROM raw",
    "k6_html_rows": f"WITH {SCORED}, e AS (SELECT *, replace(replace(replace(replace(replace(party_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS party FROM levelled) SELECT '<tr' || CASE WHEN needs_review THEN ' class=''review''' ELSE '' END || '><td>' || case_number || '</td><td>' || hearing_date || '</td><td>' || party || '</td><td>' || advocate || '</td></tr>' AS value FROM e",
    "k7_audit_trail": f"WITH {CLEANED} " + " UNION ALL ".join(f"SELECT record_id, '{f}' AS field, raw_{f} AS raw_text, {f} AS final_text, {c}_confidence AS confidence, {c}_confidence < 0.70 AS requires_review FROM cleaned" for f, c in (("case_number", "case_number"), ("hearing_date", "date"), ("party_name", "party_name"), ("advocate", "advocate"))),
    "f1_case_number_filter": f"WITH {CLEANED} SELECT record_id, case_number FROM cleaned WHERE case_number ILIKE '%a/1_/%'",
    "f2_level_filter": f"WITH {SCORED} SELECT record_id, confidence_level FROM levelled WHERE confidence_level = 'LOW'",
    "f3_review_filter": f"WITH {SCORED} SELECT record_id, needs_review FROM levelled WHERE NOT needs_review",
    "f4_list_view": f"WITH {SCORED} SELECT record_id, case_number, hearing_date, party_name, advocate, confidence_level, needs_review FROM levelled",
    "f5_detail": f"WITH {RECORDS} SELECT record_id, case_number, hearing_date, party_name, advocate, confidence_level, needs_review, is_duplicate, validation_passed, page_number FROM records WHERE record_id = (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 7 = 3)",
    "f6_minimum": f"WITH {CLEANED} SELECT record_id, length(case_number) > 0 AND length(hearing_date) > 0 AS complete FROM cleaned",
    "f7_review_queue": f"WITH {SCORED} SELECT record_id, coalesce(validation_issues[1], 'confidence ' || confidence_level) AS reason, CASE confidence_level WHEN 'CRITICAL' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END AS priority, 'PENDING' AS status FROM levelled WHERE needs_review",
    "f8_cell_lookup": f"WITH {CELLS} SELECT image_id, row_idx, col_idx, content FROM cells WHERE row_idx = 2 AND col_idx = 1",
    "c1_normalize_case_number": f"WITH {RAW} SELECT record_id, {norm_case('raw_case_number')} AS normalized FROM raw",
    "c2_parse_case_number": f"WITH {RAW}, n AS (SELECT record_id, {strip('raw_case_number')} AS raw_text, {norm_case('raw_case_number')} AS t FROM raw), p AS (SELECT *, regexp_matches(t, '{CASE_PATTERN}') AS m, {case_part('t', 1)} AS prefix, TRY_CAST({case_part('t', 2)} AS BIGINT) AS number, TRY_CAST({case_part('t', 3)} AS INT) AS year FROM n) SELECT record_id, CASE WHEN m THEN raw_text END AS raw_text, CASE WHEN m THEN prefix END AS prefix, CASE WHEN m THEN number END AS number, CASE WHEN m THEN year END AS year, CASE WHEN m THEN replace(prefix, '.', '') IN {PREFIXES} END AS is_valid, CASE WHEN m THEN prefix || '/' || number || '/' || year END AS normalized, CASE WHEN m THEN CASE WHEN replace(prefix, '.', '') IN {PREFIXES} THEN 0.95::DOUBLE ELSE 0.70 END END AS confidence FROM p",
    "c3_valid_case_number": f"WITH {RAW}, n AS (SELECT record_id, {norm_case('raw_case_number')} AS t FROM raw) SELECT record_id, coalesce(regexp_matches(t, '{CASE_PATTERN}') AND replace({case_part('t', 1)}, '.', '') IN {PREFIXES} AND TRY_CAST({case_part('t', 2)} AS BIGINT) > 0 AND TRY_CAST({case_part('t', 3)} AS INT) BETWEEN 1950 AND 2100, FALSE) AS valid FROM n",
    "c4_correct_case_number": f"WITH {RAW} SELECT record_id, {correct_case('raw_case_number')} AS corrected FROM raw",
    "c5_join_multiline": rf"WITH d AS ({fx.FIELD_LINES}), k AS (SELECT doc_id, list_filter(list_transform(lines, lambda l: {strip('l')}), lambda l: l <> '') AS kept FROM d) SELECT doc_id, CASE WHEN len(kept) = 0 THEN '' WHEN len(kept) = 1 THEN kept[1] ELSE {strip(collapse('array_to_string(kept, chr(32))'))} END AS joined FROM k",
    "c6_clean_party_name": f"WITH {RAW} SELECT record_id, {clean_party('raw_party_name')} AS party_name FROM raw",
    "c7_clean_advocate_name": f"WITH {RAW} SELECT record_id, {clean_advocate('raw_advocate')} AS advocate FROM raw",
    "c8_special_chars": "SELECT doc_id, translate(text, '–—', '--') AS normalized FROM documents",
    "c9_is_dash": f"WITH {RAW} SELECT record_id, coalesce({strip('raw_party_name')} IN ('-', '--', '—', '–'), FALSE) AS dash FROM raw",
    "c10_valid_text": f"WITH {RAW} SELECT record_id, CASE WHEN {strip('raw_advocate')} IN ('', '-', '--') THEN FALSE ELSE length({strip('raw_advocate')}) BETWEEN 3 AND 500 END AS valid FROM raw",
    "c11_process_multiline": rf"WITH d AS ({fx.FIELD_LINES}), k AS (SELECT doc_id, list_filter(list_transform(lines, lambda l: {strip('l')}), lambda l: l <> '') AS kept FROM d WHERE field_type = 'text'), j AS (SELECT doc_id, CASE WHEN len(kept) = 0 THEN '' WHEN len(kept) = 1 THEN kept[1] ELSE {strip(collapse('array_to_string(kept, chr(32))'))} END AS joined FROM k) SELECT doc_id, CASE WHEN joined = '' THEN '-' ELSE translate(joined, '–—', '--') END AS value FROM j",
    "c11_process_multiline_all": rf"WITH d AS ({fx.FIELD_LINES}), k AS (SELECT doc_id, field_type, list_filter(list_transform(lines, lambda l: {strip('l')}), lambda l: l <> '') AS kept FROM d), j AS (SELECT doc_id, field_type, CASE WHEN len(kept) = 0 THEN '' WHEN len(kept) = 1 THEN kept[1] ELSE {strip(collapse('array_to_string(kept, chr(32))'))} END AS joined FROM k) SELECT doc_id, {multiline('joined')} AS value FROM j",
    "c12_natural_sort_key": f"WITH {CLEANED} SELECT record_id, array_to_string(list_transform({NATURAL.format('party_name')}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE x END), '|') AS key FROM cleaned",
    "t1_parse_date": f"WITH {RAW} SELECT record_id, CASE WHEN {is_date('raw_hearing_date')} THEN {date_part('raw_hearing_date', 1)} END AS day, CASE WHEN {is_date('raw_hearing_date')} THEN {date_part('raw_hearing_date', 2)} END AS month, CASE WHEN {is_date('raw_hearing_date')} THEN {date_part('raw_hearing_date', 3)} END AS year, CASE WHEN {is_date('raw_hearing_date')} THEN {valid_date('raw_hearing_date')} END AS is_valid, CASE WHEN {is_date('raw_hearing_date')} THEN {formatted('raw_hearing_date')} END AS formatted, {date_obj('raw_hearing_date')} AS date_obj, CASE WHEN {is_date('raw_hearing_date')} THEN CASE WHEN {valid_date('raw_hearing_date')} THEN 0.95::DOUBLE ELSE 0.50 END END AS confidence FROM raw",
    "t2_valid_date_parts": f"WITH p AS (SELECT o_orderkey, CAST(o_orderkey % 33 AS INT) AS d, CAST(o_custkey % 14 AS INT) AS m, CAST(1940 + o_orderkey % 170 AS INT) AS y FROM orders) SELECT o_orderkey, {valid_parts('d', 'm', 'y')} AS valid FROM p",
    "t3_logical_date": f"SELECT o_orderkey, CAST(o_orderdate AS DATE) <= {FAR} AND year(o_orderdate) >= 1950 AS logical FROM orders",
    "t4_correct_date": f"WITH {RAW} SELECT record_id, {correct_date('raw_hearing_date')} AS corrected FROM raw",
    "t5_date_sort_key": f"WITH {RAW} SELECT record_id, {_date_key('raw_hearing_date')} FROM raw",
    "v1_validate_case_number": _message_sql("case"),
    "v2_validate_date": _message_sql("date"),
    "v3_validate_party_name": _message_sql("party"),
    "v4_validate_advocate": _message_sql("advocate"),
    "v5_validate_records": f"WITH {SCORED} SELECT record_id, {ISSUES} AS issues, validation_passed, has_issues FROM levelled",
    "s1_record_confidence": f"WITH {SCORED} SELECT record_id, overall_confidence AS overall, confidence_level AS level, overall_confidence < 0.70 AS low, case_number_confidence * 0.40 AS case_share, advocate_confidence * 0.10 AS advocate_share FROM levelled",
    "s2_assess_records": f"WITH {RAW}, scored AS (SELECT record_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, case_number_confidence * 0.40 + date_confidence * 0.30 + 0.7::DOUBLE * 0.20::DOUBLE + 0.6::DOUBLE * 0.10::DOUBLE)) AS overall_confidence FROM raw) SELECT record_id, overall_confidence, {LEVEL} AS confidence_level, overall_confidence < 0.70 AS needs_review FROM scored",
    "s3_field_confidence": f"WITH {RAW} SELECT record_id, least(date_confidence * 0.5 + CASE WHEN record_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN record_id % 3 = 0 THEN 0.15::DOUBLE ELSE 0.0 END + party_name_confidence * 0.15, 1.0::DOUBLE) AS score FROM raw",
    "s4_case_number_confidence": f"WITH {RAW} SELECT record_id, least(case_number_confidence * 0.4 + CASE WHEN record_id % 2 = 0 THEN 0.35::DOUBLE ELSE 0.0 END + CASE WHEN record_id % 3 = 0 THEN 0.15::DOUBLE ELSE 0.0 END + CASE WHEN record_id % 5 = 0 THEN 0.1::DOUBLE ELSE 0.0 END, 1.0::DOUBLE) AS score FROM raw",
    "s5_date_confidence": f"WITH {RAW} SELECT record_id, least(date_confidence * 0.4 + CASE WHEN record_id % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0 END + CASE WHEN record_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN record_id % 3 = 0 THEN 0.15::DOUBLE ELSE 0.0 END, 1.0::DOUBLE) AS score FROM raw",
    "s6_text_field_confidence": f"WITH {RAW} SELECT record_id, greatest(least(party_name_confidence * 0.7 + CASE WHEN record_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0.0 END - CASE WHEN record_id % 3 = 0 THEN 0.1::DOUBLE ELSE 0.0 END, 1.0::DOUBLE), 0.0::DOUBLE) AS score FROM raw",
    "s7_weighted_confidence": f"WITH {RAW}, w AS (SELECT record_id, {WEIGHTED} AS score FROM raw) SELECT record_id, score, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM w",
    "s8_display_level": f"WITH {RAW} SELECT record_id, CASE WHEN case_number_confidence >= 0.8 THEN 'high' WHEN case_number_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS badge FROM raw",
    "s9_image_quality_score": f"WITH q AS ({fx.QUALITY_METRICS}) SELECT image_id, (least(sharpness / 100.0, 1.0::DOUBLE) * 0.4 + least(contrast / 50.0, 1.0::DOUBLE) * 0.3 + greatest(1.0::DOUBLE - noise * 2, 0.0::DOUBLE) * 0.2 + least(brightness / 200.0, 1.0::DOUBLE) * 0.1) * 100 AS score FROM q",
    "l1_region_boxes": f"WITH {BOXES} SELECT image_id, region_idx, x_min, y_min, x_max, y_max FROM boxes",
    "l2_cluster_rows": f"WITH {ROWS} SELECT image_id, region_idx, row_idx FROM clustered",
    "l3_order_row_items": f"WITH {ROWS} SELECT image_id, region_idx, row_idx, pos FROM rows_",
    "l4_rows_from_regions": f"WITH {ROWS} SELECT image_id, region_idx, row_idx, pos, text, confidence FROM rows_",
    "l5_column_boundaries": f"WITH {BOUNDS} SELECT image_id, array_to_string(b, ',') AS boundaries FROM bounds",
    "l6_assign_columns": f"WITH {BOUNDS}, c AS (SELECT boxes.image_id, region_idx, len(list_filter(b, lambda v: v <= (x_min + x_max) / 2)) - 1 AS col, len(b) AS n FROM boxes JOIN bounds USING (image_id)) SELECT image_id, region_idx, CAST(col AS INT) AS col FROM c WHERE col >= 0 AND col < n - 1",
    "l7_organize_columns": f"WITH {ROWS}, borders AS (SELECT image_id, x_min AS x FROM boxes UNION ALL SELECT image_id, x_max FROM boxes), bounds AS (SELECT image_id, max(x) AS width, list_reduce(list_transform(list_sort(list(x)), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] > 30 THEN list_concat(a, x) ELSE a END) AS f FROM borders GROUP BY 1), used AS (SELECT image_id, CASE WHEN len(f) < 2 THEN [0.0::DOUBLE, width / 4, 2 * width / 4, 3 * width / 4, width] ELSE list_transform(f, lambda x: x::DOUBLE) END AS b FROM bounds), c AS (SELECT rows_.image_id, region_idx, row_idx, len(list_filter(b, lambda v: v <= (x_min + x_max) / 2)) - 1 AS col, len(b) AS n FROM rows_ JOIN used USING (image_id)) SELECT image_id, region_idx, row_idx, CAST(col AS INT) AS col FROM c WHERE col >= 0 AND col < n - 1",
    "l8_header_row": f"WITH {HEADERS} SELECT image_id, header_row_idx FROM headers",
    "l9_column_headers": f"WITH {HEADERS} SELECT image_id, header_row_idx, coalesce(string_agg({strip('text')}, '|' ORDER BY pos) FILTER ({strip('text')} <> ''), '') AS headers FROM rows_ JOIN headers USING (image_id) WHERE row_idx = header_row_idx GROUP BY ALL",
    "l10_parse_cells": f"WITH {CELLS} SELECT image_id, row_idx, col_idx, content, confidence FROM cells",
    "l11_section_headings": f"WITH {HEADERS}, {HEADINGS} SELECT image_id, row_idx FROM headings",
    "l12_cells_to_records": f"WITH {CELLS}, {HEADINGS}, w AS (SELECT image_id, row_idx, max(content) FILTER (col_idx = 0) AS a, max(content) FILTER (col_idx = 1) AS b, max(content) FILTER (col_idx = 2) AS c, max(content) FILTER (col_idx = 3) AS d, coalesce(max(confidence) FILTER (col_idx = 0), 0.0) AS case_number_confidence FROM cells ANTI JOIN headings USING (image_id, row_idx) GROUP BY ALL) SELECT image_id, row_idx, coalesce(nullif(a, ''), '-') AS raw_case_number, coalesce(nullif(b, ''), '-') AS raw_hearing_date, CASE WHEN coalesce(c, '') = '' THEN '-' ELSE {clean_party('c')} END AS raw_party_name, CASE WHEN coalesce(d, '') = '' THEN '-' ELSE {clean_advocate('d')} END AS raw_advocate, case_number_confidence FROM w",
    "j1_merge_ocr": f"WITH p AS ({fx.REGIONS_FLAT}), s AS ({fx.REGIONS_SECONDARY}), f AS (SELECT image_id, lower(text) AS k, arg_min(confidence, region_idx) AS other FROM s GROUP BY ALL) SELECT p.image_id, region_idx, text, CASE WHEN other IS NULL THEN confidence ELSE (confidence + other) / 2.0 END AS confidence, CASE WHEN other IS NULL THEN 'paddle' ELSE 'paddle+secondary' END AS engine, 'primary' AS source FROM p LEFT JOIN f ON p.image_id = f.image_id AND lower(p.text) = f.k UNION ALL SELECT image_id, region_idx, text, confidence, 'paddle', 'secondary' FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.image_id = s.image_id AND lower(p.text) = lower(s.text))",
    "j4_records_of_documents": f"WITH {RAW}, d AS ({fx.DOCUMENTS_META}), runs AS (SELECT DISTINCT run_id, run_id AS document_id FROM raw) SELECT record_id, run_id, doc_id, filename FROM raw JOIN runs USING (run_id) JOIN d ON document_id = doc_id",
    "d1_duplicate_case_numbers": f"WITH {CLEANED} SELECT case_number, count(*) AS count FROM cleaned GROUP BY 1 HAVING count(*) > 1",
    "d2_unique_case_numbers": f"WITH {CLEANED} SELECT DISTINCT case_number FROM cleaned",
    "d3_mark_duplicates": f"WITH {RECORDS} SELECT record_id, is_duplicate, duplicate_of FROM records",
    "d4_duplicate_sources": f"WITH {CLEANED} SELECT case_number, count(*) AS count, array_to_string(list_sort(list(DISTINCT run_id)), ',') AS sources FROM cleaned WHERE case_number <> '' GROUP BY 1 HAVING count(*) > 1",
    "d6_handle_duplicates": f"WITH {RECORDS} SELECT record_id, 'review' AS mode, needs_review OR is_duplicate AS needs_review FROM records UNION ALL SELECT record_id, 'remove_exact', needs_review FROM records WHERE NOT is_duplicate UNION ALL SELECT record_id, 'keep_all', needs_review FROM records",
    "a1_page_text": f"WITH {FLAT} SELECT image_id, string_agg(text, chr(10) ORDER BY region_idx) AS raw_text, round(avg(confidence), 9) AS overall_confidence FROM flat GROUP BY 1",
    "a2_export_summary": f"WITH {RECORDS} SELECT count(*) AS total_records, count(*) FILTER (needs_review) AS records_needing_review, round(avg(overall_confidence), 9) AS average_confidence, count(*) FILTER (confidence_level = 'HIGH') AS high, count(*) FILTER (confidence_level = 'MEDIUM') AS medium, count(*) FILTER (confidence_level = 'LOW') AS low, count(*) FILTER (confidence_level = 'CRITICAL') AS critical, count(*) FILTER (is_duplicate) AS duplicates_found FROM records",
    "a4_image_results": f"WITH {SCORED} SELECT page_number, count(*) AS record_count, count(*) FILTER (overall_confidence >= 0.85) AS high_confidence, count(*) FILTER (needs_review) AS needs_review FROM levelled GROUP BY 1",
    "a5_accuracy_report": f"WITH {RECORDS}, t AS (SELECT count(*) AS total, count(*) FILTER (NOT needs_review AND NOT is_duplicate) AS accepted, count(*) FILTER (needs_review AND NOT is_duplicate) AS review, count(*) FILTER (is_duplicate) AS duplicates FROM records) SELECT *, accepted * 100.0::DOUBLE / total AS accepted_percent, review * 100.0::DOUBLE / total AS review_percent, duplicates * 100.0::DOUBLE / total AS duplicates_percent FROM t",
    "a5_batch_totals": f"WITH {SCORED} SELECT count(DISTINCT page_number) AS images, count(*) AS record_count, count(*) FILTER (overall_confidence >= 0.85) AS high_confidence, count(*) FILTER (needs_review) AS needs_review FROM levelled",
    "a6_site_stats": f"WITH {SCORED} SELECT (SELECT count(*) FROM documents) AS total_documents, count(*) AS total_records, round(avg(overall_confidence), 9) AS average_confidence FROM levelled",
    "a7_group_by_field": f"WITH {CLEANED} SELECT hearing_date AS group_value, count(*) AS count FROM cleaned GROUP BY 1 UNION ALL SELECT 'unknown', count(*) FROM cleaned",
    "o1_case_sort_key": f"WITH {RAW} SELECT record_id, {CASE_KEY('raw_case_number')} FROM raw",
    "o6_sort_modes": f"WITH {CLEANED}, k AS (SELECT record_id, {CASE_KEY('case_number')} FROM cleaned) SELECT record_id, number FROM k",
    "o7_group_and_sort": f"WITH {CLEANED}, k AS (SELECT record_id, CAST(run_id AS VARCHAR) AS group_value, {CASE_KEY('case_number')} FROM cleaned) SELECT record_id, group_value, row_number() OVER (PARTITION BY group_value ORDER BY prefix, number, year, record_id) AS pos FROM k",
    "o8_page": f"WITH {CLEANED} SELECT record_id, case_number FROM cleaned ORDER BY record_id LIMIT 100 OFFSET 40",
}
SQL["a3_run_stats"] = SQL["flagship_run_report"]
SQL["k2_records_round_trip"] = f"WITH {RECORDS} SELECT record_id, run_id, case_number, hearing_date, overall_confidence, confidence_level, needs_review, duplicate_of, {ISSUES} AS issues FROM records"
_sorted = "SELECT record_id, {cols} FROM k ORDER BY {order}"
_keys = f"WITH {CLEANED}, k AS (SELECT record_id, {CASE_KEY('case_number')}, {_date_key('hearing_date')}, party_name FROM cleaned) "
SQL |= {
    "o2_sort_by_case_number": _keys + _sorted.format(cols="prefix, number, year", order="prefix DESC, number DESC, year DESC, record_id"),
    "o3_sort_by_date": _keys + _sorted.format(cols="key_year, key_month, key_day", order="key_year, key_month, key_day, record_id"),
    "o4_sort_by_party_name": _keys + "SELECT record_id, party_name FROM k",
    "o5_sort_by_fields": _keys + _sorted.format(cols="prefix, key_year", order="prefix DESC, number DESC, year DESC, key_year DESC, key_month DESC, key_day DESC, record_id DESC"),
}

# what the queries above leave out: headings that are there, confidences, positions in an order, words in common, images
_headed = lambda name: SQL[name].replace(fx.REGIONS_FLAT, fx.REGIONS_HEADED)
_word_list = lambda x: rf"list_distinct(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''))"
_one_has_all = lambda a, b: f"(len(list_intersect({a}, {b})) > 0 AND (len(list_intersect({a}, {b})) = len({a}) OR len(list_intersect({a}, {b})) = len({b})))"
_level_cells = "|| '</td><td><span class=''' || lower(confidence_level) || '''>' || upper(confidence_level) || '</span></td>' || CASE WHEN needs_review THEN '<td>Yes</td>' ELSE '<td>No</td>' END || '</tr>' AS value, abs(round(overall_confidence * 100, 2) - overall_confidence * 100) <= 0.0050000001 AS near"
SQL |= {
    "l11_headings_present": _headed("l11_section_headings"),
    "l12_records_without_headings": _headed("l12_cells_to_records"),
    "k6_html_rows_confidence": SQL["k6_html_rows"].replace("|| '</td></tr>' AS value", _level_cells).replace("SELECT '<tr'", "SELECT record_id, '<tr'"),
    "f4_list_view_confidence": f"WITH {SCORED} SELECT record_id, case_number, round(overall_confidence, 9) AS exact, abs(round(overall_confidence, 4) - overall_confidence) <= 0.00005000001 AS near FROM levelled",
    "f3_export_filter": f"WITH {SCORED} SELECT record_id, confidence_level, needs_review FROM levelled WHERE confidence_level = 'MEDIUM' AND needs_review",
    "o2_case_number_positions": f"WITH {CLEANED}, k AS (SELECT record_id, {CASE_KEY('case_number')} FROM cleaned) SELECT record_id, row_number() OVER (ORDER BY prefix, number, year, record_id) AS position FROM k",
    "o4_party_name_positions": f"WITH {CLEANED}, k AS (SELECT record_id, list_transform({NATURAL.format('party_name')}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 20, '0') ELSE x END) AS key FROM cleaned) SELECT record_id, row_number() OVER (ORDER BY key, record_id) AS position FROM k",
    "o6_number_positions": f"WITH {CLEANED}, k AS (SELECT record_id, {CASE_KEY('case_number')} FROM cleaned) SELECT record_id, number, row_number() OVER (ORDER BY number, record_id) AS position FROM k",
    "o8_page_counts": f"WITH {CLEANED} SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM cleaned",
    "a7_group_members": f"WITH {CLEANED} SELECT CAST(page_number * 1000 + run_id AS VARCHAR) AS group_value, array_to_string(list_sort(list(record_id)), ',') AS members FROM cleaned GROUP BY 1",
    "d0_words_in_common": f"WITH {CLEANED}, w AS (SELECT record_id, {_word_list('raw_party_name')} AS a, {_word_list('party_name')} AS b FROM cleaned) SELECT record_id, {_one_has_all('a', 'b')} AS is_full FROM w",
    "j2_equal_parties": f"WITH {CLEANED}, g AS MATERIALIZED (SELECT case_number AS c, party_name AS p, min(record_id) AS f, count(*) AS n, {_word_list('party_name')} AS w FROM cleaned GROUP BY 1, 2), "
    "m AS (SELECT 'member' AS kind, f AS id1, record_id AS id2 FROM cleaned JOIN g ON case_number = c AND party_name = p WHERE record_id > f AND len(w) > 0), "
    f"l AS (SELECT 'link' AS kind, least(x.f, y.f) AS id1, greatest(x.f, y.f) AS id2 FROM g x JOIN g y ON x.c = y.c AND x.p < y.p WHERE {_one_has_all('x.w', 'y.w')}) SELECT *, 1.0::DOUBLE AS similarity FROM m UNION ALL SELECT *, 1.0::DOUBLE FROM l",
    "s10_image_quality": f"WITH i AS ({fx.IMAGES_2X2}), e AS (SELECT *, 2 * b + 2 * c - 4 * a AS la, 2 * a + 2 * d - 4 * b AS lb, 2 * a + 2 * d - 4 * c AS lc, 2 * b + 2 * c - 4 * d AS ld FROM i) "
    "SELECT image_id, round((la * la + lb * lb + lc * lc + ld * ld) / 4.0::DOUBLE - ((la + lb + lc + ld) / 4.0::DOUBLE) ** 2, 6) AS sharpness, round(sqrt(greatest(0, (a * a + b * b + c * c + d * d) / 4.0::DOUBLE - ((a + b + c + d) / 4.0::DOUBLE) ** 2)), 6) AS contrast, "
    "round((a + b + c + d) / 4.0::DOUBLE, 6) AS brightness, round((abs(la) + abs(lb) + abs(lc) + abs(ld)) / 4.0::DOUBLE / 255.0::DOUBLE, 6) AS noise FROM e",
}

# similarity in full: words, what is common, and the longest common subsequence of the rests as a fold over bits (rests of up to 62 signs)
_D = "::DOUBLE"
_rated = lambda pairs: (
    f"t AS (SELECT *, list_sort({_word_list('a')}) AS wa, list_sort({_word_list('b')}) AS wb FROM ({pairs})), "
    "c AS (SELECT *, array_to_string(list_filter(wa, lambda w: list_contains(wb, w)), ' ') AS s, array_to_string(list_filter(wa, lambda w: NOT list_contains(wb, w)), ' ') AS ra, array_to_string(list_filter(wb, lambda w: NOT list_contains(wa, w)), ' ') AS rb FROM t), "
    "m AS (SELECT *, list_transform(string_split(rb, ''), lambda x: CAST(list_sum(list_transform(range(1, length(ra) + 1), lambda i: CASE WHEN ra[i] = x THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END)) AS BIGINT)) AS hits FROM c), "
    "l AS (SELECT *, CASE WHEN ra = '' OR rb = '' THEN 0 ELSE 62 - bit_count(list_reduce(hits, lambda r, h: ((r + (r & h)) | (r - (r & h))) & 4611686018427387903::BIGINT, 4611686018427387903::BIGINT)) END AS lcs, "
    "CASE WHEN s = '' THEN 0 ELSE 1 END AS gap, length(s) AS ns, length(ra) AS na, length(rb) AS nb FROM m), "
    f"q AS (SELECT *, 100.0{_D} * (1 - (na + nb - 2 * lcs){_D} / (2 * (ns + gap) + na + nb){_D}) AS whole, 100.0{_D} * (1 - (gap + na){_D} / (ns + ns + gap + na){_D}) AS alone_a, 100.0{_D} * (1 - (gap + nb){_D} / (ns + ns + gap + nb){_D}) AS alone_b FROM l WHERE len(wa) > 0 AND len(wb) > 0), "
    f"rated AS (SELECT *, CASE WHEN gap = 1 AND (na = 0 OR nb = 0) THEN 100.0{_D} WHEN gap = 1 THEN greatest(whole, alone_a, alone_b) ELSE whole END AS ratio FROM q)"
)
_groups = f"g AS MATERIALIZED (SELECT case_number AS c, party_name AS p, min(record_id) AS f, count(*) AS n, {_word_list('party_name')} AS w FROM cleaned GROUP BY 1, 2)"
_similar_records = (
    f"WITH {CLEANED}, {_groups}, {_rated('SELECT x.f AS f1, y.f AS f2, x.p AS a, y.p AS b FROM g x JOIN g y ON x.c = y.c AND x.p < y.p')}, "
    f"links AS (SELECT 'link' AS kind, least(f1, f2) AS id1, greatest(f1, f2) AS id2, 0.7{_D} + 0.3{_D} * (ratio / 100.0{_D}) AS similarity FROM rated), "
    f"members AS (SELECT 'member' AS kind, f AS id1, record_id AS id2, 1.0{_D} AS similarity FROM cleaned JOIN g ON case_number = c AND party_name = p WHERE record_id > f AND len(w) > 0) "
)
# different numbers of one word each are near only if few signs are put in, left out or changed; those of several words are held against all
_similar_numbers = (
    f"WITH {CLEANED}, v AS MATERIALIZED (SELECT case_number AS v, count(*) AS n, len({_word_list('case_number')}) AS k FROM cleaned GROUP BY 1), "
    f"{_rated('SELECT x.v AS a, y.v AS b, x.n * y.n AS pairs FROM v x JOIN v y ON x.v < y.v WHERE x.k > 0 AND y.k > 0 AND (x.k > 1 OR y.k > 1 OR (abs(length(x.v) - length(y.v)) <= 0.15 * (length(x.v) + length(y.v)) AND levenshtein(x.v, y.v) <= 0.15 * (length(x.v) + length(y.v))))')} "
)
_number_rows = f"FROM rated WHERE ratio / 100.0{_D} >= 0.85{_D}"
SQL |= {
    "d0_token_set_ratio": f"WITH {CLEANED}, {_rated('SELECT record_id, raw_party_name AS a, party_name AS b FROM cleaned')} SELECT cleaned.record_id, coalesce(ratio, 0.0{_D}) AS ratio FROM cleaned LEFT JOIN rated USING (record_id)",
    "j2_similar_records": _similar_records + f"SELECT * FROM links WHERE similarity >= 0.9{_D} UNION ALL SELECT * FROM members",
    "j3_similar_case_numbers": _similar_numbers + f"SELECT a AS case1, b AS case2, ratio / 100.0{_D} AS similarity, pairs " + _number_rows,
    "d5_duplicate_candidates": f"SELECT 'exact' AS kind, case_number AS first, case_number AS second, CAST(count AS DOUBLE) AS score FROM ({SQL['d1_duplicate_case_numbers']}) UNION ALL "
    f"SELECT CASE kind WHEN 'link' THEN 'record' ELSE kind END, CAST(id1 AS VARCHAR), CAST(id2 AS VARCHAR), similarity FROM ({_similar_records}SELECT * FROM links WHERE similarity >= 0.9{_D} UNION ALL SELECT * FROM members) UNION ALL "
    f"SELECT 'number', a, b, ratio / 100.0{_D} FROM ({_similar_numbers}SELECT * {_number_rows})",
}

# pictures in colour, lines that can't be read, files listed, amounts in messages, positions by date and by several fields, one record's confidences
_gray = f"floor(red * 0.299{_D} + green * 0.587{_D} + blue * 0.114{_D} + 0.5{_D})"
_mirror = lambda c, last: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > {last} THEN 2 * {last} - ({c}) ELSE {c} END"
_amounts = [("case_number", "case_number"), ("hearing_date", "date"), ("party_name", "party_name"), ("advocate", "advocate")]
_confidences = ("case_number_confidence", "date_confidence", "party_name_confidence", "advocate_confidence", "overall_confidence")
SQL |= {
    "s10_colour_quality": f"WITH p AS MATERIALIZED (SELECT image_id, y, x, {_gray} AS v FROM ({fx.PIXELS_5X4})), "
    "n AS (SELECT image_id, y, x, v, unnest([y - 1, y + 1, y, y]) AS y0, unnest([x, x, x - 1, x + 1]) AS x0 FROM p), "
    f"e AS (SELECT n.image_id, n.y, n.x, max(n.v) AS v, sum(p.v) - 4 * max(n.v) AS l FROM n JOIN p ON p.image_id = n.image_id AND p.y = {_mirror('y0', 3)} AND p.x = {_mirror('x0', 4)} GROUP BY 1, 2, 3) "
    f"SELECT image_id, round(var_pop(l), 6) AS sharpness, round(stddev_pop(v), 6) AS contrast, round(avg(v), 6) AS brightness, round(avg(abs(l)) / 255.0{_D}, 6) AS noise FROM e GROUP BY 1",
    "k1_json_lines": f"WITH f AS ({fx.REGIONS_FLAT}), g AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY region_idx) - 1 AS region_idx, text, confidence FROM f), "
    "i AS (SELECT DISTINCT image_id, CASE WHEN image_id % 7 = 0 THEN 'not readable' WHEN image_id % 11 = 0 THEN 'no image' WHEN image_id % 13 = 0 THEN 'no boxes' END AS reason FROM f) "
    "SELECT image_id, region_idx, text, confidence, NULL::VARCHAR AS reason FROM g JOIN i USING (image_id) WHERE reason IS NULL UNION ALL SELECT NULL, NULL, NULL, NULL, reason FROM i WHERE reason IS NOT NULL",
    "k3_file_listing": "SELECT CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS total_bytes, FALSE AS any_accepted FROM customer",
    "v_low_confidence_amounts": f"WITH {CLEANED} "
    + " UNION ALL ".join(f"SELECT record_id, '{f}' AS field, round({c}_confidence, 9) AS exact, TRUE AS near FROM cleaned WHERE {c}_confidence < 0.70{_D} AND NOT {empty(f)}" for f, c in _amounts),
    "o3_date_positions": _keys + "SELECT record_id, row_number() OVER (ORDER BY key_year, key_month, key_day, record_id) AS position FROM k",
    "o5_field_positions": _keys + "SELECT record_id, row_number() OVER (ORDER BY prefix DESC, number DESC, year DESC, key_year DESC, key_month DESC, key_day DESC, record_id DESC) AS position FROM k",
    "f5_detail_confidences": f"WITH {RECORDS} SELECT record_id, {ISSUES} AS issues, duplicate_of, "
    + ", ".join(f"TRUE AS near_{c}" for c in _confidences) + ", " + ", ".join(f"round({c}, 9) AS {c}" for c in _confidences)
    + " FROM records WHERE record_id = (SELECT min(record_id) FROM records WHERE record_id % 7 = 3)",
}
