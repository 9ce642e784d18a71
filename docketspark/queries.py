"""Registered queries of the record operators, each over whole fixture views of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import confidence as S
from .functions import dates as T
from .functions import text as C
from .functions.similarity import token_set_ratio
from .jobs import flows
from .operators import dedupe, image_quality, layout, merge, order, query, sizing, summary
from .sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _named(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def raw(spark: SparkSession, d: str) -> DataFrame:
    return fx.view(spark, d, fx.RECORDS_RAW)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return flows.clean_fields(raw(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return flows.score_records(raw(spark, d), fx.as_of())


def records(spark: SparkSession, d: str) -> DataFrame:
    return flows.finished_records(raw(spark, d), fx.as_of())


def rows(spark: SparkSession, d: str) -> DataFrame:
    return layout.rows_from_regions(fx.regions(spark, d))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares."""
    return f"{sizing.shared_folder(spark)}/{uuid.uuid4().hex}"


def no_amounts(messages: Column) -> Column:
    """Messages in one text; the amount of a low confidence is left out, as engines round its ties differently."""
    return F.regexp_replace(F.array_join(messages, "; "), r"Low OCR confidence: [0-9.]+", "Low OCR confidence")


def _add(name: str, make: Callable[[DataFrame], DataFrame], source: Query = raw) -> None:
    QUERIES[name] = lambda spark, d: make(source(spark, d))


def _column(name: str, column: Callable[[], Column], alias: str, source: Query = raw, key: str = "record_id") -> None:
    _add(name, lambda df: df.select(key, column().alias(alias)), source)


def _mod(n: int) -> Column:
    return F.col("record_id") % n == 0


# sources and sinks


@_named
def flagship_run_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(flows.run_report(raw(spark, d), fx.as_of()))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Means to nine digits: their last bits depend on the order of summing."""
    return df.withColumns({c: F.round(c, 9) for c in names or ("average_confidence",)})


@_named
def k1_regions(spark: SparkSession, d: str) -> DataFrame:
    flat = fx.regions(spark, d)
    boxes = F.transform(F.sort_array(F.collect_list(F.struct("region_idx", "text", "raw_text", "confidence", "bounding_box", "engine"))), lambda r: r.dropFields("region_idx"))
    return io.explode_regions(flat.groupBy("image_id").agg(boxes.alias("regions"))).select("image_id", "region_idx", "text", "confidence")


@_named
def k2_records_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    io.write_records(records(spark, d).drop("has_issues", "low_confidence"), path)
    back = io.read_records(spark, path)
    return back.select("record_id", "run_id", "case_number", "hearing_date", "overall_confidence", "confidence_level", "needs_review", "duplicate_of", no_amounts(F.col("validation_issues")).alias("issues"))


@_named
def k3_intake(spark: SparkSession, d: str) -> DataFrame:
    return io.intake(fx.view(spark, d, fx.DOCUMENTS_META))


@_named
def k4_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    columns = ["case_number", "hearing_date", "party_name", "advocate", "confidence_level", "needs_review", "is_duplicate", "absent", "validation_issues"]
    done = records(spark, d).withColumn("validation_issues", F.transform("validation_issues", lambda m: F.regexp_replace(m, r"Low OCR confidence: [0-9.]+", "Low OCR confidence")))
    return io.csv_rows(done, columns)


_add("k5_json_metadata", lambda df: io.json_metadata(df, "1999-06-30T00:00:00"))
_add("k6_html_rows", lambda df: io.html_rows(df, include_confidence=False), scored)
_add("k7_audit_trail", io.audit_trail, cleaned)

# filters and projections

_add("f1_case_number_filter", lambda df: query.filter_case_number(df, "a/1_/").select("record_id", "case_number"), cleaned)
_add("f2_level_filter", lambda df: query.filter_level(df, "LOW").select("record_id", "confidence_level"), scored)
_add("f3_review_filter", lambda df: query.filter_review(df, False).select("record_id", "needs_review"), scored)
_add("f4_list_view", lambda df: query.list_view(df).drop("overall_confidence"), scored)


@_named
def f5_detail(spark: SparkSession, d: str) -> DataFrame:
    """The first record whose id leaves 3 of 7."""
    done = records(spark, d)
    first = raw(spark, d).where("record_id % 7 = 3").agg(F.min("record_id")).first()[0]
    return query.detail(done, first).select("record_id", "case_number", "hearing_date", "party_name", "advocate", "confidence_level", "needs_review", "is_duplicate", "validation_passed", "page_number")


_column("f6_minimum", query.has_minimum, "complete", cleaned)
_add("f7_review_queue", lambda df: query.review_queue(df).withColumn("reason", F.regexp_replace("reason", r"Low OCR confidence: [0-9.]+", "Low OCR confidence")), scored)
_add("f8_cell_lookup", lambda df: layout.cell_lookup(layout.parse_cells(df), 2, 1).select("image_id", "row_idx", "col_idx", "content"), rows)

# case numbers and names

_column("c1_normalize_case_number", lambda: C.normalize_case_number(F.col("raw_case_number")), "normalized")


@_named
def c2_parse_case_number(spark: SparkSession, d: str) -> DataFrame:
    out = raw(spark, d).select("record_id", C.parse_case_number(F.col("raw_case_number")).alias("p")).select("record_id", "p.*")
    return out.withColumn("number", F.col("number").cast("long"))


_column("c3_valid_case_number", lambda: C.valid_case_number(C.parse_case_number(F.col("raw_case_number"))), "valid")
_column("c4_correct_case_number", lambda: C.correct_case_number(F.col("raw_case_number")), "corrected")
_column("c5_join_multiline", lambda: C.join_multiline(F.col("lines")), "joined", lambda s, d: fx.view(s, d, fx.FIELD_LINES), "doc_id")
_column("c6_clean_party_name", lambda: C.clean_party_name(F.col("raw_party_name")), "party_name")
_column("c7_clean_advocate_name", lambda: C.clean_advocate_name(F.col("raw_advocate")), "advocate")
_column("c8_special_chars", lambda: C.normalize_special_chars(F.col("text")), "normalized", lambda s, d: s.read.parquet(f"{d}/documents.parquet"), "doc_id")
_column("c9_is_dash", lambda: C.is_dash(F.col("raw_party_name")), "dash")
_column("c10_valid_text", lambda: C.is_valid_text(F.col("raw_advocate")), "valid")
_column("c11_process_multiline", lambda: C.process_multiline(F.col("lines"), F.col("field_type")), "value", lambda s, d: fx.view(s, d, fx.FIELD_LINES).where("field_type = 'text'"), "doc_id")
# the same over all three types of field; its SQL spells the Unicode borders of words out, as DuckDB's own are ASCII
_column("c11_process_multiline_all", lambda: C.process_multiline(F.col("lines"), F.col("field_type")), "value", lambda s, d: fx.view(s, d, fx.FIELD_LINES), "doc_id")
_column("c12_natural_sort_key", lambda: F.array_join(F.flatten(F.transform(C.natural_sort_key(F.col("party_name")), lambda k: F.filter(F.array(F.nullif(k["s"], F.lit("")), k["n"].cast("string")), lambda x: x.isNotNull()))), "|"), "key", cleaned)

# dates


@_named
def t1_parse_date(spark: SparkSession, d: str) -> DataFrame:
    out = raw(spark, d).select("record_id", T.parse_date(F.col("raw_hearing_date")).alias("p")).select("record_id", "p.*")
    return out.drop("raw_text")


@_named
def t2_valid_date_parts(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    parts = ((F.col("o_orderkey") % 33), (F.col("o_custkey") % 14), (1940 + F.col("o_orderkey") % 170))
    return orders.select("o_orderkey", T.valid_date_parts(*(p.cast("int") for p in parts)).alias("valid"))


@_named
def t3_logical_date(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.is_logical_date(F.col("o_orderdate").cast("date"), fx.as_of()).alias("logical"))


_column("t4_correct_date", lambda: T.correct_date(F.col("raw_hearing_date")), "corrected")


def _date_key(c: str) -> list[Column]:
    key = T.date_sort_key(F.col(c))
    return [key[p].alias(f"key_{p}") for p in ("year", "month", "day")]


_add("t5_date_sort_key", lambda df: df.select("record_id", *_date_key("raw_hearing_date")))

# validation and confidence


def _check(name: str, field: str) -> None:
    def make(df: DataFrame) -> DataFrame:
        v = df.select("record_id", flows.field_results(fx.as_of())[field].alias("v"))
        return v.select("record_id", "v.status", "v.confidence", F.regexp_replace(F.array_join("v.messages", "|"), r"Low OCR confidence: [0-9.]+", "Low OCR confidence").alias("messages"), "v.requires_review")

    _add(name, make, cleaned)


for _name, _field in (("v1_validate_case_number", "case_number"), ("v2_validate_date", "hearing_date"), ("v3_validate_party_name", "party_name"), ("v4_validate_advocate", "advocate")):
    _check(_name, _field)
_add("v5_validate_records", lambda df: flows.validate_records(df, fx.as_of()).select("record_id", no_amounts(F.col("validation_issues")).alias("issues"), "validation_passed", "has_issues"), cleaned)


@_named
def s1_record_confidence(spark: SparkSession, d: str) -> DataFrame:
    checked = flows.validate_records(cleaned(spark, d), fx.as_of())
    score = S.record_confidence(*(F.col(f"{c}_confidence") for c in ("case_number", "date", "party_name", "advocate")), F.col("validation_issues"))
    return checked.select("record_id", score.alias("s")).select("record_id", "s.overall", "s.level", F.col("s.needs_review").alias("low"), F.col("s.case_number").alias("case_share"), F.col("s.advocate").alias("advocate_share"))


_add("s2_assess_records", lambda df: flows.assess_records(df.drop("party_name_confidence", "advocate_confidence")).select("record_id", "overall_confidence", "confidence_level", "needs_review"))
_column("s3_field_confidence", lambda: S.field_confidence(F.col("date_confidence"), _mod(2), _mod(3), F.col("party_name_confidence")), "score")
_column("s4_case_number_confidence", lambda: S.case_number_confidence(F.col("case_number_confidence"), _mod(2), _mod(3), _mod(5)), "score")
_column("s5_date_confidence", lambda: S.date_confidence(F.col("date_confidence"), _mod(2), _mod(3), _mod(5)), "score")
_column("s6_text_field_confidence", lambda: S.text_field_confidence(F.col("party_name_confidence"), _mod(2), _mod(3)), "score")


@_named
def s7_weighted_confidence(spark: SparkSession, d: str) -> DataFrame:
    score = S.weighted_confidence(*(F.col(f"{c}_confidence") for c in ("case_number", "date", "party_name", "advocate")))
    return raw(spark, d).select("record_id", score.alias("score"), S.field_level(score).alias("level"))


_column("s8_display_level", lambda: S.display_level(F.col("case_number_confidence")), "badge")
_column("s9_image_quality_score", lambda: S.image_quality_score(*(F.col(c) for c in ("sharpness", "contrast", "brightness", "noise"))), "score", lambda s, d: fx.view(s, d, fx.QUALITY_METRICS), "image_id")

# layout

_add("l1_region_boxes", lambda df: layout.region_boxes(df).select("image_id", "region_idx", *layout.BOX), fx.regions)
_add("l2_cluster_rows", lambda df: layout.cluster_rows(layout.region_boxes(df)).select("image_id", "region_idx", "row_idx"), fx.regions)
_add("l3_order_row_items", lambda df: layout.order_row_items(layout.cluster_rows(layout.region_boxes(df))).select("image_id", "region_idx", "row_idx", "pos"), fx.regions)
_add("l4_rows_from_regions", lambda df: df.select("image_id", "region_idx", "row_idx", "pos", "text", "confidence"), rows)
_add("l5_column_boundaries", lambda df: layout.column_boundaries(layout.region_boxes(df)).select("image_id", F.array_join("boundaries", ",").alias("boundaries")), fx.regions)


@_named
def l6_assign_columns(spark: SparkSession, d: str) -> DataFrame:
    boxes = layout.region_boxes(fx.regions(spark, d))
    return layout.assign_columns(boxes).select("image_id", "region_idx", "col")


_add("l7_organize_columns", lambda df: layout.organize_columns(df).select("image_id", "region_idx", "row_idx", "col"), rows)
_add("l8_header_row", layout.detect_header_row, rows)
_add("l9_column_headers", lambda df: layout.column_headers(df).select("image_id", "header_row_idx", F.array_join("column_headers", "|").alias("headers")), rows)
_add("l10_parse_cells", lambda df: layout.parse_cells(df).drop("raw_ocr"), rows)
_add("l11_section_headings", layout.section_headings, rows)
_add("l12_cells_to_records", lambda df: layout.cells_to_records(df).drop("date_confidence", "party_name_confidence", "advocate_confidence"), rows)

# joins, duplicates


@_named
def j1_merge_ocr(spark: SparkSession, d: str) -> DataFrame:
    merged = merge.merge_ocr(fx.regions(spark, d), fx.regions(spark, d, fx.REGIONS_SECONDARY), dealt=True)
    return merged.select("image_id", "region_idx", "text", "confidence", "engine", "source")


_add("d0_token_set_ratio", lambda df: df.select("record_id", token_set_ratio(F.col("raw_party_name"), F.col("party_name")).alias("ratio")), cleaned)
_add("j2_similar_records", dedupe.similar_record_groups, cleaned)
_add("j3_similar_case_numbers", dedupe.similar_case_numbers, cleaned)


@_named
def j4_records_of_documents(spark: SparkSession, d: str) -> DataFrame:
    all_records = raw(spark, d)
    runs = all_records.select("run_id").distinct().withColumn("document_id", F.col("run_id"))
    return merge.records_of_documents(fx.view(spark, d, fx.DOCUMENTS_META), runs, all_records).select("record_id", "run_id", "doc_id", "filename")


_add("d1_duplicate_case_numbers", dedupe.duplicate_case_numbers, cleaned)
_add("d2_unique_case_numbers", dedupe.unique_case_numbers, cleaned)
_add("d3_mark_duplicates", lambda df: df.select("record_id", "is_duplicate", "duplicate_of"), records)
_add("d4_duplicate_sources", lambda df: dedupe.duplicate_sources(df, "run_id").select("case_number", "count", F.array_join("sources", ",").alias("sources")), cleaned)
_add("d5_duplicate_candidates", dedupe.duplicate_candidates, cleaned)


@_named
def d6_handle_duplicates(spark: SparkSession, d: str) -> DataFrame:
    # worked out once for the three modes
    marked = sizing.materialize(records(spark, d).select("record_id", "needs_review", "is_duplicate"))
    parts = [dedupe.handle_duplicates(marked, m).select("record_id", F.lit(m).alias("mode"), "needs_review") for m in ("review", "remove_exact", "keep_all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# aggregates

_add("a1_page_text", lambda df: _rounded(summary.page_text(df), "overall_confidence"), fx.regions)
_add("a2_export_summary", lambda df: _rounded(summary.export_summary(df)), records)
_add("a3_run_stats", lambda df: _rounded(summary.run_stats(df)), records)
_add("a4_image_results", lambda df: summary.image_results(df, "page_number"), scored)
_add("a5_accuracy_report", summary.accuracy_report, records)
_add("a5_batch_totals", lambda df: summary.batch_totals(df, "page_number"), scored)


@_named
def a6_site_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.site_stats(spark.read.parquet(f"{d}/documents.parquet"), scored(spark, d)))


_add("a7_group_by_field", lambda df: summary.group_by_field(df, "hearing_date").unionByName(summary.group_by_field(df, "no_such_field")), cleaned)

# orders


def _case_key(c: str) -> list[Column]:
    key = order.case_sort_key(F.col(c))
    return [key["prefix"].alias("prefix"), key["number"].cast("long").alias("number"), key["year"].alias("year")]


_add("o1_case_sort_key", lambda df: df.select("record_id", *_case_key("raw_case_number")))
_add("o2_sort_by_case_number", lambda df: order.sort_by_case_number(df, reverse=True).select("record_id", *_case_key("case_number")), cleaned)
_add("o3_sort_by_date", lambda df: order.sort_by_date(df).select("record_id", *_date_key("hearing_date")), cleaned)
_add("o4_sort_by_party_name", lambda df: order.sort_by_party_name(df).select("record_id", "party_name"), cleaned)
_add("o5_sort_by_fields", lambda df: order.sort_by_fields(df, [("case_number", True), ("hearing_date", False)]).select("record_id", _case_key("case_number")[0], _date_key("hearing_date")[0]), cleaned)
_add("o6_sort_modes", lambda df: order.sort_by_mode(df, "number_only").select("record_id", _case_key("case_number")[1]), cleaned)
_add("o7_group_and_sort", lambda df: order.group_and_sort(df, "run_id").select("record_id", "group_value", "pos"), cleaned)
_add("o8_page", lambda df: order.page(df, 100, 40).select("record_id", "case_number"), cleaned)

# what the queries above leave out: headings that are there, confidences, positions in an order, words in common, images


def headed_rows(spark: SparkSession, d: str) -> DataFrame:
    return layout.rows_from_regions(fx.regions(spark, d, fx.REGIONS_HEADED))


_add("l11_headings_present", layout.section_headings, headed_rows)
_add("l12_records_without_headings", lambda df: layout.cells_to_records(df).drop("date_confidence", "party_name_confidence", "advocate_confidence"), headed_rows)
_add("f3_export_filter", lambda df: query.export_filter(df, "MEDIUM", True).select("record_id", "confidence_level", "needs_review"), scored)
_add("o2_case_number_positions", lambda df: order.with_position(df, order.mode_orders(), ["record_id", "case_number"]).select("record_id", "position"), cleaned)
_add("o4_party_name_positions", lambda df: order.with_position(df, [order.sort_key("party_name").asc(), F.col("record_id").asc()], ["record_id", "party_name"]).select("record_id", "position"), cleaned)
_add("o6_number_positions", lambda df: order.with_position(df, order.mode_orders("number_only"), ["record_id", "case_number"]).select("record_id", _case_key("case_number")[1], "position"), cleaned)
_add("o8_page_counts", order.page_counts, cleaned)
_add("a7_group_members", lambda df: summary.group_members(df.withColumn("page", F.col("page_number") * 1000 + F.col("run_id")), "page").withColumn("members", F.array_join("members", ",")), cleaned)
_add("d0_words_in_common", lambda df: df.select("record_id", (token_set_ratio(F.col("raw_party_name"), F.col("party_name")) == 100).alias("is_full")), cleaned)
_add("j2_equal_parties", lambda df: dedupe.similar_record_groups(df, threshold=1.0), cleaned)


@_named
def f4_list_view_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The exact confidence, and whether the list view's is within half of the fourth digit: engines round ties of it differently."""
    shown = query.list_view(scored(spark, d).withColumn("advocate", F.col("overall_confidence")))
    return shown.select("record_id", "case_number", F.round("advocate", 9).alias("exact"), (F.abs(F.col("overall_confidence") - F.col("advocate")) <= 0.00005000001).alias("near"))


@_named
def k6_html_rows_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their level and review cells, and whether the percentage cell is near: engines write ties of its second digit differently."""
    cell, tag = r"<td>(-?[0-9.]+)%</td>", r"~~([0-9]+)~~([^<]*)</td>"
    done = scored(spark, d).withColumn("advocate", F.concat_ws("~~", "advocate", "record_id", F.col("overall_confidence").cast("string")))
    found = lambda pattern, i: F.regexp_extract("value", pattern, i)
    near = F.abs(found(cell, 1).cast("double") - found(tag, 2).cast("double") * 100) <= 0.0050000001
    return io.html_rows(done).select(found(tag, 1).cast("long").alias("record_id"), F.regexp_replace(F.regexp_replace("value", cell, ""), tag, "</td>").alias("value"), near.alias("near"))


@_named
def s10_image_quality(spark: SparkSession, d: str) -> DataFrame:
    found = image_quality.image_quality_metrics(fx.images(spark, d))
    return found.select(F.col("origin").cast("long").alias("image_id"), *(F.round(c, 6).alias(c) for c in ("sharpness", "contrast", "brightness", "noise")))


@_named
def s10_colour_quality(spark: SparkSession, d: str) -> DataFrame:
    found = image_quality.image_quality_metrics(fx.colour_images(spark, d))
    return found.select(F.col("origin").cast("long").alias("image_id"), *(F.round(c, 6).alias(c) for c in ("sharpness", "contrast", "brightness", "noise")))


@_named
def k1_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Images written as JSON lines, some cut off or without an id, and read again: their boxes, and a row with a reason for each line that can't be read."""
    flat, path = fx.regions(spark, d), shared_folder(spark)
    boxes = F.transform(F.sort_array(F.collect_list(F.struct("region_idx", "text", "raw_text", "confidence", "bounding_box", "engine"))), lambda r: r.dropFields("region_idx"))
    images = flat.groupBy("image_id").agg(boxes.alias("regions"))
    whole = F.to_json(F.struct(F.when(F.col("image_id") % 11 != 0, F.col("image_id")).alias("image_id"), F.when(F.col("image_id") % 13 != 0, F.col("regions")).alias("regions")))
    images.select(F.when(F.col("image_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("value")).write.option("compression", "gzip").text(path)
    regions, rejected = io.region_lines(spark, path)
    nothing = lambda kind: F.lit(None).cast(kind)
    lost = rejected.select(nothing("long").alias("image_id"), nothing("long").alias("region_idx"), nothing("string").alias("text"), nothing("double").alias("confidence"), "reason")
    return regions.select("image_id", "region_idx", "text", "confidence", nothing("string").alias("reason")).unionByName(lost)


@_named
def k3_file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of files with customers' names, listed without reading them; their extension is none that the intake takes."""
    path = shared_folder(spark)
    spark.read.parquet(f"{d}/customer.parquet").select("c_name").write.text(path)
    return io.intake(io.list_files(spark, path)).agg(F.sum("file_size").alias("total_bytes"), F.bool_or("accepted").alias("any_accepted"))


@_named
def v_low_confidence_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Each confidence that a message names: the exact one, and whether the amount is within half of its second digit, as engines round ties differently."""
    named = cleaned(spark, d)
    fields = (("case_number", "case_number"), ("hearing_date", "date"), ("party_name", "party_name"), ("advocate", "advocate"))
    results = flows.field_results(fx.as_of())
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"{c}_confidence").alias("exact"), F.regexp_extract(F.array_join(results[f]["messages"], "|"), r"Low OCR confidence: ([0-9.]+)", 1).alias("amount")) for f, c in fields]
    told = named.select("record_id", F.explode(F.array(*rows)).alias("r")).select("record_id", "r.*").where("amount != ''")
    return told.select("record_id", "field", F.round("exact", 9).alias("exact"), (F.abs(F.col("amount").cast("double") - F.col("exact")) <= 0.0050000001).alias("near"))


_add("o3_date_positions", lambda df: order.with_position(df, [order.sort_key("hearing_date").asc(), F.col("record_id").asc()], ["record_id", "hearing_date"]).select("record_id", "position"), cleaned)
_add("o5_field_positions", lambda df: order.with_position(df, order.field_orders([("case_number", True), ("hearing_date", False)]), ["record_id", "case_number", "hearing_date"]).select("record_id", "position"), cleaned)


@_named
def f5_detail_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Of the record that f5_detail shows, the columns it leaves out: page, run, links and confidences within half of the fourth digit."""
    done = records(spark, d)
    first = raw(spark, d).where("record_id % 7 = 3").agg(F.min("record_id")).first()[0]
    shown = query.detail(done, first)
    near = [(F.abs(F.col(f"s.{c}") - F.col(f"r.{c}")) <= 0.00005000001).alias(f"near_{c}") for c in ("case_number_confidence", "date_confidence", "party_name_confidence", "advocate_confidence", "overall_confidence")]
    exact = [F.round(f"r.{c}", 9).alias(c) for c in ("case_number_confidence", "date_confidence", "party_name_confidence", "advocate_confidence", "overall_confidence")]
    return shown.alias("s").join(done.alias("r"), F.col("s.record_id") == F.col("r.record_id")).select("r.record_id", no_amounts(F.col("s.validation_issues")).alias("issues"), F.col("r.duplicate_of").alias("duplicate_of"), *near, *exact)
