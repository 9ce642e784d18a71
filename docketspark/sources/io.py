"""Reading regions, documents and records; writing records as tables, CSV, JSON, HTML rows and an audit trail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas

ALLOWED_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp")
MAX_FILE_BYTES = 50 * 1024 * 1024
#: fixed values: the columns of a CSV export
CSV_COLUMNS = (
    "case_number", "hearing_date", "party_name", "advocate", "case_number_confidence", "date_confidence", "party_name_confidence", "advocate_confidence",
    "overall_confidence", "confidence_level", "needs_review", "is_duplicate", "validation_issues",
)
FORMAT_VERSION = "1.0"
#: an image a line, with its boxes
IMAGE_LINE = "image_id bigint, regions array<struct<text: string, raw_text: string, confidence: double, bounding_box: array<struct<x: double, y: double>>, engine: string>>"
#: connections to a database that are open together
CONNECTIONS = 8


def read_regions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """One row for each text box; JSON input has one image a line with its boxes as a list."""
    if kind == "parquet":
        return spark.read.schema(schemas.REGIONS).parquet(path)
    return explode_regions(spark.read.schema(IMAGE_LINE).json(path))


def region_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(regions, rejected) of JSON lines, one image each: rejected has line and reason, so that no line is lost or read as nulls.

    A line is rejected that is no JSON object of these fields (cut off, of another type), names no image, or has no list of boxes.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line").where("line != ''")
    schema = f"{IMAGE_LINE}, _damaged string"
    read = lines.withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}))
    damaged = F.col("r").isNull() | F.col("r._damaged").isNotNull()
    reason = F.when(damaged, "not readable").when(F.col("r.image_id").isNull(), "no image").when(F.col("r.regions").isNull(), "no boxes")
    told = read.withColumn("reason", reason)
    return explode_regions(told.where("reason is null").select("r.image_id", "r.regions")), told.where("reason is not null").select("line", "reason")


def explode_regions(images: DataFrame) -> DataFrame:
    """(image_id, region_idx, box fields) of images with a list of boxes."""
    return images.select("image_id", F.posexplode("regions").alias("region_idx", "r")).select("image_id", F.col("region_idx").cast("long").alias("region_idx"), "r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RECORDS).parquet(path)


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, a folder for each run, dealt by run so that a task writes few files."""
    records.hint("rebalance", F.col("run_id")).write.mode(mode).partitionBy("run_id").parquet(path)


def write_jdbc(records: DataFrame, url: str, table: str, mode: str = "append", connections: int = CONNECTIONS, **options: str) -> None:
    """The records table of a database; issue lists as JSON text.

    "overwrite" empties the table, which keeps its definition, and so may be repeated when a write was broken off; "append" adds rows each time.
    """
    arrays = [f for f, t in records.dtypes if t.startswith("array")]
    rows = records.withColumns({c: F.to_json(c) for c in arrays}).coalesce(connections)
    rows.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode(mode).save()


def read_jdbc(spark: SparkSession, url: str, table: str, column: str = "record_id", parts: int = CONNECTIONS, quote: str = '"', **options: str) -> DataFrame:
    """The records table of a database, read in parts by ranges of a whole number column; issue lists as arrays.

    The database finds the bounds; rows beyond them, written meanwhile, and nulls are in the first and last part. quote is
    the database's sign around names.
    """
    source = spark.read.format("jdbc").options(url=url, **options)
    low, high = source.option("query", f"SELECT min({quote}{column}{quote}) AS low_, max({quote}{column}{quote}) AS high_ FROM {table}").load().first()
    if low is not None:
        source = spark.read.format("jdbc").options(url=url, partitionColumn=column, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts), **options)
    rows = source.option("dbtable", table).load()
    lists = [f.name for f in StructType.fromDDL(schemas.RECORDS) if f.dataType.simpleString() == "array<string>"]
    names = {c.lower(): c for c in rows.columns}
    return rows.withColumns({names[c]: F.from_json(F.col(names[c]), "array<string>") for c in lists if c in names}).toDF(*(c.lower() for c in rows.columns))


def intake(files: DataFrame) -> DataFrame:
    """files(filename, file_size) with accepted, reject_reason and status; the extension follows the last dot, in any case."""
    extension = F.lower(F.element_at(F.split("filename", r"\."), -1))
    typed = F.coalesce(F.contains("filename", F.lit(".")) & extension.isin(*ALLOWED_EXTENSIONS), F.lit(False))
    fits = F.coalesce(F.col("file_size") <= MAX_FILE_BYTES, F.lit(False))
    out = files.drop("accepted", "reject_reason", "status").withColumn("accepted", typed & fits)
    return out.withColumn("reject_reason", F.when(~typed, "file type").when(~fits, "file size")).withColumn("status", F.when(F.col("accepted"), "PENDING"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, file_size) of a folder, contents unread; Spark leaves out files without a byte."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"))


def _text(records: DataFrame, name: str) -> Column:
    """A CSV field: lists joined, flags as True and False, null empty."""
    kind = dict(records.dtypes)[name]
    if kind.startswith("array"):
        return F.array_join(F.col(name).cast("array<string>"), "; ")
    return F.when(F.col(name), "True").when(~F.col(name), "False") if kind == "boolean" else F.col(name).cast("string")


def csv_rows(records: DataFrame, columns: Sequence[str] | None = None, all_columns: bool = False) -> DataFrame:
    """The fields of a CSV export as texts: the given columns, or all by name, or the standard ones; absent columns are dashes."""
    names = list(columns) if columns else sorted(records.columns) if all_columns else list(CSV_COLUMNS)
    return records.select(*((_text(records, n) if n in records.columns else F.lit("-")).alias(n) for n in names))


def export_csv(records: DataFrame, path: str, columns: Sequence[str] | None = None, all_columns: bool = False) -> None:
    """Part files with a header line each and CR LF line ends; no rows, no files."""
    rows = csv_rows(records, columns, all_columns)
    quote = lambda c: F.when(c.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    if rows.isEmpty():
        return
    lines = rows.select(F.array_join(F.array(*(quote(F.col(n)) for n in rows.columns)), ",").alias(",".join(rows.columns)))
    lines.write.option("header", True).option("lineSep", "\r\n").option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(path)


def export_json(records: DataFrame, path: str, exported_at: str) -> None:
    """One object a line under records, and one line of metadata beside them."""
    records.write.json(f"{path}/records")
    json_metadata(records, exported_at).coalesce(1).write.json(f"{path}/metadata")


def json_metadata(records: DataFrame, exported_at: str) -> DataFrame:
    return records.agg(F.lit(exported_at).alias("exported_at"), F.count("*").alias("total_records"), F.lit(FORMAT_VERSION).alias("format_version"))


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def html_rows(records: DataFrame, escape: bool = True, include_confidence: bool = True) -> DataFrame:
    """(value): a table row of HTML for each record; escape=False leaves values as they are."""
    field = lambda c: (_escaped if escape else lambda x: x)(F.coalesce(c, F.lit("None"))) if c in records.columns else F.lit("-")
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in records.columns else F.lit(False)
    parts = [F.when(review, "<tr class='review'>").otherwise("<tr>")]
    parts += [F.concat(F.lit("<td>"), field(c), F.lit("</td>")) for c in ("case_number", "hearing_date", "party_name", "advocate")]
    if include_confidence:
        level = F.coalesce("confidence_level", F.lit("UNKNOWN")) if "confidence_level" in records.columns else F.lit("UNKNOWN")
        score = F.coalesce("overall_confidence", F.lit(0.0)) if "overall_confidence" in records.columns else F.lit(0.0)
        parts += [
            F.format_string("<td>%.2f%%</td>", score * 100),
            F.concat(F.lit("<td><span class='"), F.lower(level), F.lit("'>"), F.upper(level), F.lit("</span></td>")),
            F.when(review, "<td>Yes</td>").otherwise("<td>No</td>"),
        ]
    return records.select(F.concat(*parts, F.lit("</tr>")).alias("value"))


def export_html(records: DataFrame, path: str, escape: bool = True) -> None:
    html_rows(records, escape).write.text(path)


def audit_trail(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(id, field, raw_text, final_text, confidence, requires_review): four rows a record."""
    fields = (("case_number", "case_number"), ("hearing_date", "date"), ("party_name", "party_name"), ("advocate", "advocate"))
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"raw_{f}").alias("raw_text"), F.col(f).alias("final_text"), F.col(f"{c}_confidence").alias("confidence"), (F.col(f"{c}_confidence") < 0.70).alias("requires_review")) for f, c in fields]
    return records.select(id_col, F.explode(F.array(*rows)).alias("r")).select(id_col, "r.*")
