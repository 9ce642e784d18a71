"""Text boxes of page images to rows, columns, cells and records.

All work is per image: every window and aggregation has image_id in its key, and from boxes to records there are no joins,
so the boxes are read once and one exchange by image_id serves all steps. A box is known by (image_id, region_idx); region_idx ascending is the reading order of the OCR engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import process_line, strip

#: fixed values: words of header rows and phrases of section headings
HEADER_KEYWORDS = ("Case", "Number", "Party", "Advocate", "Sr", "No", "Date", "Hearing")
SECTION_PHRASES = ("Arguments", "Judgement", "For Orders", "Await Records", "For Further Proceedings", "Admission", "CMP Pending", "Service Pending", "Steps", "For Hearing", "Disposal")
BOX = ("x_min", "y_min", "x_max", "y_max")
#: the same in the order of cluster_rows
SAME = ("y_min", "x_min", "x_max", "y_max")
FIELDS = ("case_number", "hearing_date", "party_name", "advocate")


def region_boxes(regions: DataFrame) -> DataFrame:
    """regions with the integer borders of their polygons (fractions cut off); regions without a polygon go."""
    xs, ys = F.col("bounding_box.x"), F.col("bounding_box.y")
    out = regions.where(F.col("bounding_box").isNotNull())
    return out.withColumns({n: f(v).cast("int") for n, f, v in (("x_min", F.array_min, xs), ("y_min", F.array_min, ys), ("x_max", F.array_max, xs), ("y_max", F.array_max, ys))})


def cluster_rows(boxes: DataFrame, vertical_threshold: int = 20) -> DataFrame:
    """boxes with row_idx: a row ends where the next box begins more than the threshold below all boxes above it.

    Boxes of one y_min are of one row, in whichever order, unless the threshold is negative; they are put in that of their borders, so that
    identical boxes stand together and need no sort of their own.
    """
    order = Window.partitionBy("image_id").orderBy(*(SAME if vertical_threshold >= 0 else ("y_min",)), "region_idx")
    above = F.max("y_max").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("y_min") - above > vertical_threshold).cast("long"), F.lit(0))
    return boxes.withColumn("_new", new).withColumn("row_idx", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def order_row_items(rows: DataFrame) -> DataFrame:
    """rows with pos, the place from left to right in the row."""
    order = Window.partitionBy("image_id", "row_idx").orderBy("x_min", "y_min", "region_idx")
    return rows.withColumn("pos", F.row_number().over(order).cast("long") - 1)


def rows_from_regions(regions: DataFrame, vertical_threshold: int = 20, same_box: str = "last") -> DataFrame:
    """Boxes in rows and order; of identical boxes in one image, the last one's values stand for all ("keep": each its own)."""
    if same_box not in ("last", "keep"):
        raise ValueError(f"same_box: {same_box}")
    rows = cluster_rows(region_boxes(regions), vertical_threshold)  # first, as it deals the boxes by image alone
    if same_box == "last":
        values = [c for c in ("text", "raw_text", "confidence", "engine") if c in rows.columns]
        same = Window.partitionBy("image_id", *SAME).orderBy("region_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({c: F.last(c).over(same) for c in values})
    return order_row_items(rows)


def _boundaries(xs: Column, gap: int) -> Column:
    """Of borders in order, those more than gap beyond the one taken before."""
    far = lambda a, x: F.when((F.size(a) == 0) | (x - F.get(a, F.size(a) - 1) > gap), F.array_append(a, x)).otherwise(a)
    return F.aggregate(xs, F.array().cast("array<int>"), far)


def column_boundaries(boxes: DataFrame, gap: int = 30) -> DataFrame:
    """(image_id, width, boundaries): left and right borders in order, each more than gap beyond the boundary before it."""
    xs = F.sort_array(F.flatten(F.collect_list(F.array("x_min", "x_max"))))
    return boxes.groupBy("image_id").agg(xs.alias("xs"), F.max("x_max").alias("width")).select("image_id", "width", _boundaries(F.col("xs"), gap).alias("boundaries"))


def _column_of(boundaries: Column, x_min: Column, x_max: Column) -> Column:
    """The column that holds the centre; null outside all columns."""
    centre = (x_min + x_max) / 2
    col = F.size(F.filter(boundaries, lambda v: v <= centre)) - 1
    return F.when((col >= 0) & (col < F.size(boundaries) - 1), col)


def _bounded(boxes: DataFrame, gap: int) -> DataFrame:
    """boxes with boundaries and width of their image, by windows; the fold over its borders is worked out for one box of each image."""
    image = Window.partitionBy("image_id")
    borders = F.collect_list(F.when(F.col("x_min").isNotNull(), F.array("x_min", "x_max"))).over(image)
    gathered = boxes.withColumn("_borders", borders).withColumn("width", F.max("x_max").over(image)).withColumn("_first", F.min("region_idx").over(image))
    found = F.when(F.col("region_idx").eqNullSafe(F.col("_first")), _boundaries(F.sort_array(F.flatten("_borders")), gap))
    one = gathered.withColumn("boundaries", found).drop("_borders", "_first")
    return one.withColumn("boundaries", F.first("boundaries", ignorenulls=True).over(image))


def assign_columns(boxes: DataFrame, boundaries: DataFrame | None = None, gap: int = 30) -> DataFrame:
    """boxes with col: the column that holds their centre; boxes outside all columns go.

    Without a table of boundaries, those of all boxes of an image, as ``column_boundaries`` finds them: no join.
    """
    bounded = _bounded(boxes, gap).drop("width") if boundaries is None else boxes.join(boundaries, "image_id")
    col = _column_of(F.col("boundaries"), F.col("x_min"), F.col("x_max"))
    return bounded.withColumn("col", col).where("col is not null").drop("boundaries")


def organize_columns(rows: DataFrame, expected: int = 4, gap: int = 30) -> DataFrame:
    """rows with col by the boundaries of all boxes; an image with fewer than two gets equal parts of its width.

    Boundaries come by windows over the image: no join, and no exchange where rows are dealt by image already.
    """
    equal = F.transform(F.sequence(F.lit(0), F.lit(expected)), lambda i: i * F.col("width") / expected)
    bounds = F.when(F.size("boundaries") < 2, equal).otherwise(F.col("boundaries").cast("array<double>"))
    placed = _bounded(rows, gap).withColumn("col", _column_of(bounds, F.col("x_min"), F.col("x_max")))
    return placed.where("col is not null").select(*rows.columns, "col")


def _keywords(text: Column) -> Column:
    """The header words in a text as bits; they have no space, so those of a row are the bits of its boxes."""
    return sum((F.contains(F.lower(text), F.lit(k.lower())).cast("int") * (1 << i) for i, k in enumerate(HEADER_KEYWORDS)), F.lit(0))


def _is_header(bits: Column) -> Column:
    return F.bit_count(bits) >= 2


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _at(place: int, value: Column) -> Column:
    return F.max(F.when(F.col("pos") == place, value))


def _headed(rows: DataFrame) -> DataFrame:
    """rows with _header, the image's header row, by windows alone."""
    out = rows.withColumn("_bits", F.bit_or(_keywords(_text())).over(Window.partitionBy("image_id", "row_idx")))
    header = F.min(F.when(_is_header(F.col("_bits")), F.col("row_idx"))).over(Window.partitionBy("image_id"))
    return out.withColumn("_header", F.coalesce(header, F.lit(0)).cast("long")).drop("_bits")


def _has_phrase(line: Column) -> Column:
    found = F.lit(False)
    for p in SECTION_PHRASES:
        found = found | F.contains(line, F.lit(p))
    return found


def _is_heading(n: Column, first: Column, second: Column) -> Column:
    """Whether a row of n boxes, of which these are the first texts, is a section heading."""
    return F.when(n == 1, _has_phrase(first)).when(n == 2, _has_phrase(F.concat(first, F.lit(" "), second))).otherwise(False)


def _cells(headed: DataFrame, expected: int) -> DataFrame:
    raw = F.coalesce("raw_text", F.lit("")) if "raw_text" in headed.columns else F.lit("")
    cells = headed.where((F.col("row_idx") != F.col("_header")) & (F.col("pos") < expected))
    return cells.select("image_id", "row_idx", F.col("pos").alias("col_idx"), strip(_text()).alias("content"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), raw.alias("raw_ocr"))


def detect_header_row(rows: DataFrame) -> DataFrame:
    """(image_id, header_row_idx): the first row with two header words or more, else row 0."""
    lines = rows.groupBy("image_id", "row_idx").agg(F.bit_or(_keywords(_text())).alias("bits"))
    return lines.groupBy("image_id").agg(F.coalesce(F.min(F.when(_is_header(F.col("bits")), F.col("row_idx"))), F.lit(0)).cast("long").alias("header_row_idx"))


def column_headers(rows: DataFrame) -> DataFrame:
    """(image_id, header_row_idx, column_headers): the header row's texts, stripped, without empty ones."""
    header = _headed(rows).where(F.col("row_idx") == F.col("_header"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", strip(_text()).alias("text")))), lambda x: x["text"])
    return header.groupBy("image_id", F.col("_header").alias("header_row_idx")).agg(F.filter(texts, lambda t: t != "").alias("column_headers"))


def parse_cells(rows: DataFrame, expected: int = 4) -> DataFrame:
    """(image_id, row_idx, col_idx, content, confidence, raw_ocr): the first columns of all rows but the header."""
    return _cells(_headed(rows), expected)


def table_structure(rows: DataFrame, expected: int = 4) -> DataFrame:
    """(image_id, rows, cols, header_row_idx, column_headers) of each image."""
    counted = rows.groupBy("image_id").agg((F.max("row_idx") + 1).alias("rows"))
    return counted.join(column_headers(rows), "image_id").select("image_id", "rows", F.lit(expected).alias("cols"), "header_row_idx", "column_headers")


def section_headings(rows: DataFrame) -> DataFrame:
    """(image_id, row_idx) of rows of one or two boxes whose text has a heading's phrase."""
    lines = rows.groupBy("image_id", "row_idx").agg(F.count("*").alias("n"), _at(0, _text()).alias("first"), _at(1, _text()).alias("second"))
    return lines.where(_is_heading(F.col("n"), F.col("first"), F.col("second"))).select("image_id", "row_idx")


def cell_lookup(cells: DataFrame, row: int, col: int | None = None) -> DataFrame:
    """Cells of a row, or the first cell at (row, col) of each image."""
    if col is None:
        return cells.where(F.col("row_idx") == row)
    first = Window.partitionBy("image_id").orderBy("row_idx", "col_idx")
    return cells.where((F.col("row_idx") == row) & (F.col("col_idx") == col)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def cells_to_records(rows: DataFrame, expected: int = 4) -> DataFrame:
    """(image_id, row_idx, raw fields and their confidences) of the rows that are neither header nor heading.

    Columns are case number, date, party and advocate by position; a missing cell is a dash of confidence 0.
    """
    names = ("case_number", "date", "party_name", "advocate")
    # text and confidence in one: the fewer sums of texts there are, the less each box costs
    cell = F.struct(_text().alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    lines = rows.groupBy("image_id", "row_idx").agg(F.count("*").alias("_n"), F.bit_or(_keywords(_text())).alias("_bits"), *(_at(k, cell).alias(f"_{k}") for k in range(max(2, min(expected, len(FIELDS))))))
    header = F.min(F.when(_is_header(F.col("_bits")), F.col("row_idx"))).over(Window.partitionBy("image_id"))
    headed = lines.withColumn("_header", F.coalesce(header, F.lit(0)).cast("long"))
    wide = headed.where((F.col("row_idx") != F.col("_header")) & ~_is_heading(F.col("_n"), F.col("_0.text"), F.col("_1.text")))
    part = lambda k, c, kind: F.col(f"_{k}.{c}") if k < expected else F.lit(None).cast(kind)
    sure = [F.coalesce(part(k, "confidence", "double"), F.lit(0.0)).alias(f"{c}_confidence") for k, c in enumerate(names)]
    wide = wide.select("image_id", "row_idx", *(strip(part(k, "text", "string")).alias(f"_{f}") for k, f in enumerate(FIELDS)), *sure)
    kinds = ("text", "text", "party", "advocate")
    raw = [process_line(F.col(f"_{f}"), kind).alias(f"raw_{f}") for f, kind in zip(FIELDS, kinds, strict=True)]
    return wide.select("image_id", "row_idx", *raw, "case_number_confidence", "date_confidence", "party_name_confidence", "advocate_confidence")
