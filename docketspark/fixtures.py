"""Fixture views over the given tables: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sizing import cores, parts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")
AS_OF = "1999-06-30"

RECORDS_RAW = r"""
WITH base AS (
  SELECT o_orderkey AS record_id, o_custkey % 97 AS run_id, o_orderkey % 5 AS page_number,
         CASE CAST(o_orderkey % 16 AS INT) WHEN 0 THEN 'CRLA' WHEN 1 THEN 'CRL' WHEN 2 THEN 'CRLM' WHEN 3 THEN 'SC' WHEN 4 THEN 'WP'
           WHEN 5 THEN 'WMP' WHEN 6 THEN 'OS' WHEN 7 THEN 'AS' WHEN 8 THEN 'SA' WHEN 9 THEN 'MFA' WHEN 10 THEN 'IA' WHEN 11 THEN 'RFA'
           WHEN 12 THEN 'CRL.A' WHEN 13 THEN 'CRL.M.P' WHEN 14 THEN 'XYZ' ELSE 'SC' END AS prefix,
         CAST(o_custkey % 120 AS STRING) AS num, CAST(year(o_orderdate) AS STRING) AS yr,
         lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd,
         c_name, replace(n_name, '_', ' ') AS n_name, o_orderkey, o_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)
SELECT record_id, run_id, page_number,
  CASE CAST(o_orderkey % 23 AS INT) WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN prefix || '|' || num || '|' || yr
    WHEN 3 THEN '  ' || prefix || ' / ' || num || ' / ' || yr || ' ' WHEN 4 THEN lower(prefix) || '/' || num || '/' || yr
    WHEN 5 THEN prefix || '/' || replace(num, '0', 'O') || '/' || yr WHEN 6 THEN prefix || '/' || replace(num, '1', 'I') || '/' || yr
    WHEN 7 THEN prefix || chr(92) || num || chr(92) || yr WHEN 8 THEN prefix || '/' || num ELSE prefix || '/' || num || '/' || yr END AS raw_case_number,
  CASE CAST(o_orderkey % 19 AS INT) WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN dd || '/' || mm || '/' || yr WHEN 3 THEN dd || mm || yr
    WHEN 4 THEN replace(dd || '-' || mm || '-' || yr, '0', 'O') WHEN 5 THEN '31-02-' || yr WHEN 6 THEN dd || '-' || mm || '-1949'
    WHEN 7 THEN dd || '.' || mm || '.' || yr WHEN 8 THEN dd || ' ' || mm || ' ' || yr WHEN 9 THEN dd || '-' || mm || '-2099'
    ELSE dd || '-' || mm || '-' || yr END AS raw_hearing_date,
  CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN '-' WHEN 1 THEN c_name || '  VS. ' || n_name WHEN 2 THEN 'ab' WHEN 3 THEN replace(c_name, '#', ' ') || ' vs.' || n_name
    ELSE replace(c_name, '#', ' ') || ' vs ' || n_name END AS raw_party_name,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '-' WHEN 1 THEN 'x' WHEN 2 THEN 'Thiru. ' || n_name || ',  adpp.' WHEN 3 THEN n_name || ' app.X'
    ELSE 'Thiru. ' || n_name END AS raw_advocate,
  CAST(o_orderkey % 41 AS DOUBLE) / 40 AS case_number_confidence, CAST(o_orderkey % 37 AS DOUBLE) / 36 AS date_confidence,
  CAST(o_custkey % 31 AS DOUBLE) / 30 AS party_name_confidence, CAST(o_custkey % 29 AS DOUBLE) / 28 AS advocate_confidence
FROM base
"""

REGIONS_FLAT = r"""
WITH l AS (
  SELECT l_orderkey AS image_id, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate, c.col
  FROM lineitem CROSS JOIN (SELECT 0 AS col UNION ALL SELECT 1 AS col UNION ALL SELECT 2 AS col UNION ALL SELECT 3 AS col) c
  UNION ALL
  SELECT o_orderkey, 0, 0, 0, 0.0, o_orderdate, c.col FROM orders
  CROSS JOIN (SELECT 0 AS col UNION ALL SELECT 1 AS col UNION ALL SELECT 2 AS col UNION ALL SELECT 3 AS col) c WHERE o_orderkey % 10 <> 0
)
SELECT image_id,
  CAST(row_number() OVER (PARTITION BY image_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, col) AS BIGINT) AS region_idx,
  CASE WHEN l_linenumber = 0 THEN CASE CAST(col AS INT) WHEN 0 THEN 'Case Number' WHEN 1 THEN 'Hearing Date' WHEN 2 THEN 'Party' ELSE 'Advocate' END
       WHEN col = 0 THEN 'SC/' || CAST(l_partkey % 300 AS STRING) || '/' || CAST(year(l_shipdate) AS STRING)
       WHEN col = 1 THEN lpad(CAST(day(l_shipdate) AS STRING), 2, '0') || '-' || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') || '-' || CAST(year(l_shipdate) AS STRING)
       WHEN col = 2 THEN 'Part ' || CAST(l_partkey AS STRING) || ' vs Supplier ' || CAST(l_suppkey AS STRING) ELSE '-' END AS text,
  CAST((l_partkey + col * 7) % 51 AS DOUBLE) / 50 AS confidence,
  col * 200 + CAST(l_partkey % 9 AS DOUBLE) AS x_min, l_linenumber * 60 + CAST(l_suppkey % 5 AS DOUBLE) AS y_min,
  col * 200 + 150 + CAST(l_partkey % 9 AS DOUBLE) AS x_max, l_linenumber * 60 + 30 + CAST(l_suppkey % 5 AS DOUBLE) AS y_max
FROM l
"""

REGIONS_SECONDARY = f"""
WITH r AS ({REGIONS_FLAT})
SELECT image_id, region_idx,
  CASE WHEN (image_id + region_idx) % 3 = 0 THEN upper(text) WHEN (image_id + region_idx) % 5 = 0 THEN text || 'x' ELSE text END AS text,
  CAST((image_id + 3 * region_idx) % 51 AS DOUBLE) / 50 AS confidence, x_min, y_min, x_max, y_max
FROM r WHERE (image_id + region_idx) % 4 <> 0
"""

REGIONS_HEADED = f"""
SELECT * FROM ({REGIONS_FLAT})
UNION ALL
SELECT o_orderkey AS image_id, CAST(9000 + k AS BIGINT) AS region_idx,
  CASE CAST((o_orderkey + k) % 6 AS INT) WHEN 0 THEN 'For Orders' WHEN 1 THEN 'Arguments (part)' WHEN 2 THEN 'for orders' WHEN 3 THEN 'Service Pending' WHEN 4 THEN 'Steps to' ELSE 'SC/1/2001' END AS text,
  CAST(0.9 AS DOUBLE) AS confidence, CAST(k * 200 AS DOUBLE) AS x_min, CAST(900 AS DOUBLE) AS y_min, CAST(k * 200 + 150 AS DOUBLE) AS x_max, CAST(930 AS DOUBLE) AS y_max
FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) n WHERE k <= o_orderkey % 4
"""

IMAGES_2X2 = r"""
SELECT p_partkey AS image_id, CAST(p_partkey % 256 AS BIGINT) AS a, CAST((p_partkey * 7) % 256 AS BIGINT) AS b, CAST(p_size * 5 AS BIGINT) AS c, CAST((p_partkey * p_size) % 256 AS BIGINT) AS d FROM part
"""

#: pixels of colour pictures, five wide and four high
PIXELS_5X4 = r"""
SELECT p_partkey AS image_id, y, x, CAST((p_partkey * (3 * x + 7 * y + 1) + p_size * 5) % 256 AS BIGINT) AS blue, CAST((p_partkey * (x + 2) + 31 * y * p_size) % 256 AS BIGINT) AS green, CAST((p_size * (11 * x + y) + p_partkey * y) % 256 AS BIGINT) AS red
FROM part CROSS JOIN (SELECT 0 AS y UNION ALL SELECT 1 AS y UNION ALL SELECT 2 AS y UNION ALL SELECT 3 AS y) h
CROSS JOIN (SELECT 0 AS x UNION ALL SELECT 1 AS x UNION ALL SELECT 2 AS x UNION ALL SELECT 3 AS x UNION ALL SELECT 4 AS x) w
"""

DOCUMENTS_META = r"""
SELECT doc_id, 'list_' || CAST(doc_id AS STRING) || CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jpeg'
    WHEN 4 THEN '.tiff' WHEN 5 THEN '.bmp' WHEN 6 THEN '.webp' WHEN 7 THEN '' ELSE '.tar.gz' END AS filename,
  n_chars * 20000 AS file_size
FROM documents
"""

FIELD_LINES = r"""
SELECT doc_id, split(text, chr(10)) AS lines, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'party' WHEN 1 THEN 'advocate' ELSE 'text' END AS field_type
FROM documents
"""

QUALITY_METRICS = r"""
SELECT p_partkey AS image_id, p_retailprice / 10 AS sharpness, CAST(p_size AS DOUBLE) * 1.5 AS contrast,
  CAST(p_partkey % 256 AS DOUBLE) AS brightness, CAST(p_partkey % 70 AS DOUBLE) / 100 AS noise
FROM part
"""


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture's rows over the tables in sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    if sql == RECORDS_RAW:  # each of its rows takes a hundred steps: dealt by the join's key to a stated number of tasks, which are not joined to one a core
        tables["orders"] = tables["orders"].repartition(max(cores(spark), parts(tables["orders"])), "o_custkey")
    if "lineitem" in tables:  # four boxes a row: dealt by image before they are made, which serves all steps
        n = parts(tables["lineitem"])
        tables |= {t: tables[t].repartition(n, f"{t[0]}_orderkey") for t in ("lineitem", "orders")}
    named = sql
    for t in tables:
        named = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", named)
    return spark.sql(named, **tables)


def regions(spark: SparkSession, sf_dir: str, sql: str = REGIONS_FLAT) -> DataFrame:
    """Fixture boxes with polygons."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x_min", "y_min", "x_max", "y_max"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    flat = view(spark, sf_dir, sql)
    return flat.select("image_id", "region_idx", "text", F.col("text").alias("raw_text"), "confidence", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("bounding_box"), F.lit("paddle").alias("engine"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray pictures of two by two pixels, as Spark's image reader hands pictures on."""
    pixels = view(spark, sf_dir, IMAGES_2X2)
    data = F.unhex(F.concat(*(F.lpad(F.hex(F.col(c)), 2, "0") for c in "abcd")))
    return pixels.select(F.struct(F.col("image_id").cast("string").alias("origin"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data")).alias("image"))


def colour_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pictures of five by four pixels, as Spark's image reader hands pictures on: rows of blue, green and red bytes."""
    pixels = view(spark, sf_dir, PIXELS_5X4)
    signs = F.concat(*(F.lpad(F.hex(F.col(c)), 2, "0") for c in ("blue", "green", "red")))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", signs.alias("signs"))))
    data = F.unhex(F.array_join(F.transform(ordered, lambda p: p["signs"]), ""))
    made = pixels.groupBy("image_id").agg(data.alias("data"))
    return made.select(F.struct(F.col("image_id").cast("string").alias("origin"), F.lit(4).alias("height"), F.lit(5).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), "data").alias("image"))
