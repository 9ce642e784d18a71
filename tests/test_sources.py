"""Reading what may be damaged, databases read in parts and written again, colour pictures from files."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.operators import image_quality
from docketspark.sources import io


def test_lines_that_can_not_be_read_are_kept_with_a_reason(spark, tmp_path):
    box = {"text": "a", "raw_text": "a", "confidence": 0.5, "bounding_box": [{"x": 1, "y": 2}], "engine": "e"}
    lines = [json.dumps({"image_id": 1, "regions": [box, box]}), '{"image_id": 2, "regions": [', "no json", json.dumps({"regions": [box]}), json.dumps({"image_id": 3}), json.dumps({"image_id": "x", "regions": []}), "", json.dumps({"image_id": 4, "regions": []}), "[1, 2]"]
    (tmp_path / "lines.json").write_text("\n".join(lines) + "\n")
    regions, rejected = io.region_lines(spark, str(tmp_path / "lines.json"))
    assert [(r.image_id, r.region_idx, r.text) for r in regions.orderBy("region_idx").collect()] == [(1, 0, "a"), (1, 1, "a")]
    assert sorted((r.reason, r.line) for r in rejected.collect()) == sorted([("not readable", lines[1]), ("not readable", lines[2]), ("no image", lines[3]), ("no boxes", lines[4]), ("not readable", lines[5]), ("not readable", lines[8])])


def test_files_are_listed_unread(spark, tmp_path):
    for name, size in (("a.PDF", 10), ("b.txt", 3), ("c", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = {r.filename: (r.file_size, r.accepted) for r in io.intake(io.list_files(spark, str(tmp_path))).collect()}
    assert found == {"a.PDF": (10, True), "b.txt": (3, False)}


def test_database_round_trip(spark):
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver", True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception:
        pytest.skip("no database driver beside Spark")
    url = "jdbc:derby:memory:records;create=true"
    df = spark.range(1, 201).select(F.col("id").alias("record_id"), F.concat(F.lit("SC/"), F.col("id")).alias("case_number"), F.array(F.lit('a "quoted" one'), F.col("id").cast("string")).alias("validation_issues"))
    for _ in range(2):  # may be repeated
        io.write_jdbc(df, url, "records", mode="overwrite", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = io.read_jdbc(spark, url, "records", parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    io.write_jdbc(df, url, "records", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert io.read_jdbc(spark, url, "records", driver="org.apache.derby.jdbc.EmbeddedDriver").count() == 400


def bitmap(pixels):
    """A file of 24-bit colours, rows from the bottom up, each filled to four bytes."""
    h, w, _ = pixels.shape
    rows = b"".join(pixels[y].tobytes() + b"\0" * (-3 * w % 4) for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_colour_pictures_from_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    pictures = {f"p{k}.bmp": rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for k, (h, w) in enumerate([(4, 5), (1, 7), (6, 1), (30, 40)])}
    for name, pixels in pictures.items():
        (tmp_path / name).write_bytes(bitmap(pixels))
    (tmp_path / "broken.bmp").write_bytes(b"BM not a picture")
    got = {r.origin.split("/")[-1]: r for r in image_quality.image_quality_metrics(spark.read.format("image").load(str(tmp_path))).collect()}
    assert got.keys() == pictures.keys()
    for name, pixels in pictures.items():
        gray = [[int(0.299 * r + 0.587 * g + 0.114 * b + 0.5) for b, g, r in row] for row in pixels.tolist()]
        h, w = len(gray), len(gray[0])
        at = lambda y, x: gray[mirrored(y, h)][mirrored(x, w)]  # noqa: B023, E731
        edges = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
        flat = [v for row in gray for v in row]
        r = got[name]
        assert np.allclose((r.sharpness, r.contrast, r.brightness, r.noise), (np.var(edges), np.std(flat), np.mean(flat), np.mean(np.abs(edges)) / 255))


def mirrored(i, n):
    return 0 if n == 1 else -i if i < 0 else 2 * (n - 1) - i if i >= n else i
