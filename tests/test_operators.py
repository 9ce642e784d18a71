"""Operators against small independent models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docketspark import fixtures as fx
from docketspark.functions.similarity import token_set_ratio_of
from docketspark.jobs import flows
from docketspark.operators import dedupe, image_quality, layout, merge, order, query, summary
from docketspark.sources import io

BOX = "image_id long, region_idx long, text string, confidence double, bounding_box array<struct<x: double, y: double>>"


def box(image, i, x0, y0, x1, y1, text="t", confidence=0.5):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return (image, i, text, confidence, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def model_rows(boxes, threshold=20):
    """Reading order of one image's integer boxes: (region, row, place)."""
    out, row, bottom, members = [], -1, None, {}
    for b in sorted(boxes, key=lambda b: (int(b[4][0][1]), b[1])):
        top, low = int(b[4][0][1]), int(b[4][2][1])
        if bottom is None or top - bottom > threshold:
            row, bottom = row + 1, low
        bottom = max(bottom, low)
        members.setdefault(row, []).append(b)
    for r, bs in members.items():
        out += [(b[1], r, p) for p, b in enumerate(sorted(bs, key=lambda b: (int(b[4][0][0]), int(b[4][0][1]), b[1])))]
    return sorted(out)


def test_rows_and_columns_follow_the_model(spark):
    rng = random.Random(5)
    boxes = []
    for image in range(8):
        for i in range(rng.randint(1, 25)):
            x, y = rng.uniform(0, 300), rng.uniform(0, 400)
            boxes.append(box(image, i, x, y, x + rng.uniform(5, 60), y + rng.uniform(5, 30)))
    df = spark.createDataFrame(boxes, BOX)
    rows = layout.rows_from_regions(df, same_box="keep")
    got = {}
    for r in rows.select("image_id", "region_idx", "row_idx", "pos").collect():
        got.setdefault(r[0], []).append(tuple(r[1:]))
    bounds = {r[0]: r[1] for r in layout.column_boundaries(layout.region_boxes(df)).select("image_id", "boundaries").collect()}
    for image in range(8):
        own = [b for b in boxes if b[0] == image]
        assert sorted(got[image]) == model_rows(own)
        xs, kept = sorted(x for b in own for x in (int(b[4][0][0]), int(b[4][2][0]))), []
        for x in xs:
            if not kept or x - kept[-1] > 30:
                kept.append(x)
        assert bounds[image] == kept


def test_column_boundary_case(spark):
    df = spark.createDataFrame([box(1, 0, 0, 0, 20, 9), box(1, 1, 40, 0, 60, 9), box(1, 2, 100, 0, 100, 9)], BOX)
    assert layout.column_boundaries(layout.region_boxes(df)).first().boundaries == [0, 40, 100]


def test_same_box_takes_the_last_values_and_headings(spark):
    boxes = [box(1, 0, 0, 0, 9, 9, "Case Number"), box(1, 1, 50, 0, 59, 9, "Party"), box(1, 2, 0, 60, 9, 69, "a"), box(1, 3, 0, 60, 9, 69, "b"), box(1, 4, 0, 120, 9, 129, "For Orders"), box(1, 5, 0, 180, 9, 189, "SC/1/2020"), box(1, 6, 50, 180, 59, 189, "01-02-2020"), box(2, 0, 5, 5, 9, 9, None), (3, 0, "no box", 0.5, None)]
    rows = layout.rows_from_regions(spark.createDataFrame(boxes, BOX))
    assert [r.text for r in rows.where("image_id = 1 and row_idx = 1").orderBy("pos").collect()] == ["b", "b"]
    assert layout.detect_header_row(rows).orderBy("image_id").collect()[0].header_row_idx == 0
    assert [tuple(r) for r in layout.section_headings(rows).collect()] == [(1, 2)]
    records = {r.row_idx: r for r in layout.cells_to_records(rows).where("image_id = 1").collect()}
    assert set(records) == {1, 3} and records[3].raw_case_number == "SC/1/2020" and records[3].raw_party_name == "-"


def test_merge(spark):
    p = spark.createDataFrame([box(1, 0, 0, 0, 9, 9, "A", 0.8), box(1, 1, 0, 0, 9, 9, "B", 0.6)], BOX)
    s = spark.createDataFrame([box(1, 0, 0, 0, 9, 9, "a", 0.4), box(1, 1, 0, 0, 9, 9, "a", 1.0), box(1, 2, 0, 0, 9, 9, "c", 0.2)], BOX)
    got = sorted((r.text, round(r.confidence, 3), r.engine, r.source) for r in merge.merge_ocr(p, s).collect())
    assert got == [("A", 0.6, "paddle+secondary", "primary"), ("B", 0.6, "paddle", "primary"), ("c", 0.2, "secondary", "secondary")]


def numbers(spark, values):
    return spark.createDataFrame([(i, v, f"party {i % 3}") for i, v in enumerate(values)], "record_id long, case_number string, party_name string")


def test_duplicates(spark):
    df = numbers(spark, ["a", "b", "a", "", "", None, "a"])
    got = {r.record_id: (r.is_duplicate, r.duplicate_of) for r in dedupe.mark_duplicates(df).collect()}
    assert got == {0: (False, None), 1: (False, None), 2: (True, 0), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, 0)}
    assert sorted(tuple(r) for r in dedupe.duplicate_case_numbers(df).collect()) == [("", 3), ("a", 3)]
    marked = dedupe.mark_duplicates(df).withColumn("needs_review", F.lit(False))
    assert dedupe.handle_duplicates(marked, "remove_exact").count() == 5
    assert dedupe.handle_duplicates(marked, "review").where("needs_review").count() == 2
    with pytest.raises(ValueError):
        dedupe.handle_duplicates(marked, "other")


@pytest.mark.parametrize("threshold", [0.85, 0.9])
def test_similar_numbers_miss_none(spark, threshold):
    rng = random.Random(3)
    values = [f"{rng.choice(['CRLA', 'SC', 'WP', 'OS'])}/{rng.randint(1, 400)}/{rng.randint(2019, 2024)}" for _ in range(120)]
    values += ["".join(rng.choice("abc/1") for _ in range(rng.randint(14, 24))) for _ in range(40)]
    values += [v[:5] + "x" + v[5:] for v in values[-20:]] + ["SC 1 2020", "2020 SC 1", "SC", "one two", "two three one"]
    got = {(r.case1, r.case2): r.similarity for r in dedupe.similar_case_numbers(numbers(spark, values), threshold).collect()}
    distinct = sorted(set(values))
    want = {(a, b): token_set_ratio_of(a, b) / 100 for i, a in enumerate(distinct) for b in distinct[i + 1 :] if token_set_ratio_of(a, b) / 100 >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_similar_records(spark):
    df = spark.createDataFrame([(0, "a", "x y"), (1, "a", "y x"), (2, "a", "zzz"), (3, "b", "x y"), (4, "-", "x y"), (5, "-", "x y")], "record_id long, case_number string, party_name string")
    assert [tuple(r)[:2] for r in dedupe.similar_records(df).collect()] == [(0, 1)]
    assert sorted(tuple(r)[:2] for r in dedupe.similar_records(df, skip_empty=False).collect()) == [(0, 1), (4, 5)]


@pytest.mark.parametrize(("threshold", "block"), [(0.9, 4), (0.9, 512), (0.6, 3)])
def test_similar_record_groups_expand_to_all_pairs(spark, threshold, block):
    rng = random.Random(3)
    parties = [None, "", "-", "  ", *(" ".join(rng.choice(["ab", "abc", "xyz", "vs", "nation", "q", "zz"]) for _ in range(rng.randint(1, 4))) for _ in range(25))]
    rows = [(i * 2, rng.choice([None, "", "-", "", "SC/1/2001", "SC/2/2001"]), rng.choice(parties)) for i in range(160)]
    df = spark.createDataFrame(rows, "record_id long, case_number string, party_name string").repartition(3)
    want = {(a, b): 0.7 + 0.3 * token_set_ratio_of(p or "", q or "") / 100 for n, (a, c, p) in enumerate(rows) for b, d, q in rows[n + 1 :] if (c or "") == (d or "")}
    want = {k: v for k, v in want.items() if v >= threshold}
    found = dedupe.similar_record_groups(df, threshold, block).collect()
    group: dict = {}
    for i, c, p in rows:
        group.setdefault((c or "", p or ""), []).append(i)
    of = {x[0]: x for x in group.values()}
    got = [((r.id1, r.id2), r.similarity) for r in found if r.kind == "member"]
    got += [((b, a), s) for (r, a), s in list(got) for b in of[r][1 : of[r].index(a)]]
    got += [(tuple(sorted((a, b))), r.similarity) for r in found if r.kind == "link" for a in of[r.id1] for b in of[r.id2]]
    assert len(got) == len(dict(got)) and dict(got).keys() == want.keys() and all(abs(s - want[k]) < 1e-12 for k, s in got)


def test_similar_records_of_empty_case_numbers(spark):
    df = spark.createDataFrame([(4, "-", "x y"), (5, "-", "x y"), (6, "-", "y x z"), (7, None, "a"), (8, "", "a")], "record_id long, case_number string, party_name string")
    kinds = lambda found: sorted((r[0], int(r[1]), int(r[2])) for r in found if r[0] != "exact")
    assert kinds(dedupe.similar_record_groups(df).collect()) == [("link", 4, 6), ("member", 4, 5), ("member", 7, 8)]
    assert kinds(dedupe.duplicate_candidates(df).where("kind <> 'number'").collect()) == [("member", 4, 5), ("member", 7, 8), ("record", 4, 6)]


def multiline_model(lines, kind):
    kept = [x.strip() for x in lines if x.strip()]
    text = kept[0] if len(kept) == 1 else re.sub(r"\s+", " ", " ".join(kept)).strip()
    if not text:
        return "-"
    if kind == "text":
        return text.replace("–", "-").replace("—", "-")
    text = re.sub(r"\s+", " ", text)
    for pattern, proper in [("vs", "Vs")] if kind == "party" else [(x, x) for x in ("ADPP", "APP", "ASP", "SP")]:
        text = re.sub(rf"\b{pattern}\.?\b", proper, text, flags=re.IGNORECASE)
    return text.strip()


def test_multiline_query_reaches_all_types(spark, tmp_path):
    from docketspark import queries

    texts = ["A\nvs. B", " x  VS.y – z \n\n", "avsb vs\n—vs–", "", " \n\t", "one  line vs it", "Thiru. K\napp.X", "éapp app. é adpp.,\nsp.sp", "asp\u00a0SP.", "app_ app-sp — ASP"]
    rows = [(i * 3 + k, t) for i, t in enumerate(texts) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.value for r in queries.QUERIES["c11_process_multiline_all"](spark, str(tmp_path)).collect()}
    assert got == {i: multiline_model(t.split("\n"), ("party", "advocate", "text")[i % 3]) for i, t in rows}


def test_orders(spark):
    rows = [(0, "SC/2/2020", "02-01-2020"), (1, "SC/10/2020", "-"), (2, "SC/2/2020", "01-01-2021"), (3, "-", "bad"), (4, "AS/1/2021", "03-01-2019")]
    df = spark.createDataFrame(rows, "record_id long, case_number string, hearing_date string")
    ids = lambda d: [r.record_id for r in d.collect()]
    assert ids(order.sort_by_case_number(df)) == [3, 4, 0, 2, 1]
    assert ids(order.sort_by_case_number(df, reverse=True)) == [1, 0, 2, 4, 3]
    assert ids(order.sort_by_date(df)) == [4, 0, 2, 1, 3]
    assert ids(order.sort_by_date(df, reverse=True)) == [1, 3, 2, 0, 4]
    assert ids(order.sort_by_fields(df, [("case_number", True), ("hearing_date", False)])) == ids(order.sort_by_fields(df, [("case_number", False), ("hearing_date", False)]))[::-1]
    assert ids(order.sort_by_mode(df, "original")) == [0, 1, 2, 3, 4] and ids(order.sort_by_mode(df, "number_only")) == [3, 4, 0, 2, 1]
    assert ids(order.page(df, 2, 1)) == [1, 2]
    assert tuple(order.page_counts(df, 2).first()) == (5, 3)


def test_positions_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["g", "g", "g", "h", None]), f"SC/{rng.randrange(40)}/2020") for i in range(900)]
    df = spark.createDataFrame(rows, "record_id long, team string, case_number string").repartition(7)
    number = lambda r: (int(r[2].split("/")[1]), r[0])
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=number), 1)}
    assert {r.record_id: r.position for r in order.with_position(df, order.mode_orders()).collect()} == want
    placed: dict = {}
    for r in sorted(rows, key=number):
        placed.setdefault(r[1] or "unknown", []).append(r[0])
    got = {(r.group_value, r.record_id): r.pos for r in order.group_and_sort(df, "team").collect()}
    assert got == {(g, i): n for g, ids in placed.items() for n, i in enumerate(ids, 1)}
    assert order.group_and_sort(df.limit(0), "team").count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(0, "CRLA/1/2020", "LOW", True, ["error: x"]), (1, "crlb/2/2021", "HIGH", False, [])], "record_id long, case_number string, confidence_level string, needs_review boolean, validation_issues array<string>")
    assert query.filter_case_number(df, "rla/1").count() == 1 and query.filter_case_number(df, "CR_B").count() == 1
    with pytest.raises(ValueError, match="Invalid confidence level"):
        query.filter_level(df, "nope")
    assert query.export_filter(df, None, False).count() == 2 and query.filter_review(df, False).count() == 1
    assert tuple(query.review_queue(df).first()) == (0, "error: x", 2, "PENDING")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', ["x", "y"], True, None)], "record_id long, party_name string, validation_issues array<string>, needs_review boolean, advocate string")
    io.export_csv(df, str(tmp_path / "csv"), ["party_name", "validation_issues", "needs_review", "advocate", "absent"])
    text = max((p.read_bytes() for p in (tmp_path / "csv").glob("part-*")), key=len).decode()
    assert text == 'party_name,validation_issues,needs_review,advocate,absent\r\n"a ""b"", c",x; y,True,,-\r\n'
    io.export_json(df, str(tmp_path / "json"), "now")
    assert spark.read.json(str(tmp_path / "json/metadata")).first().total_records == 1
    html = io.html_rows(spark.createDataFrame([("<a>", 0.5, True)], "case_number string, overall_confidence double, needs_review boolean")).first().value
    assert html.startswith("<tr class='review'><td>&lt;a&gt;</td><td>-</td>") and "50.00%" in html and "UNKNOWN" in html
    files = spark.createDataFrame([("a.PDF", 1), ("pdf", 1), ("b.tar.gz", 1), ("c.png", 60_000_000), (None, 1)], "filename string, file_size long")
    assert [r.reject_reason for r in io.intake(files).collect()] == [None, "file type", "file type", "file size", "file type"]


def test_image_quality(spark, tmp_path):
    import struct

    rows = b"".join(bytes([v, v, v] * 4) for v in (0, 255, 0, 255))
    (tmp_path / "a.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 4, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows)
    got = image_quality.with_quality_score(image_quality.image_quality_metrics(spark.read.format("image").load(str(tmp_path)))).first()
    assert (got.brightness, got.contrast, got.noise) == (127.5, 127.5, 2.0) and got.sharpness == 510.0**2 and got.height_inches == 4 / 96


def test_job_has_one_exchange_by_image_and_no_row_udf(spark, tmp_path):
    regions = fx.regions(spark, "/root/testdata/sf0.001")
    regions.write.mode("overwrite").parquet(str(tmp_path / "regions"))
    stored = spark.read.parquet(str(tmp_path / "regions"))
    plan = layout.cells_to_records(layout.rows_from_regions(stored))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning(image_id") == plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
    merged = merge.merge_ocr(stored, stored.withColumn("confidence", F.lit(0.5)))._jdf.queryExecution().executedPlan().toString()
    assert merged.count("Exchange") == 1 and merged.count("FileScan") == 2 and "Join" not in merged
    done = flows.extract(regions, fx.as_of())
    assert "BatchEvalPython" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.count() == 4452


def test_summaries(spark):
    empty = spark.createDataFrame([], "run_id long, confidence_level string, overall_confidence double, needs_review boolean, is_duplicate boolean")
    assert tuple(summary.export_summary(empty).first()) == (0, 0, 0.0, 0, 0, 0, 0, 0)
    assert summary.accuracy_report(empty).first().accepted_percent == 0.0


def test_streaming_matches_batch(spark, tmp_path):
    from docketspark.streaming.intake import score_stream

    raw = fx.view(spark, "/root/testdata/sf0.001", fx.RECORDS_RAW).withColumn("arrived_at", F.timestamp_seconds(F.col("record_id") + 86_400))
    raw.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")), fx.as_of(), delay="100 days")
    stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = flows.score_records(raw, fx.as_of())
    want = batch.where("case_number not in ('', '-')").select("case_number").distinct().count() + batch.where("case_number in ('', '-')").count()
    assert spark.table("scored").count() == want


def test_sort_keys_are_columns_before_the_sort(spark):
    """An expression in a sort order would be worked out again in each comparison."""
    rows = [(i, f"SC/{i % 7}/2001", f"Part {i % 5} vs X", f"0{i % 9}-01-2001", "kept") for i in range(40)]
    df = spark.createDataFrame(rows, "record_id long, case_number string, party_name string, hearing_date string, _key_0 string")
    for done in (order.sort_by_party_name(df), order.sort_by_case_number(df, True), order.sort_by_date(df), order.sort_by_fields(df, [("case_number", True), ("hearing_date", False)]), order.sort_by_mode(df)):
        sorts = [line for line in done._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line or "rangepartitioning(" in line]
        assert sorts and not any("regexp" in line.lower() or "split_part" in line.lower() or "transform" in line.lower() for line in sorts)
        assert done.columns == df.columns and done.count() == 40
    assert [r.record_id for r in order.sort_by_party_name(df).limit(9).collect()] == [0, 5, 10, 15, 20, 25, 30, 35, 1]


def test_json_lines_are_written_compressed(spark, monkeypatch, tmp_path):
    from docketspark import queries

    monkeypatch.setattr(queries, "shared_folder", lambda _: str(tmp_path / "lines"))
    rows = queries.k1_json_lines(spark, "/root/testdata/sf0.001").count()
    written = sum(p.stat().st_size for p in (tmp_path / "lines").glob("part-*"))
    assert rows > 20_000 and written < 60 * rows  # 280 bytes a box as text


def test_boxes_are_dealt_once_and_by_the_bytes_behind_them(spark, monkeypatch):
    """A row of lineitem is four boxes: it is dealt before these are made, into more tasks as it grows."""
    from docketspark.operators import sizing

    def dealt() -> list[str]:
        plan = fx.regions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan
        return re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)", plan)

    assert sorted(dealt()) == [("l_orderkey", "4"), ("o_orderkey", "4")]
    monkeypatch.setattr(sizing, "TASK_BYTES", 1 << 13)
    more = dealt()
    assert len(more) == 2 and len({n for _, n in more}) == 1 and int(more[0][1]) > 8
    merged = merge.merge_ocr(*(fx.regions(spark, "/root/testdata/sf0.001", s) for s in (fx.REGIONS_FLAT, fx.REGIONS_SECONDARY)))
    assert int(re.search(r"hashpartitioning\(image_id#\d+L?, (\d+)", merged._jdf.queryExecution().executedPlan().toString())[1]) > 8


def test_two_passes_that_are_dealt_alike_are_not_dealt_again(spark):
    """Boxes are four a row of lineitem, in either pass: only these rows are shuffled."""
    from docketspark import queries

    merged = queries.j1_merge_ocr(spark, "/root/testdata/sf0.001")
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", merged._jdf.queryExecution().executedPlan().toString())
    assert sorted(dealt) == ["l_orderkey", "l_orderkey", "o_orderkey", "o_orderkey"]
    passes = [fx.regions(spark, "/root/testdata/sf0.001", s) for s in (fx.REGIONS_FLAT, fx.REGIONS_SECONDARY)]
    want = merge.merge_ocr(*passes).select(*merged.columns)
    assert merged.count() == want.count() > 0 and merged.exceptAll(want).count() == 0
    # not dealt at all, and to different numbers of tasks
    apart = merge.merge_ocr(passes[0].repartition(7), passes[1].repartition(3, "image_id"), dealt=True).select(*merged.columns)
    assert apart.exceptAll(want).count() == 0 and want.exceptAll(apart).count() == 0


def test_equal_parties_meet_by_words_not_in_pairs(spark, monkeypatch):
    def in_pairs(*_):
        raise AssertionError("compared in pairs")

    rng, told = random.Random(5), {}
    names = [" ".join(rng.sample(["a", "b", "c", "dd", "e1", "f", "vs"], rng.randint(0, 4))) for _ in range(90)] + ["b  a", "", "-", "vs", "a\tb", "vs vs"] + [f"Customer {i % 70} vs X{i % 3}" for i in range(150)]
    rows = [(i, f"SC/{i % 2}/2001" if i % 5 else "", n) for i, n in enumerate(names)]
    for i, case, name in rows:
        told.setdefault((case, name), []).append(i)
    first = [(ids[0], case, name) for (case, name), ids in told.items()]
    links = {("link", min(i, j), max(i, j)) for i, c, n in first for j, d, m in first if i < j and c == d and token_set_ratio_of(n, m) == 100}
    members = {("member", ids[0], i) for (_, name), ids in told.items() if name.split() for i in ids[1:]}
    monkeypatch.setattr(dedupe, "_pairs_of_rows", in_pairs)
    found = dedupe.similar_record_groups(spark.createDataFrame(rows, "record_id long, case_number string, party_name string"), threshold=1.0).collect()
    assert len(found) == len({(r.kind, r.id1, r.id2) for r in found}) and all(r.similarity == 1 for r in found)
    assert links and members and {(r.kind, r.id1, r.id2) for r in found} == links | members


def test_layout_sorts_and_joins_no_more_than_it_must(spark, tmp_path):
    """Identical boxes share the sort of the rows, lines are not gathered for each of their boxes, columns come without a join."""
    fx.regions(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "regions"))
    stored = spark.read.parquet(str(tmp_path / "regions"))
    rows = layout.rows_from_regions(stored)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan(rows))) == 2
    assert "collect_list" not in plan(layout.cells_to_records(rows)) + plan(layout.parse_cells(rows)) + plan(layout.section_headings(rows)) + plan(layout.detect_header_row(rows))
    boxes = layout.region_boxes(stored)
    assert "Join" not in plan(layout.assign_columns(boxes)) + plan(layout.organize_columns(rows)) and "ObjectHashAggregate" not in plan(layout.organize_columns(rows))
    key = ["image_id", "region_idx", "col"]
    one, two = (sorted(map(tuple, df.select(*key).collect())) for df in (layout.assign_columns(boxes), layout.assign_columns(boxes, layout.column_boundaries(boxes).drop("width"))))
    assert one == two and len(one) > 1000


def test_headings_and_headers_over_boxes_of_a_line(spark):
    """A phrase may run over two boxes, not over three; header words count once a line; null texts count as empty."""
    lines = [("Case case", "xx"), ("sr", "no"), ("For", "Orders"), ("For", "Orders", "x"), (None, "Steps"), ("SC/1/2001", None, " p "), ("a", "b", "c", "d", "Date hearing")]
    boxes = [box(1, 10 * i + k, 100 * k, 60 * i, 100 * k + 50, 60 * i + 30, t) for i, line in enumerate(lines) for k, t in enumerate(line)]
    rows = layout.rows_from_regions(spark.createDataFrame(boxes, BOX))
    assert layout.detect_header_row(rows).first().header_row_idx == 1
    assert tuple(layout.column_headers(rows).first()) == (1, 1, ["sr", "no"])
    assert sorted(r.row_idx for r in layout.section_headings(rows).collect()) == [2, 4]
    got = {r.row_idx: tuple(r)[2:6] for r in layout.cells_to_records(rows).collect()}
    assert got == {0: ("Case case", "xx", "-", "-"), 3: ("For", "Orders", "x", "-"), 5: ("SC/1/2001", "-", "p", "-"), 6: ("a", "b", "c", "d")}
    two = {r.row_idx: tuple(r)[2:6] for r in layout.cells_to_records(rows, expected=1).collect()}
    assert two[6] == ("a", "-", "-", "-") and two.keys() == got.keys()


def test_records_are_dealt_by_the_bytes_behind_them(spark, monkeypatch):
    """The tasks that clean and score records grow in number with the orders, not with the cores alone."""
    from docketspark.operators import sizing

    dealt = lambda: [int(n) for n in re.findall(r"hashpartitioning\(o_custkey#\d+L?, (\d+)", fx.view(spark, "/root/testdata/sf0.001", fx.RECORDS_RAW)._jdf.queryExecution().executedPlan().toString())]
    few = dealt()
    monkeypatch.setattr(sizing, "TASK_BYTES", 1 << 11)
    more = dealt()
    assert len(few) == len(more) == 1 and more[0] > 2 * few[0]
