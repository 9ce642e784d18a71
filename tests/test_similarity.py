"""Similarity in built-in functions and in bulk against one pair at a time; candidates of similar numbers and records counted."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketspark.functions.similarity import Names, common_subsequence, lcs_length, token_set_ratio, token_set_ratio_of, words
from docketspark.operators import dedupe, layout, order


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé😀1") for _ in range(rng.randint(1, 6)))
    odd = ["", "  ", "-", " ", "a\0b", "\x1ca\x1fb", "word " * 50, "x" * 62, "x" * 63, "ab" * 100]
    out = [" ".join(rng.choice(["aa", "ab", "b", "Vs", word(), word()]) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 40]))) for _ in range(n)]
    return out + odd + [t[:-1] + "z" for t in out[: n // 5]]


def test_column_as_one_by_one(spark):
    some = texts(3, 500)
    pairs = [(a, b) for a, b in zip(some, some[7:], strict=False)] + [(t, t[1:] + "q") for t in some] + [(None, "a"), (None, None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").repartition(4)
    got = {r.i: (r.ratio, r.lcs) for r in rows.select("i", token_set_ratio(F.col("a"), F.col("b")).alias("ratio"), common_subsequence(F.col("a"), F.col("b")).alias("lcs")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i][0] == token_set_ratio_of(a or "", b or ""), (a, b)
        if a is not None and b is not None:
            assert got[i][1] == lcs_length(a, b), (a, b)


def test_no_python_worker(spark):
    plan = spark.range(3).select(token_set_ratio(F.col("id").cast("string"), F.lit("a"))).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("least", [0.0, 50.0, 90.0])
def test_in_bulk_as_one_by_one(least):
    some = texts(4, 150)
    names = Names(some)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(some)), np.arange(len(some))))
    got, compared = names.ratios(i, j, least)
    want = np.array([token_set_ratio_of(some[a], some[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    found = want >= least
    assert (got[found] == want[found]).all() and (got[~found] <= want[~found]).all() and compared <= len(i)


@pytest.mark.parametrize("least", [0.0, 66.6, 90.0])
@pytest.mark.parametrize(("tile", "together"), [(1 << 16, 1 << 10), (700, 3)])
def test_tables_as_pairs(least, tile, together):
    numbered = [f"Customer {k * 37 % 100000:09d} {'Vs' if k % 9 else 'vs.'} NATION {k % 25}" for k in range(150)]
    names = Names(texts(5, 120) + numbered)
    names.TILE, names.TOGETHER = tile, together
    n = len(names.texts)
    every, half = np.arange(n), n // 2
    i, j = (x.ravel() for x in np.meshgrid(every, every, indexing="ij"))
    want = names.ratios(i, j, least)[0].reshape(n, n)
    met = np.zeros((n, n), int)
    for x, y, table, halved, _ in names.cross(every, None, least):
        counts = np.triu(np.ones(table.shape, bool), 1) if halved else np.ones(table.shape, bool)
        assert not halved or len(x) <= len(y)
        assert (table[counts] == want[np.ix_(x, y)][counts]).all()
        met[np.ix_(x, y)] += counts
    assert (met + met.T == 1 - np.eye(n, dtype=int)).all()
    met[:] = 0
    for x, y, table, halved, _ in names.cross(every[:half], every[half:], least):
        assert not halved and (table == want[np.ix_(x, y)]).all()
        met[np.ix_(x, y)] += 1
    assert (met[:half, half:] == 1).all() and met.sum() == half * (n - half)


@pytest.mark.parametrize("least", [0.0, 66.6, 90.0])
@pytest.mark.parametrize(("tile", "together"), [(1 << 16, 1 << 10), (7000, 3)])
def test_tables_of_one_length_are_bytes(least, tile, together):
    rng = random.Random(14)
    numbered = [f"Customer{'#' if k % 5 == 0 else ' '}{k * 37 % 700:09d} Vs NATION {10 + k % 15}" for k in range(300)]
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    full = [" ".join(sorted({"w" * 30, word(3), word(29)})) for _ in range(40)] + ["x " + " ".join(sorted({word(31), word(30)})) for _ in range(20)]
    names = Names(numbered + [t for t in full if len(t) == 64])
    names.TILE, names.COLUMNS, names.TOGETHER = tile, 90, together
    n, m = len(names.texts), 300
    every = np.arange(n)
    i, j = (x.ravel() for x in np.meshgrid(every, every, indexing="ij"))
    want = names.ratios(i, j, least)[0].reshape(n, n)
    met = np.zeros((n, n), int)
    for one, two in ((every[:m], None), (every[m:], None), (every[:m], every[m:])):
        for x, y, code, values, halved, _ in names.coded(one, two, least):
            counts = np.triu(np.ones((len(x), len(y)), bool), 1) if halved else np.ones((len(x), len(y)), bool)
            assert code is None or code.dtype == np.uint8
            assert code is not None or len(one) < m, "texts of one length"
            assert ((values if code is None else values[code])[counts] == want[np.ix_(x, y)][counts]).all()
            met[np.ix_(x, y)] += counts
    assert (met + met.T == 1 - np.eye(n, dtype=int)).all()


def test_texts_that_fill_the_bits():
    rng = random.Random(15)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    words_ = [word(20) for _ in range(6)]
    texts_ = list({" ".join(sorted([*rng.sample(words_, 2), word(22)])) for _ in range(90)} | {" ".join(sorted({"a", "b", "c", "d", "e", "f", "g", word(50)})) for _ in range(60)})
    names = Names(texts_)
    assert (names.length == 64).all() and names.fits.all() and names.many.max() == 8
    names.TILE, names.COLUMNS = 2000, 50
    every = np.arange(len(texts_))
    for x, y, code, values, halved, _ in names.coded(every, every, 50.0):
        a, b = (z.ravel() for z in np.meshgrid(x, y, indexing="ij"))
        assert code is not None and not halved
        assert (values[code].ravel() == names.ratios(a, b, 50.0)[0]).all()


def test_candidates_work_their_records_out_once(spark):
    worked_out = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            worked_out.add(batch.num_rows)
            yield batch

    rows = [(k, f"SC/{k % 3}/2001", f"ab {k % 7} Vs cd {k}") for k in range(60)]
    records = spark.createDataFrame(rows, "record_id long, case_number string, party_name string")
    kinds = {r.kind for r in dedupe.duplicate_candidates(records.mapInArrow(count, records.schema)).select("kind").distinct().collect()}
    assert kinds == {"exact", "record", "number"} and worked_out.value == 60


def test_lists_of_some_hundred_names_are_compared_in_tables(monkeypatch):
    """One row each, neither pair by pair nor in many small blocks."""
    monkeypatch.setattr(Names, "ratios", lambda *_: pytest.fail("pair by pair"))
    names = [f"Customer {k * 37 % 100000:09d} Vs NATION {k % 25}" for k in range(150)]
    lists = pa.record_batch([pa.array([list(range(150))]), pa.array([names])], names=["ids", "parties"])
    got = {(r["id1"], r["id2"]): r["similarity"] for b in dedupe._pairs_of_rows(0.9, False)(iter([lists])) for r in b.to_pylist()}
    want = {(a, b): 0.7 + 0.3 * (token_set_ratio_of(names[a], names[b]) / 100) for a in range(150) for b in range(a + 1, 150)}
    assert got == {k: s for k, s in want.items() if s >= 0.9}


def test_a_hot_case_number_is_compared_in_tables(spark, monkeypatch):
    """The names of a block are not compared pair by pair."""
    monkeypatch.setattr(Names, "ratios", lambda *_: pytest.fail("pair by pair"))
    found = dedupe._pairs_of_rows(0.9, False)
    names = [f"Customer {k * 37 % 100000:09d} Vs NATION {k % 25}" for k in range(60)]
    block = pa.record_batch([pa.array([list(range(60))]), pa.array([names]), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.string()))], names=["ids", "parties", "other_ids", "other_parties"])
    got = {(r["id1"], r["id2"]): r["similarity"] for b in found(iter([block])) for r in b.to_pylist()}
    want = {(a, b): 0.7 + 0.3 * (token_set_ratio_of(names[a], names[b]) / 100) for a in range(60) for b in range(a + 1, 60)}
    assert got == {k: s for k, s in want.items() if s >= 0.9}


def test_links_of_one_id_stand_together():
    """A file then holds the id once for all of them, in place of one in each row."""
    rng = random.Random(17)
    names = [f"Customer {k * 37 % 100000:09d} Vs NATION {k % 25}" for k in range(240)]
    ids = rng.sample(range(10**6), 240)
    schema = pa.schema([(c, pa.list_(t)) for c, t in (("ids", pa.int64()), ("parties", pa.string()), ("other_ids", pa.int64()), ("other_parties", pa.string()))])
    block = pa.record_batch([[ids[:120]], [names[:120]], [ids[120:]], [names[120:]]], schema=schema)
    got, changes, firsts = {}, 0, 0
    for batch in dedupe._pairs_of_rows(0.9, False)(iter([block])):
        one = batch.column(0).to_numpy()
        changes, firsts = changes + int((one[1:] != one[:-1]).sum()), firsts + len(set(one.tolist()))
        got |= {(r["id1"], r["id2"]): r["similarity"] for r in batch.to_pylist()}
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])): 0.7 + 0.3 * (token_set_ratio_of(names[a], names[b]) / 100) for a in range(120) for b in range(120, 240)}
    assert got == {k: s for k, s in want.items() if s >= 0.9} and len(got) > 5000
    assert changes <= firsts


def values(spark, some):
    return spark.createDataFrame([(v,) for v in sorted(set(some))], "value string").withColumn("w", words(F.col("value")))


def test_a_word_of_a_tenth_of_the_values_meets_few(spark):
    rng = random.Random(9)
    some = [f"{rng.randrange(10**9):09d}/{rng.randrange(10**6):06d}" for _ in range(1800)]
    some += [f"SC {rng.randrange(10**9):09d}/{rng.randrange(10**6):06d}" for _ in range(200)]
    # all pairs of the word's values would be 19,900
    assert dedupe.pairs_by_words(values(spark, some), 0.85).count() == 0
    some += ["SC", "SC 1"]  # the one is part of all the word's values, of the other a word of one sign is not
    assert dedupe.pairs_by_words(values(spark, some), 0.85).distinct().count() == 201


def test_short_numbers_meet_only_where_they_are_similar(spark):
    """Texts of two lengths meet by what texts of these lengths must share, not by less."""
    rng = random.Random(12)
    some = sorted({f"{rng.choice(['SC', 'WP', 'CRLA', 'CRL.A'])}/{rng.randrange(120)}/{rng.randrange(1992, 2004)}" for _ in range(300)})
    met = {(r.case1, r.case2) for r in dedupe.similar_number_pairs(values(spark, some), 0.85).collect()}
    assert met == {(a, b) for k, a in enumerate(some) for b in some[k + 1 :] if token_set_ratio_of(a, b) >= 85}


def test_numbers_of_shared_words_miss_none(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["SC", "CRL", "APPEAL", "MISCELLANEOUS", "12/2001", "13/2001", "7", "ab", f"{rng.randrange(30)}/20{rng.randrange(10, 14)}"])
    some = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(200)})
    records = spark.createDataFrame([(i, v) for i, v in enumerate(some)], "record_id long, case_number string")
    for threshold in (0.7, 0.85):
        got = {(r.case1, r.case2): r.similarity for r in dedupe.similar_case_numbers(records, threshold).collect()}
        want = {(a, b): token_set_ratio_of(a, b) / 100 for k, a in enumerate(some) for b in some[k + 1 :]}
        assert got == {p: s for p, s in want.items() if s >= threshold}


@pytest.mark.parametrize(("block", "small"), [(512, 64), (8, 2), (3, 0)])
def test_records_far_apart_in_length(spark, block, small):
    rng = random.Random(12)
    parties = [" ".join(rng.sample(["ab", "state", "union", "limited", "company", "of", "x1", "7"], rng.randint(1, 8))) + (" tail" * 0 if rng.random() < 0.8 else " " + "z" * rng.randint(1, 90)) for _ in range(120)] + ["", " ", "ab"]
    rows = [(i, "SC/1/2001", p) for i, p in enumerate(dict.fromkeys(parties))]
    df = spark.createDataFrame(rows, "record_id long, case_number string, party_name string")
    for threshold in (0.9, 0.95, 0.7):
        got = {(r.id1, r.id2): r.similarity for r in dedupe.similar_record_groups(df, threshold, block, small).collect()}
        want = {(a, b): 0.7 + 0.3 * (token_set_ratio_of(p, q) / 100) for a, _, p in rows for b, _, q in rows if a < b}
        assert got == {k: s for k, s in want.items() if s >= threshold}


def test_bounds_leave_few_comparisons(spark):
    rng = random.Random(13)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(i, "", p) for i, p in enumerate(names)], "record_id long, case_number string, party_name string")
    looked, compared = dedupe.similar_record_groups(df, 0.95, counts=True).first()
    assert looked == 300 * 299 // 2 and compared < looked / 20


def test_sources_of_a_hot_case_number(spark):
    rows = [("a", k % 40) for k in range(200)] + [("b", 1), ("c", 2), ("c", 2), ("d", None), ("d", None), ("", 3), ("", 4)]
    df = spark.createDataFrame(rows, "case_number string, image_id int").repartition(4)
    got = {r.case_number: (r["count"], r.n_sources, r.sources) for r in dedupe.duplicate_sources(df, listed=10).collect()}
    assert got == {"a": (200, 40, None), "c": (2, 1, [2]), "d": (2, 0, [])}
    flat = sorted((r.case_number, r.place, r.source, r["count"]) for r in dedupe.source_counts(df).collect())
    assert flat == [("a", k + 1, k, 5) for k in range(40)] + [("c", 1, 2, 2)]


def test_places_are_dealt_without_other_columns(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("record_id"), (F.col("id") % 3).alias("team"), F.concat(F.lit("SC/"), F.col("id") % 40, F.lit("/2020")).alias("case_number"), F.repeat(F.lit("wide"), 50).alias("wide"))
    plan = order.group_and_sort(df, "team")._jdf.queryExecution().analyzed().toString()
    held = [line for line in plan.splitlines() if "LogicalRDD" in line]
    assert held and all("wide" not in line and "team" not in line for line in held)
    assert order.group_and_sort(df, "team").count() == 500


def test_columns_of_an_image_take_one_exchange_and_no_join(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0, 0, 10, 10), (1, 2, "b", 100, 0, 140, 10)], "image_id long, region_idx long, text string, x_min int, y_min int, x_max int, y_max int")
    boxes = rows.withColumn("bounding_box", F.array(F.struct(F.col("x_min").cast("double").alias("x"), F.col("y_min").cast("double").alias("y")), F.struct(F.col("x_max").cast("double").alias("x"), F.col("y_max").cast("double").alias("y")))).drop("x_min", "y_min", "x_max", "y_max")
    found = layout.organize_columns(layout.rows_from_regions(boxes))
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.find("Initial Plan") if "Initial Plan" in plan else 0 :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted((r.region_idx, r.col) for r in found.collect()) == [(1, 0), (2, 1)]
