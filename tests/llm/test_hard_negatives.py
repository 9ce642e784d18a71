"""Hard negatives against a search over all rows."""

from __future__ import annotations

import math
import random

import duckdb
import pytest

from docketspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, block string, ids string, score long"


def model(rows, every=50):
    """Sorted result rows, ties of one id in the order of labels and vectors left open."""
    usable = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        usable.append((i, [math.floor(256 * x) for x in v], label))
    first = lambda found, n: sorted(found, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:n]
    out = []
    for k, (i, v, label) in enumerate(usable):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m) for n, (j, w, m) in enumerate(usable) if n != k and len(w) == len(v)]
        for p, pid, _ in first([s for s in scored if s[2] == label], 5):
            hard = first([s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p], 3)
            out += [(i, pid, r + 1, nid, p, n) for r, (n, nid, _) in enumerate(hard)]
    return sorted(out, key=str)


def found(spark, table, **options):
    floats = lambda v: v and [x if x is None else float(x) for x in v]
    frame = spark.createDataFrame([(i, floats(v), label, "x", "y", 1) for i, v, label in table], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in hn.hard_negatives(hn.query_labels(frame), **options).collect()), key=str)


def vectors(seed, n, dim=6, grid=4):
    rng = random.Random(seed)
    return [(i, [rng.randint(-grid, grid) / 8 for _ in range(dim)], rng.randrange(10) if i % 3 else 1) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"rows": 40, "anchors": 2}])
def test_all_rows_of_all_blocks(spark, options):
    rows = vectors(3, 420)  # a coarse grid: many equal scores
    odd = [(1000, None, 1), (1050, [0.5] * 6, None), (1100, [0.5, None, 0, 0, 0, 0], 1), (1101, [float("nan")] * 6, 1), (1102, [float("inf")] + [0.0] * 5, 2)]
    odd += [(None, [0.25] * 6, 1), (1150, [1.0, 2.0], 3), (1151, [1.0, 1.9], 3), (1152, [1.0, 1.5], 4), (1200, [], 5), (1201, [], 5), (1250, [0.0] * 6, 2)]
    rows += odd
    assert found(spark, rows, **options) == model(rows)


def test_repeated_rows_and_ids(spark):
    rows = vectors(4, 120)
    rows += [rows[50]] * 3 + [rows[17]] * 4 + [(100, [0.5] * 6, 3)]
    assert found(spark, rows, rows=30) == model(rows)


def test_large_components(spark):
    rows = [(i, [1000.0 * (i % 5), 3e5 + 1e4 * (i % 29), -2e5 + i], i % 2) for i in range(0, 110)]
    assert found(spark, rows) == model(rows) != []
    assert found(spark, [*rows, (150, [3e38, -3e38, 0.0], 1)])  # beyond the bound: no overflow


def test_negative_scores_have_no_hard_negatives(spark):
    rows = [(0, [1.0], 1), (1, [-1.0], 2), (2, [-0.5], 1), (3, [-0.4], 3)]
    assert found(spark, rows, every=50) == model(rows) == []


def test_no_rows(spark):
    assert found(spark, []) == []


def test_as_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    got = [tuple(r) for r in hn.hard_negatives(hn.query_labels(spark.read.parquet(f"{path}/embeddings.parquet"))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert got and sorted(got) == sorted(con.execute(hn.SQL).fetchall())


def test_pairs_of_blocks_are_not_broadcast(spark):
    """Spark takes the copies of an explode for one row: by size it would send every pair of blocks through the driver."""
    joins, real = [], hn.cut

    def seen(df):
        out = real(df)
        joins.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return out

    hn.cut = seen
    try:
        assert found(spark, vectors(5, 600), rows=30, anchors=2) == model(vectors(5, 600))
    finally:
        hn.cut = real
    plan = joins[-1]  # of the positives: the first meeting of all blocks
    assert "MapInArrow" in plan and "SortMergeJoin [dim" in plan.split("MapInArrow")[1]
