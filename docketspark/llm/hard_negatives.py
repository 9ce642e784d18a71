"""Hard negatives of anchors: rows of another label that score just below a positive.

Rows with a null label, a null vector, or a null or non-finite component take no part. A component x counts as floor(256 * x);
the score of a row is its integer inner product with the anchor, higher first, ties by smaller vec_id. An anchor's
positives are its first rows of the same label, other than itself; for each, the first different-label rows whose score is
between ``low`` and ``high`` percent of the positive's are its hard negatives.

Every anchor is scored against every row, in blocks: rows are packed into blocks of about ROWS, anchors into blocks of about
ANCHORS, and each pair of blocks is one matrix product. Of each anchor, all scores of a block are sorted by score and id;
a first pass reads its best rows of the same label, a second one searches each positive's upper limit among the rows of
other labels by bisection and reads on to the lower limit. A block hands on at most as many rows a positive as are asked for, and a
window merges them, so neither anchors nor scores meet in one task, and no label or vector is a key.

Null ids come before all others and are no anchors. Rows of one id are rows of their own; of equal score and id they come in the
order of labels and vectors. Vectors of different lengths don't meet. Components beyond a bound (over a million
for vectors of 64) count as the bound, so that scores fit a long. Other columns take no part. No rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import NULL_ID, cut

ROWS, ANCHORS = 4096, 256
#: scores that are sorted at a time
SORTED = 1 << 20
PACKED = "dim int, block int, ids array<long>, labels array<long>, vectors binary"


def _bytes(vectors: np.ndarray) -> bytes:
    """Integers as two or eight bytes each."""
    small = not vectors.size or int(np.abs(vectors).max()) < 1 << 15
    return vectors.astype(np.int16 if small else np.int64).tobytes()


def _numbers(blob: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.int64 if n and dim and len(blob) == 8 * n * dim else np.int16
    return np.frombuffer(blob, kind).reshape(n, dim)


def _pack(table: pa.Table) -> pa.Table:
    """The rows of a block in the order of id, label and vector."""
    dim, n = table["dim"][0].as_py(), table.num_rows
    bound = isqrt((2**63 - 1) // max(dim, 1))
    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
    with np.errstate(over="ignore"):
        vectors = np.clip(np.floor(256 * flat), -bound, bound).astype(np.int64)
    ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
    order = np.lexsort((*vectors.T[::-1], labels, ids))
    lists = [pa.array([x[order]], pa.list_(pa.int64())) for x in (ids, labels)]
    return pa.table([pa.array([dim], pa.int32()), pa.array([table["block"][0].as_py()], pa.int32()), *lists, pa.array([_bytes(vectors[order])])], names=[c.split()[0] for c in PACKED.split(", ")])


ANCHOR = "dim int, block int, row int, id long, label long, vector binary"


def _anchors(every: int):
    """Rows of packed blocks whose id is divisible by every, each with its own place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, block, ids, labels, blob = (batch.column(c)[r].as_py() for c in ("dim", "block", "ids", "labels", "vectors"))
                chosen = [k for k, i in enumerate(ids) if i != NULL_ID and i % every == 0]
                vectors = _numbers(blob, len(ids), dim)
                columns = [[dim] * len(chosen), [block] * len(chosen), chosen, [ids[k] for k in chosen], [labels[k] for k in chosen], [vectors[k].tobytes() for k in chosen]]
                types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in ANCHOR.split(", ")])

    return run


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where these are exact."""
    most = [int(np.abs(x).max(initial=0)) for x in (anchors, rows)]
    if most[0] * most[1] * max(rows.shape[1], 1) < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """((dim, block), anchor, scores in order, order, ids, labels) of each anchor and block; rows are packed in order of id."""
    for batch in batches:
        for r in range(batch.num_rows):
            dim, block, blob, anchors = (batch.column(c)[r].as_py() for c in ("dim", "block", "vectors", "anchors"))
            ids, labels = (batch.column(c)[r].values.to_numpy() for c in ("ids", "labels"))
            rows = _numbers(blob, len(ids), dim)
            step = max(1, SORTED // len(ids))
            for begin in range(0, len(anchors), step):
                some = anchors[begin : begin + step]
                scores = _scores(np.stack([_numbers(a["vector"], 1, dim)[0].astype(np.int64) for a in some]), rows)
                orders = np.argsort(-scores, axis=1, kind="stable")  # by score, then by id
                for a, score, order in zip(some, scores, orders, strict=True):
                    yield (dim, block), a, score[order], order, ids, labels


def _handed(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    types = {"int": pa.int32(), "long": pa.int64()}
    fields = [c.split() for c in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == 1 << 14:
            yield batch()
            held.clear()
    if held:
        yield batch()


POSITIVE = "dim int, block int, row int, other long, of_block int, place long, score long"


def _positives(n: int):
    """Of each anchor, its first n rows of the same label in each block."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (dim, block), a, score, order, ids, labels in _sorted(batches):
            own = a["row"] if a["block"] == block else -1
            same = np.flatnonzero((labels[order] == a["label"]) & (order != own))[:n]
            for k in same.tolist():
                yield dim, a["block"], a["row"], int(ids[order[k]]), block, int(order[k]), int(score[k])

    return lambda batches: _handed(found(batches), POSITIVE)


NEGATIVE = "dim int, block int, row int, number int, other long, of_block int, place long, score long"


def _negatives(n: int, low: int, high: int):
    """Of each anchor and positive, the first n rows of another label within the limits in each block."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (dim, block), a, score, order, ids, labels in _sorted(batches):
            other = np.flatnonzero(labels[order] != a["label"])
            down = -score[other]  # ascending
            for p in a["positives"]:
                most, least = high * p["score"] // 100, -(-low * p["score"] // 100)
                begin = int(np.searchsorted(down, -most, "left"))
                for k in range(begin, min(begin + n, len(down))):
                    if -int(down[k]) < least:
                        break
                    at = int(order[other[k]])
                    yield dim, a["block"], a["row"], p["number"], int(ids[at]), block, at, -int(down[k])

    return lambda batches: _handed(found(batches), NEGATIVE)


def _first(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The n best of each key, numbered; equal score and id stand in the order of the other's block and place."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other", "of_block", "place")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= n)


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, rows: int = ROWS, anchors: int = ANCHORS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are rows whose id is divisible by every."""
    named = embeddings.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = named.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("vector"))
    total = usable.count()
    blocks = max(1, -(-total // rows))
    # the last number deals out equal rows; it is the same when a task is run again, as files are read in one order
    block = F.pmod(F.xxhash64("id", "label", "vector", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    packed = cut(usable.withColumn("block", block).groupBy("dim", "block").applyInArrow(_pack, PACKED))
    chosen = cut(packed.mapInArrow(_anchors(every), ANCHOR))
    anchor_blocks = max(1, -(-chosen.count() // anchors))
    place = F.pmod(F.xxhash64("dim", "block", "row"), F.lit(anchor_blocks)).alias("anchor_block")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    key = ["dim", "block", "row"]
    tasks = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = max(1, min(anchor_blocks, tasks // blocks))  # few blocks of rows are shared by several tasks

    def met(rows_of_anchors: DataFrame, *more: str) -> DataFrame:
        """Each block of anchors with each block of rows, a row a pair.

        Both sides are dealt to a stated number of tasks. The hint keeps the driver out: Spark's estimate of an explode leaves
        its copies out, so it would take all pairs for no more than the anchors and broadcast them.
        """
        meeting = ["dim", "block", "copy"]
        in_blocks = rows_of_anchors.groupBy("dim", place).agg(F.collect_list(F.struct("block", "row", "label", "vector", *more)).alias("anchors"))
        pairs = in_blocks.select("dim", everywhere, F.pmod("anchor_block", F.lit(copies)).cast("int").alias("copy"), "anchors").repartition(4 * tasks, *meeting)
        shared = packed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(4 * tasks, *meeting)
        return pairs.join(shared.hint("merge"), meeting).select("dim", "block", "anchors", "ids", "labels", "vectors")

    best = _first(met(chosen).mapInArrow(_positives(positives), POSITIVE), key, positives, "number")
    lists = best.groupBy(*key).agg(F.collect_list(F.struct("number", "other", "score")).alias("positives"))
    with_positives = cut(chosen.join(lists, key))
    hard = _first(met(with_positives, "positives").mapInArrow(_negatives(negatives, low, high), NEGATIVE), [*key, "number"], negatives, "rank")
    told = with_positives.select(*key, F.col("id").alias("anchor_id"), F.inline("positives").alias("number", "positive", "positive_score"))
    or_null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    columns: list[Column | str] = ["anchor_id", or_null("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), or_null("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    return told.join(hard, [*key, "number"]).select(*columns)


def query_labels(embeddings: DataFrame) -> DataFrame:
    """embeddings in which the labels of ids divisible by 7 are (label + 1) % 10."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM usable a JOIN usable r ON len(a.q) = len(r.q) WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
