"""Threshold-scaled document fingerprints.

The sketch of a text keeps every shingle hash (runs of ``k`` lower-cased words, the whole sequence for shorter texts)
below a fixed fraction of the hash range, and the smallest hash where none is below it. Sketches need no common size:
the union of two sketches (cut back to the fraction) is the sketch of both texts together, and the share of one sketch
found in another estimates containment however unequal the documents are.

A fingerprint is the base64 of the sketch's sorted 48-bit hashes, 8 characters each. Equal texts have equal
fingerprints; null, empty and blank texts have the empty one, which is like itself (1.0) and unlike all others (0.0).

Repeated rows give a row each. Rows of one id, and of a null id, which comes first, follow each other by the hash of their
texts. Very long texts are read whole. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .text import NULL_ID, Words, named, slices

K, SCALE = 5, 4


def sketches(column: pa.Array, k: int = K, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted 48-bit hashes kept of each text."""
    out = []
    for row, end, data, offsets in slices(column):
        w = Words(data, offsets, lower=True)
        doc, h = w.shingles(k)
        h >>= np.uint64(16)
        kept = h < np.uint64((1 << 48) // scale)
        at, at_kept = np.searchsorted(doc, np.arange(w.n_docs + 1)).tolist(), np.searchsorted(doc[kept], np.arange(w.n_docs + 1)).tolist()
        low = h[kept]
        for d in range(end - row):
            some = low[at_kept[d] : at_kept[d + 1]]
            out.append(np.unique(some) if len(some) else h[at[d] : at[d + 1]].min(keepdims=True) if at[d] < at[d + 1] else some)
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two texts, from their sketches."""
    if not len(a) and not len(b):
        return 1.0
    common = _common(a, b)
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has; 1.0 for an empty first text."""
    return _common(a, b) / len(a) if len(a) else 1.0


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both texts together (but for the shingles that span their border)."""
    both = np.union1d(a, b)
    low = both[both < np.uint64((1 << 48) // scale)]
    return low if len(low) else both[:1]


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([encode(s) for s in sketches(pa.array(text, pa.string(), from_pandas=True))])


def _containments(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([containment(decode(x or ""), decode(y or "")) for x, y in zip(a, b, strict=True)], dtype=float)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    return pandas_udf(_fingerprints, "string")(text)


def estimated_containment(a: Column, b: Column) -> Column:
    """Containment of fingerprint a in fingerprint b."""
    return pandas_udf(_containments, "double")(a, b)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one stretch after another, in order, each stretch ended by a row that only serves as the next text."""
    before = None  # (stretch, id, text, sketch)
    for whole in batches:
        for begin in range(0, whole.num_rows, 256):
            batch = whole.slice(begin, 256)
            stretch, ids, extra = (batch.column(c).to_pylist() for c in range(3))
            own = sketches(batch.column(3))
            texts = [t or "" for t in batch.column(3).to_pylist()]
            done = []
            for row in zip(stretch, ids, extra, texts, own, strict=True):
                if before is not None and before[0] == row[0]:
                    done.append((before, edited(before[3], row[3]), row[4]))
                before = None if row[2] else row
            if not done:
                continue
            changed = [e for _, e, _ in done]
            theirs = sketches(pa.array(changed, pa.string()))
            yield pa.record_batch(
                [
                    pa.array([b[1] for b, _, _ in done], pa.int64()),
                    pa.array([len(b[3]) for b, _, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in changed]),
                    pa.array([encode(b[4]) for b, _, _ in done]),
                    pa.array([encode(s) for s in theirs]),
                    pa.array([likeness(b[4], s) for (b, _, _), s in zip(done, theirs, strict=True)]),
                    pa.array([likeness(b[4], s) for b, _, s in done]),
                    pa.array([containment(b[4], s) for (b, _, _), s in zip(done, theirs, strict=True)]),
                    pa.array([containment(b[4], s) for b, _, s in done]),
                    pa.array([containment(s, b[4]) for b, _, s in done]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next", "has_next"],
            )


def stretch_of(doc: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The stretch of each (id, hash of text), in the order of both.

    bounds are quantiles of the ids, in order: an id between two of them belongs to the stretch of the upper one. An id that is
    several quantiles holds as many parts of the rows, and its rows are dealt to as many stretches by their hashes.
    """
    low, parts = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
    parts = parts - low
    share = (h.astype(np.float64) + 2.0**63) / 2.0**64
    return low + np.where(parts > 1, np.minimum((share * parts).astype(np.int64), parts - 1), 0)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fingerprint of each text and of its edited text, and its likeness to that and to the next document.

    in_edited and in_next are the estimated shares of the text's shingles that the edited and the next text have, has_next
    that of the next text's shingles which this one has.

    Documents are ordered by id (null first, equal ids by the hash of the text); the first follows the last. They are dealt by that into
    stretches of about equal size, as many as there are shuffle partitions, by a search in the quantiles of the ids; the first row of each
    stretch goes to the one before it too, so the texts cross the network once and no task sees more than its stretch. The
    table of stretches has one small row for each shuffle partition, which bounds its broadcast. An only document follows itself.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*named([id_col, "text"])).toDF("id", "text")
    keyed = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.array(sorted(int(b) for b in keyed.approxQuantile("doc", [i / n for i in range(1, n)], 0.2 / n)) if n > 1 else [], np.int64)
    place = pandas_udf(lambda doc, h: pd.Series(stretch_of(doc.to_numpy(), h.to_numpy(), bounds).astype(np.int32)), "int")
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    keyed = keyed.withColumn("stretch", place("doc", "h") if len(bounds) else F.lit(0))
    heads = {r[0]: r[1] for r in keyed.groupBy("stretch").agg(F.min(F.struct("doc", "h"))).collect()}
    order = sorted(heads)
    spark = docs.sparkSession
    moved = spark.createDataFrame([(s, heads[s][0], heads[s][1], order[i - 1]) for i, s in enumerate(order)] or [(-1, 0, 0, 0)], "stretch int, doc long, h long, before int")
    tails = keyed.join(F.broadcast(moved), ["stretch", "doc", "h"]).dropDuplicates(["before"])
    both = keyed.select("stretch", "doc", F.lit(0).alias("extra"), "text").unionByName(tails.select(F.col("before").alias("stretch"), "doc", F.lit(1).alias("extra"), "text"))
    both = both.repartitionById(max(n, 1), F.col("stretch")).withColumn("h", F.xxhash64("text")).sortWithinPartitions("stretch", "extra", "doc", "h").drop("h")
    likenesses = ("near_edited", "near_next", "in_edited", "in_next", "has_next")
    out = both.mapInArrow(_against_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, " + ", ".join(f"{c} double" for c in likenesses))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID))).withColumnRenamed("doc_id", id_col)
