"""Removal of repeated word windows with a count-min prefilter.

A window is ``width`` consecutive words of one document. A word is removed when a window that covers it
has the same words as a window that starts earlier (smaller id, or the same document and an earlier start).

Documents are dealt once, by a hash, into buckets of about ``bucket_bytes`` of text; all passes read that one exchange. Empty texts are
dealt by row, and rows of an id that several have over COPIES buckets, so that equal rows are no bucket of their own.

Pass 1 counts windows in count-min sketches. Each window is counted under its minimizer, the smallest hash
among its runs of ``gram`` words, at each distinct place of that run; equal windows share the run, so the count
of the minimizer is never below the count of the window, and about one place in seven has to be counted. A sketch has
``DEPTH`` rows of cells, cut into shards: as many shards as the text asks for, of about ``shard_keys`` places and
2**``cell_bits`` cells each, so its load does not depend on the size of the input. Tasks emit sparse sketches of
their buckets, the cells with their counts up to two; for each shard these are added up, and each bucket gets back
its own cells that reached two. No sketch is broadcast or passes the driver.

Pass 2 sends only windows estimated repeated (in all rows) to an exact grouping by a 96-bit hash of the words. Each
bucket first settles repeats within itself, so a window sends one row a bucket at most, however hot it is. The runs
found are dealt by bucket and taken out of the texts.

Null texts are empty documents. Rows of one id are documents of their own, ordered by the hash of their texts; equal
rows of one id are one document that is there several times, and each of them loses the same words. Null ids come first.
Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import MAX64, Words, mix, named, slices, span_hashes, with_row_key

WIDTH, GRAM, DEPTH = 20, 8, 2
BUCKET_BYTES, SHARD_KEYS, CELL_BITS = 16 << 20, 1 << 19, 31
#: places that a task gathers before it hands on a sketch of them
FLUSH = 1_000_000
#: rows of an Arrow batch handed back
ROWS = 1 << 16
#: buckets over which the rows of an id are dealt that several rows have
COPIES = 64
_U = np.uint64


def _sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over values[i:i+width] for each i, in log(width) steps."""
    out, span = values, 1
    while span * 2 <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the minimizer of each, and the minimizers at their distinct places with the words they begin at."""
    n, at = len(w.starts), w.windows(width)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64), at
    h = w.hashes()
    grams = np.full(n, MAX64, np.uint64)
    whole = w.windows(gram)
    grams[whole] = mix(span_hashes(h, whole, whole + gram), 3)
    least = _sliding(grams, width - gram + 1, np.minimum)
    chosen = np.zeros(n, np.uint64)
    chosen[at] = least[at]
    padded = np.concatenate([np.zeros(width - gram, np.uint64), chosen])
    places = whole[_sliding(padded, width - gram + 1, np.maximum)[whole] == grams[whole]]
    return at, chosen[at], grams[places], places


def _cells(keys: np.ndarray, row: int, shards: int, cell_bits: int) -> np.ndarray:
    """The shard (upper half) and cell (lower half) of each key in a row of the sketch."""
    h = mix(keys, 50 + row)
    return ((h >> _U(32)) % _U(shards) << _U(32)) | (h & _U((1 << cell_bits) - 1))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values.astype(np.uint32).view(np.int32)))


def _sketch(width: int, gram: int, shards: int, cell_bits: int):
    """Sparse sketches of rows (bucket, .., text): the cells of each (row and shard, bucket), in order, those counted twice or more twice."""

    def flush(keys: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(DEPTH):
            cell = _cells(keys, row, shards, cell_bits)
            order = np.lexsort((cell, bucket))
            b, c = bucket[order], cell[order]
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
            again = np.zeros(len(c), bool)
            again[1:] = ~new[1:] & new[:-1]
            b, c = b[new | again], c[new | again]
            shard = (c >> _U(32)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (b[1:] != b[:-1])]))
            size = np.diff(np.append(begin, len(c)))
            yield pa.record_batch([pa.array((row * shards + shard[begin]).astype(np.int32)), pa.array(b[begin].astype(np.int32)), _lists(c, size)], names=["shard", "bucket", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            for row, _, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                w = Words(data, offsets)
                _, _, keys, at = minimizers(w, width, gram)
                held.append((keys, bucket[row + w.doc[at]]))
                n += len(keys)
                if n >= FLUSH:
                    yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The sketches of a shard added up: to each bucket its cells that count two or more."""
    cells = table["cells"].combine_chunks()
    size, flat = np.diff(cells.offsets.to_numpy()), cells.values.to_numpy()
    _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    keep = count[which] > 1
    keep[1:] &= (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    left = np.bincount(row[keep], minlength=len(size))
    some = left > 0
    return pa.table([table["bucket"].combine_chunks().filter(pa.array(some)), table["shard"].combine_chunks().filter(pa.array(some)), _lists(flat[keep], left[some])], names=["bucket", "shard", "cells"])


def _candidates(width: int, gram: int, shards: int, cell_bits: int):
    """Rows of a bucket's windows estimated repeated: the first of each here (kind 0) and runs known to be repeats (kind 1).

    The exact key of a window is its 64-bit hash h and 32 bits of a second hash, which x holds above its start.
    For a run, x holds its start and end. Few narrow columns keep the shuffle small.
    """

    def settled(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, ord_: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        order = np.lexsort((at, ord_, doc, h2, h1))
        h1, h2, doc, ord_, at = h1[order], h2[order], doc[order], ord_[order], at[order]
        first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h1)), 0))
        repeat = (doc != doc[lead]) | (ord_ != ord_[lead]) | (at != at[lead])
        out = [(np.zeros(int(first.sum()), np.int8), h1[first], h2[first], doc[first], ord_[first], at[first])]
        doc, ord_, at = doc[repeat], ord_[repeat], at[repeat]
        if len(doc):
            order = np.lexsort((at, ord_, doc))
            doc, ord_, at = doc[order], ord_[order], at[order]
            begin = np.concatenate([[True], (doc[1:] != doc[:-1]) | (ord_[1:] != ord_[:-1]) | (at[1:] > at[:-1] + width)])
            last = np.concatenate([np.flatnonzero(begin)[1:] - 1, [len(doc) - 1]])
            key = mix(doc[begin].astype(np.uint64) ^ (at[begin].astype(np.uint64) << _U(40)))
            out.append((np.ones(len(last), np.int8), key, at[begin].astype(np.uint64), doc[begin], ord_[begin], at[last] + width))
        return out

    def run(docs: pa.Table, flagged: pa.Table) -> pa.Table:
        kinds = {"kind": pa.int8(), "h": pa.int64(), "x": pa.int64(), "doc": pa.int64(), "ord": pa.int64()}
        none = pa.table([pa.array([], t) for t in kinds.values()], names=list(kinds))
        if not docs.num_rows or not flagged.num_rows:
            return none
        cells = flagged["cells"].combine_chunks()
        shard = np.repeat(flagged["shard"].to_numpy().astype(np.uint64), np.diff(cells.offsets.to_numpy()))
        known = np.unique((shard << _U(32)) | cells.values.to_numpy().view(np.uint32).astype(np.uint64))
        ids, ords, held = docs["_doc"].to_numpy(), docs["_ord"].to_numpy(), []
        for row, _, data, offsets in slices(docs["text"]):
            w = Words(data, offsets)
            at, keys, _, _ = minimizers(w, width, gram)
            if not len(at):
                continue
            change = np.concatenate([[True], keys[1:] != keys[:-1]])
            few, maybe = keys[change], np.ones(int(change.sum()), bool)
            for r in range(DEPTH):
                cell = _cells(few, r, shards, cell_bits) + (_U(r * shards) << _U(32))
                maybe &= known[np.minimum(np.searchsorted(known, cell), len(known) - 1)] == cell
            at = at[maybe[np.cumsum(change) - 1]]
            if len(at):
                doc = row + w.doc[at]
                held.append((span_hashes(w.hashes(0), at, at + width, 0), span_hashes(w.hashes(1), at, at + width, 1) >> _U(32), ids[doc], ords[doc], w.place[at]))
        if not held:
            return none
        parts = settled(*(np.concatenate(x) for x in zip(*held, strict=True)))
        kind, h, high, doc, ord_, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        x = (high << _U(32)) | low.astype(np.uint64)
        return pa.table([pa.array(kind), pa.array(h.view(np.int64)), pa.array(x.view(np.int64)), pa.array(doc), pa.array(ord_)], names=list(kinds))

    return run


def _cover(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n words the runs cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(docs: pa.Table, runs: pa.Table) -> pa.Table:
    """The documents of a bucket without the words that its runs cover."""
    doc, ord_, lo, hi = (runs[c].to_numpy() for c in ("_doc", "_ord", "lo", "hi"))
    order = np.lexsort((ord_, doc))
    doc, ord_, lo, hi = doc[order], ord_[order], lo[order], hi[order]
    begin = np.flatnonzero(np.concatenate([[len(doc) > 0], (doc[1:] != doc[:-1]) | (ord_[1:] != ord_[:-1])])) if len(doc) else doc
    end = np.append(begin[1:], len(doc))
    where = {(d, o): slice(b, e) for d, o, b, e in zip(doc[begin].tolist(), ord_[begin].tolist(), begin.tolist(), end.tolist(), strict=True)} if len(doc) else {}
    keys = list(zip(docs["_doc"].to_pylist(), docs["_ord"].to_pylist(), strict=True))
    n_words, n_removed, kept = [], [], []
    for row, stop, data, offsets in slices(docs["text"]):
        w, blob = Words(data, offsets), data.tobytes()
        for k in range(stop - row):
            a, b = int(w.first[k]), int(w.first[k + 1])
            starts, ends, removed = w.starts[a:b], w.ends[a:b], 0
            if (part := where.get(keys[row + k])) is not None:
                keep = ~_cover(b - a, lo[part], np.minimum(hi[part], b - a))
                removed, starts, ends = int((~keep).sum()), starts[keep], ends[keep]
            n_words.append(b - a)
            n_removed.append(removed)
            kept.append(b" ".join([blob[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]))
    return pa.table([docs["_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])


def _dealt(docs: DataFrame, id_col: str, bucket_bytes: int, shard_keys: int) -> tuple[DataFrame, int, int]:
    """(bucket, _id, _doc, _ord, text) dealt by bucket, and the numbers of buckets and of shards of a sketch's row.

    A word takes some six bytes and one in seven is counted: a place for each 42 bytes.
    """
    # files are read in one order, so the number of a row is the same when a task is run again
    numbered = docs.select(*named([id_col, "text"])).toDF("_id", "text").withColumn("_row", F.monotonically_increasing_id())
    keyed, _ = with_row_key(numbered, "_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, shards = max(8 * n, size // bucket_bytes), 1 + size // (42 * shard_keys)
    nothing = F.coalesce(F.col("text"), F.lit("")) == ""  # no run is sent to these
    number = F.when(nothing, F.xxhash64("_row")).when(F.col("_ord") != 0, F.xxhash64("_doc", "_ord", F.pmod("_row", F.lit(COPIES)))).otherwise(F.xxhash64("_doc", "_ord"))
    rows = keyed.select(F.pmod(number, F.lit(buckets)).cast("int").alias("bucket"), "_id", "_doc", "_ord", "text")
    return rows.repartition(n, "bucket"), int(buckets), int(shards)


def flagged_cells(dealt: DataFrame, shards: int, width: int = WIDTH, gram: int = GRAM, cell_bits: int = CELL_BITS) -> DataFrame:
    """(bucket, shard, cells): each bucket's cells that count two or more in the merged sketch."""
    parts = dealt.mapInArrow(_sketch(width, gram, shards, cell_bits), "shard int, bucket int, cells array<int>")
    return parts.groupBy("shard").applyInArrow(_merge, "bucket int, shard int, cells array<int>")


def candidate_windows(dealt: DataFrame, shards: int, width: int = WIDTH, gram: int = GRAM, cell_bits: int = CELL_BITS) -> DataFrame:
    """(kind, h, x, doc, ord): windows estimated repeated, settled in each bucket."""
    flagged = flagged_cells(dealt, shards, width, gram, cell_bits)
    return dealt.groupBy("bucket").cogroup(flagged.groupBy("bucket")).applyInArrow(_candidates(width, gram, shards, cell_bits), "kind byte, h long, x long, doc long, ord long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", width: int = WIDTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, shard_keys: int = SHARD_KEYS, cell_bits: int = CELL_BITS) -> DataFrame:
    """id, n_words, n_removed, kept_text (the kept words joined by one space) of each row of docs."""
    dealt, buckets, shards = _dealt(docs, id_col, bucket_bytes, shard_keys)
    rows = candidate_windows(dealt, shards, width, gram, cell_bits)
    rows = rows.repartition("kind", "h")  # dealt by the bare columns; what the window adds is worked out behind it
    high, low = F.shiftright("x", 32).cast("int"), F.col("x").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    start = F.struct("doc", "ord", F.when(F.col("kind") == 0, low).otherwise(high).alias("lo"))
    marked = rows.withColumn("start", start).withColumn("first", F.min("start").over(Window.partitionBy("kind", "h", F.shiftright("x", 32))))
    later = marked.where((F.col("kind") == 1) | (F.col("start") != F.col("first")))
    # rows of an id that several have are dealt over buckets, and each of these gets their runs
    every = F.when(F.col("ord") != 0, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")), lambda k: F.xxhash64("doc", "ord", k))).otherwise(F.array(F.xxhash64("doc", "ord")))
    buckets_of = F.array_distinct(F.transform(every, lambda h: F.pmod(h, F.lit(buckets)).cast("int")))
    runs = later.select(F.explode(buckets_of).alias("bucket"), F.col("doc").alias("_doc"), F.col("ord").alias("_ord"), F.col("start.lo").alias("lo"), F.when(F.col("kind") == 0, low + width).otherwise(low).alias("hi"))
    schema = docs.select(*named([id_col])).toDF("_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return dealt.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(_remove, schema).withColumnRenamed("_id", id_col)


def digest(df: DataFrame) -> DataFrame:
    """The kept text replaced by its SHA-256."""
    return df.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
