"""Removal of repeated runs of lines by winnowing.

Lines are compared by their words; blank lines take no part and stay where they are. Every window of ``window``
consecutive lines of a document selects its smallest line hash (the leftmost of equals) as fingerprint, so two documents
that share a run of ``window`` lines or more share a selected fingerprint: no such run is missed. A line is
removed when it belongs to a run of at least ``window`` lines that also starts earlier (smaller id, or the same document
and an earlier line), or when it has ``long`` words or more and stands earlier by itself: a line of that many words is
its own window, so that passages in one line and documents of one line are found, while short stock lines need a run.

1. A row goes out for each selected position: its fingerprint, its place, and the hashes of the runs of ``window`` lines
   around it that selected it, which reach from it to the left and to the right.
2. Positions are joined by fingerprint: fingerprints are counted by a combined aggregation, and positions of those that
   occur once end here.
3. Each position's runs to its left and to its right are held against those of all other positions of the fingerprint, by a
   combined minimum over the hashes of their lines: the earliest place of the same lines is a run's source. (The earliest position of the
   fingerprint alone would not do, as a later one may repeat another's neighbours.)
4. From these seeds matches are extended to both sides, along the source's lines, as far as they go: the seeds of a document that have
   one source at one distance are sorted, and such as overlap or touch are one match. Lines of matches are deleted, so a repeat of
   any length goes whole. ``repeated_runs`` returns the matches themselves.

In both joins the hot keys, at most a thousand, are broadcast, and no other key holds more than a thousandth of the rows.

Null texts are empty documents and stay null. Rows of one id are documents of their own, ordered by the hash of their
texts; equal rows of one id are one document that is there several times, and each loses the same lines. Null ids come
first. Other columns stay as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import NULL_ID, Words, cut, free_name, join_hot, mix, named, slices, span_hashes, with_row_key

WINDOW = 2
#: words of a line that needs no neighbour to be a repeated passage
LONG = 20
ALONE = 31
#: matches whose table may be broadcast: 8 bytes each, and about 80 for each document
BROADCAST_MATCHES, BROADCAST_DOCS = 1_000_000, 400_000


class Lines:
    """Lines with words, of consecutive documents."""

    def __init__(self, w: Words) -> None:
        number = np.concatenate([[0], np.cumsum(w.data == 10)])
        line = number[w.starts]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
        self.begin = np.flatnonzero(new)
        self.end = np.concatenate([self.begin[1:], [len(line)]]) if len(line) else self.begin
        self.doc = w.doc[self.begin]
        self.counts = np.bincount(self.doc, minlength=w.n_docs)
        self.place = np.arange(len(self.doc)) - (np.cumsum(self.counts) - self.counts)[self.doc]
        #: the number of each line in its document's text, blank lines counted
        self.number = line[self.begin] - number[w.offsets[self.doc]]


def winnow(hashes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The position that each window hashes[i:i+window], i in at, selects."""
    best = at.copy()
    for j in range(1, window):
        best = np.where(hashes[at + j] < hashes[best], at + j, best)
    return best


def _positions(window: int, long: int):
    """Selected positions of rows (_doc, _ord, text): fingerprint, place, and the runs that selected it as (h1, h2, lo)."""
    kinds = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("lo", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ords = batch.column(0), batch.column(1)
            for row, _, data, offsets in slices(batch.column(2)):
                w = Words(data, offsets)
                lines = Lines(w)
                one, two = (span_hashes(w.hashes(x), lines.begin, lines.end, x) for x in (0, 1))
                at = np.flatnonzero(lines.place + window <= lines.counts[lines.doc])
                alone = np.flatnonzero(lines.end - lines.begin >= long) if window > 1 else at[:0]
                if not len(at) and not len(alone):
                    continue
                chosen = winnow(one, at, window)
                new = np.ones(len(at) + len(alone), bool)
                new[1 : len(at)] = chosen[1:] != chosen[:-1]
                # a line by itself has a fingerprint of its own kind, so that it meets no run of several lines
                prints = np.concatenate([one[chosen], mix(one[alone], ALONE)])
                h1, h2 = (np.concatenate([span_hashes(x, at, at + window, k), span_hashes(x, alone, alone + 1, k)]) for k, x in enumerate((one, two)))
                size = np.repeat(np.array([window, 1], np.int32), [len(at), len(alone)])
                at = np.concatenate([at, alone])
                first = np.flatnonzero(new)
                reach = pa.StructArray.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(lines.place[at].astype(np.int32))], names=["h1", "h2", "lo"])
                doc = pa.array(row + lines.doc[at[first]])
                runs = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), reach).cast(kinds)
                yield pa.record_batch([pa.array(prints[first].view(np.int64)), ids.take(doc), ords.take(doc), pa.array(size[first]), runs], names=["fingerprint", "doc", "ord", "size", "runs"])

    return run


def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, ord, runs) of (doc, ord, seeds): seeds of one source and distance that overlap or touch become one match (lo, end, from_doc, from_ord, from_lo)."""
    fields = [("lo", pa.int32()), ("end", pa.int32()), ("from_doc", pa.int64()), ("from_ord", pa.int64()), ("from_lo", pa.int32())]
    for batch in batches:
        lists = batch.column(2)
        seeds = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        lo, size, doc, nth, source = (seeds.field(c).to_numpy().astype(np.int64) for c in ("lo", "size", "from_doc", "from_ord", "from_lo"))
        order = np.lexsort((lo, lo - source, nth, doc, row))
        row, lo, size, doc, nth, source = (x[order] for x in (row, lo, size, doc, nth, source))
        other = np.ones(len(row), bool)
        other[1:] = (np.diff(row) != 0) | (np.diff(doc) != 0) | (np.diff(nth) != 0) | (np.diff(lo - source) != 0)
        # the furthest line reached so far on each diagonal; a later diagonal is above all of an earlier one
        base = np.cumsum(other) << 32
        reached = np.maximum.accumulate(lo + size + base)
        new = other.copy()
        new[1:] |= lo[1:] + base[1:] > reached[:-1]
        at = np.flatnonzero(new)
        end = reached[np.append(at[1:], len(row)) - 1] - base[at] if len(at) else at
        values = [x.astype(t.to_pandas_dtype()) for x, (_, t) in zip((lo[at], end, doc[at], nth[at], source[at]), fields, strict=True)]
        runs = pa.StructArray.from_arrays([pa.array(x) for x in values], fields=[pa.field(*f) for f in fields])
        offsets = np.searchsorted(row[at], np.arange(len(lists) + 1)).astype(np.int32)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["doc", "ord", "runs"])


def repeated_lines(keyed: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(doc, ord, runs): the matches of each document with earlier places; lo, end and from_lo count lines with words."""
    found = cut(keyed.select("_doc", "_ord", "text").mapInArrow(_positions(window, long), "fingerprint long, doc long, ord long, size int, runs array<struct<h1: long, h2: long, lo: int>>"))
    repeated = cut(found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"))
    reach = cut(join_hot(found, repeated, ["fingerprint"]).select("doc", "ord", "size", F.inline("runs")))
    first = cut(reach.groupBy("h1", "h2").agg(F.min(F.struct("doc", "ord", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = join_hot(reach, first, ["h1", "h2"]).where(F.struct("doc", "ord", "lo") != F.col("first"))
    # a set, so that equal rows of one id, however many, are combined before the exchange
    seed = F.struct("lo", "size", F.col("first.doc").alias("from_doc"), F.col("first.ord").alias("from_ord"), F.col("first.lo").alias("from_lo"))
    seeds = later.groupBy("doc", "ord").agg(F.collect_set(seed).alias("seeds"))
    return seeds.mapInArrow(extend, "doc long, ord long, runs array<struct<lo: int, end: int, from_doc: long, from_ord: long, from_lo: int>>")


def _rebuild(text: int, last: int):
    """The rows without the lines that column number last has, and (n_lines, n_removed) behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            runs, column = batch.column(last), batch.column(text)
            begins, ends = (pc.struct_field(runs, c) for c in ("lo", "end"))
            for row, end, data, offsets in slices(column):
                lines = Lines(Words(data, offsets))
                first = np.concatenate([[0], np.cumsum(lines.counts)])
                texts, removed, counts = column.slice(row, end - row).to_pylist(), [], lines.counts.tolist()
                for k in range(end - row):
                    if not runs[row + k].is_valid or not counts[k]:
                        removed.append(0)
                        continue
                    edge = np.zeros(counts[k] + 1, np.int64)
                    np.add.at(edge, begins[row + k].values.to_numpy(), 1)
                    np.add.at(edge, ends[row + k].values.to_numpy(), -1)
                    hit = np.cumsum(edge[:-1]) > 0
                    drop = set(lines.number[first[k] : first[k + 1]][hit].tolist())
                    texts[k] = "\n".join(line for i, line in enumerate(texts[k].split("\n")) if i not in drop)
                    removed.append(int(hit.sum()))
                cols = [c.slice(row, end - row) if i != text else pa.array(texts, pa.string()) for i, c in enumerate(batch.columns) if i != last]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*(n for i, n in enumerate(names) if i != last), "n_lines", "n_removed"])

    return run


def _without_repeats(docs: DataFrame, id_col: str, window: int, long: int) -> tuple[DataFrame, str, str]:
    """docs with the repeated lines taken out of text and two more columns, and the names of these."""
    lines, removed = (free_name(n, docs.columns) for n in ("n_lines", "n_removed"))
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), F.col("text").alias("text"), *named([id_col])).toDF("row", "text", "id")
    keyed, _ = with_row_key(rows, "id")
    gone = cut(repeated_lines(keyed, window, long).select(F.col("doc").alias("_doc"), F.col("ord").alias("_ord"), F.struct(F.col("runs.lo").alias("lo"), F.col("runs.end").alias("end")).alias("runs")))
    n, total = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("runs.lo")), F.lit(0))).first()
    if n <= BROADCAST_DOCS and total <= BROADCAST_MATCHES:
        gone = F.broadcast(gone)
    plain = [f"c{i}" for i in range(len(docs.columns))]  # mapInArrow asks for columns by name, which a dot would break
    joined = keyed.join(gone, ["_doc", "_ord"], "left").select("row.*", "runs").toDF(*plain, "runs")
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_rebuild(docs.columns.index("text"), len(docs.columns)), schema).toDF(*docs.columns, lines, removed), lines, removed


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", window: int = WINDOW, long: int = LONG) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines (lines with words) and n_removed (with _ behind, where docs has such a column)."""
    return _without_repeats(docs, id_col, window, long)[0]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(id, line, n_lines, source_id, source_line): each match that remove_repeated_lines deletes, a row for each text and id; lines with words are counted, from 0."""
    keyed, _ = with_row_key(docs.select(*named([id_col]), F.col("text").alias("text")).toDF("id", "text"), "id")
    runs = repeated_lines(keyed, window, long).select("doc", F.inline("runs"))
    null = F.lit(NULL_ID)
    return runs.select(F.nullif("doc", null).alias(id_col), F.col("lo").alias("line"), (F.col("end") - F.col("lo")).alias("n_lines"), F.nullif("from_doc", null).alias("source_id"), F.col("from_lo").alias("source_line"))


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_lines, n_removed and the SHA-256 of the text that is left."""
    return df.select(id_col, "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", window: int = WINDOW, long: int = LONG) -> DataFrame:
    """docs after line dedup: texts shortened, n_chars (where there is one) following them, and rows emptied by it gone."""
    out, lines, removed = _without_repeats(docs, id_col, window, long)
    out = out.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*named(docs.columns))
