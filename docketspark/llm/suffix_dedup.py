"""Removal of repeated byte strings by suffix arrays.

A byte is removed when a string of WIDTH bytes that covers it also starts in a document of smaller id. Texts are UTF-8 bytes,
matches stay within a document, and strings are judged on the input.

Every string of WIDTH bytes (a window) has an anchor, the smallest hash among its runs of GRAM bytes, so equal windows have equal anchors.
Consecutive windows of one anchor form a segment. A count-min sketch, merged in shards that grow with the text, lets segments
pass whose anchor is estimated to stand in two documents. Segments meet by anchor, equal ones as one text with the smallest of its
documents, and the suffixes of all texts of a task are put in order (see ``suffix_array``). Neighbours in that order whose first
WIDTH bytes are equal are the places of one window; the smallest document of these keeps it, all others lose it.

Documents are dealt once into buckets of about ``bucket_bytes``, by a number of the row, so equal rows and rows without an id are spread. A
bucket sends a segment for its smallest document only; other documents of the bucket lose it at once, so a passage that
many documents share sends one row a bucket. Anchors that stand in more than ``hot`` buckets send their windows one by one, dealt by
the window itself, so texts that differ next to a passage everyone has don't meet in one task. What a bucket sends to a task, or a task to a bucket, is
packed into one row.

Null texts are empty documents. Rows of one id are documents of their own, ordered by the hash of their texts; equal rows of one
id are one document that is there several times, and each loses the same bytes. Null ids come first. Texts shorter than WIDTH stay. Other
columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring_dedup import _cells, _cover, _lists, _sliding
from .suffix_array import suffix_ranks
from .text import mix, named, slices, with_row_key

WIDTH, GRAM = 50, 24
#: windows of a segment
LONGEST = 64
BUCKET_BYTES, SHARD_KEYS, CELL_BITS = 16 << 20, 1 << 19, 31
#: bytes whose suffixes are put in order together, unless one anchor has more
SORTED = 1 << 20
#: buckets with an anchor beyond which its windows are dealt one by one
HOT_BUCKETS = 1000
#: pairs of anchor and document that a task gathers before it hands on a sketch of them
FLUSH = 1_000_000
_U = np.uint64


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros behind the end."""
    out = np.zeros(len(data) + 8, _U)
    out[: len(data)] = data
    for shift in (1, 2, 4):
        out[:-shift] |= out[shift:] << _U(8 * shift)
    return out


def _segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first byte, windows) of runs of windows of one anchor, at most LONGEST windows each."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    if not len(data) or size.max() < width:
        return np.zeros(0, _U), none, none, none
    eight = words8(data)
    n = len(data) - gram + 1
    h = np.zeros(n, _U)
    for k, at in enumerate([*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]):
        h += eight[at : at + n] * (mix(np.array([k], _U), 77)[0] | _U(1))
    least = _sliding(mix(h, 5), width - gram + 1, np.minimum)
    last = len(data) - width + 1
    inside = np.ones(last, bool)  # windows that cross into the next document are none
    for e in offsets[1:-1].tolist():
        inside[max(0, e - width + 1) : e] = False
    inside[max(0, offsets[-1] - width + 1) :] = False
    at = np.flatnonzero(inside)
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - lead) % LONGEST == 0
    begin = np.flatnonzero(new)
    first = at[begin]
    return key[begin], np.searchsorted(offsets, first, "right") - 1, first, np.diff(np.append(begin, len(at)))


def _sketch(width: int, gram: int, shards: int, cell_bits: int):
    """Sparse sketches of a bucket: the cells of its anchors, in order, twice where they stand in two of its documents."""

    def flush(keys: np.ndarray, bucket: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell = _cells(keys, 0, shards, cell_bits)
        order = np.lexsort((doc, cell, bucket))
        b, c, d = bucket[order], cell[order], doc[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        other = new.copy()
        other[1:] |= d[1:] != d[:-1]
        b, c, new = b[other], c[other], new[other]
        again = np.zeros(len(c), bool)
        again[1:] = ~new[1:] & new[:-1]
        b, c = b[new | again], c[new | again]
        shard = (c >> _U(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (b[1:] != b[:-1])]))
        size = np.diff(np.append(begin, len(c)))
        yield pa.record_batch([pa.array(shard[begin].astype(np.int32)), pa.array(b[begin].astype(np.int32)), _lists(c, size)], names=["shard", "bucket", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            bucket, ids, ords = (batch.column(c).to_numpy() for c in ("bucket", "_doc", "_ord"))
            of_doc = mix(ids.view(_U)) ^ ords.view(_U)  # equal rows of an id are one document
            for row, _, data, offsets in slices(batch.column("text")):
                keys, doc, _, _ = _segments(data, offsets, width, gram)
                held.append((keys, bucket[row + doc], of_doc[row + doc]))
                n += len(keys)
                if n >= FLUSH:
                    yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _merged(hot: int):
    """The sketches of a shard added up: to each bucket its cells of two documents or more, and those of more than hot buckets."""

    def run(table: pa.Table) -> pa.Table:
        cells = table["cells"].combine_chunks()
        size, flat = np.diff(cells.offsets.to_numpy()), cells.values.to_numpy()
        _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(size)), size)
        first = np.ones(len(flat), bool)
        first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        keep = first & (count[which] > 1)
        common = keep & (np.bincount(which[first], minlength=len(count))[which] > hot)
        some = np.flatnonzero(np.bincount(row[keep], minlength=len(size)))
        lists = [_lists(flat[x], np.bincount(row[x], minlength=len(size))[some]) for x in (keep, common)]
        return pa.table([table["bucket"].combine_chunks().take(pa.array(some)), table["shard"].combine_chunks().take(pa.array(some)), *lists], names=["bucket", "shard", "cells", "hot"])

    return run


SEGMENTS, RUNS = "part int, bucket int, n int, size long, data binary", "bucket int, n int, size long, data binary"


def _packed(columns: list[np.ndarray]) -> tuple[int, bytes]:
    """Length and compressed bytes of columns one behind the other."""
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(n: int, size: int, data: bytes, kinds: list[type]) -> list[np.ndarray]:
    """n numbers of each kind, and the bytes behind them."""
    raw, out, at = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, np.frombuffer(raw, np.uint8, size - at, at)]


def _runs_of(key: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of runs of equal keys in order."""
    begin = np.flatnonzero(np.concatenate([[len(key) > 0], key[1:] != key[:-1]]))
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True)) if len(key) else []


def _pieces(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[first : first + size] of each, one behind the other, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _later(codes: np.ndarray, doc: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """Which rows have a smaller document among those of their code."""
    order = np.lexsort((ord_, doc, codes))
    c, d, o = codes[order], doc[order], ord_[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
    out = np.zeros(len(c), bool)
    out[order] = (d != d[lead]) | (o != o[lead])
    return out


def _union(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each row, those that touch as one; of one length a row at least as the later begins."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    # the furthest end so far in the row; rows are apart by more than any end
    which = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
    shift = which * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + shift)
    new = np.ones(len(row), bool)
    new[1:] = lo[1:] + shift[1:] > reach[:-1]
    new[1:] |= row[1:] != row[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(row)) - 1
    return row[begin], lo[begin], reach[last] - shift[last]


SEGMENT, RUN = [np.uint16, np.int32, np.int64, np.int64, np.int64], [np.int64, np.int32, np.int32]


def _known(flagged: pa.Table, column: str) -> np.ndarray:
    cells = flagged[column].combine_chunks()
    shard = np.repeat(flagged["shard"].to_numpy().astype(_U), np.diff(cells.offsets.to_numpy()))
    return np.unique((shard << _U(32)) | cells.values.to_numpy().view(np.uint32).astype(_U))


def _among(cells: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, cells), len(known) - 1)] == cells if len(known) else np.zeros(len(cells), bool)


def _candidates(width: int, gram: int, shards: int, cell_bits: int, parts: int):
    """Segments of a bucket that pass the sketch, for their smallest document; runs of its other documents have a part below 0."""

    def run(docs: pa.Table, flagged: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())], names=[c.split()[0] for c in SEGMENTS.split(", ")])
        if not docs.num_rows or not flagged.num_rows:
            return none
        known, hot = _known(flagged, "cells"), _known(flagged, "hot")
        rows, ids, ords = (docs[c].to_numpy() for c in ("_row", "_doc", "_ord"))
        keys, blobs, sizes, of, places = [], [], [], [], []
        for row, _, data, offsets in slices(docs["text"]):
            key, doc, first, windows = _segments(data, offsets, width, gram)
            cell = _cells(key, 0, shards, cell_bits)
            some = _among(cell, known)
            key, doc, first, windows = key[some], doc[some], first[some], windows[some]
            single = _among(cell[some], hot)
            if single.any():  # these go window by window
                times = np.where(single, windows, 1)
                at = np.repeat(np.arange(len(key)), times)
                step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                key, doc, first, windows, single = key[at], doc[at], first[at] + step, np.where(single[at], 1, windows[at]), single[at]
                eight = words8(data)
                for k in range(0, width - 7, 8):
                    key[single] = mix(key[single] ^ eight[first[single] + k])
            size = windows + width - 1
            keys.append(key)
            blobs.append(_pieces(data, first, size)[0])
            sizes.append(size)
            of.append(row + doc)
            places.append(first - offsets[doc])
        key, blob, size, at, place = (np.concatenate(x) for x in (keys, blobs, sizes, of, places))
        if not len(key):
            return none
        offsets = np.concatenate([[0], np.cumsum(size)])
        codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(blob)]).dictionary_encode().indices.to_numpy()
        later = _later(codes, ids[at], ords[at])
        bucket, out = docs["bucket"][0].as_py(), []
        settled = _union(rows[at[later]], place[later], place[later] + size[later])
        if len(settled[0]):
            out.append((-1 - bucket % parts, bucket, len(settled[0]), *_packed([c.astype(t) for c, t in zip(settled, RUN, strict=True)])))
        part = (mix(key, 9) % _U(parts)).astype(np.int32)
        sent = np.flatnonzero(~later)
        sent = sent[np.argsort(part[sent], kind="stable")]
        for begin, end in _runs_of(part[sent]):
            own = sent[begin:end]
            columns = [size[own], place[own], rows[at[own]], ids[at[own]], ords[at[own]]]
            packed = _packed([*(c.astype(t) for c, t in zip(columns, SEGMENT, strict=True)), _pieces(blob, offsets[own], size[own])[0]])
            out.append((int(part[own[0]]), bucket, len(own), *packed))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), none.schema.types, strict=True)], names=none.schema.names)

    return run


def _first_documents(data: np.ndarray, offsets: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For each byte of the texts at which a window starts, the smallest document of all texts that hold this window.

    least: the smallest document of each text. Windows of one class are neighbours in the order of suffixes.
    """
    rank = suffix_ranks(data, offsets)
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    window = np.flatnonzero(np.arange(len(data)) + width <= np.repeat(offsets[1:], size))
    window = window[np.argsort(rank[window], kind="stable")]
    eight = words8(data)
    same = np.ones(max(len(window) - 1, 0), bool)
    for at in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        part = eight[window + at]
        same &= part[1:] == part[:-1]
    out = np.zeros(len(data), np.int64)
    begin = np.flatnonzero(np.concatenate([[True], ~same])) if len(window) else window
    if len(window):
        out[window] = np.repeat(np.minimum.reduceat(least[text[window]], begin), np.diff(np.append(begin, len(window))))
    return out


def _judge(width: int, gram: int, sorted_bytes: int = SORTED):
    """Segments of some anchors to the runs of their documents that also start in a smaller document; settled runs as they are."""
    names = [c.split()[0] for c in RUNS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            return table.select(names)
        sent = [_unpacked(*(table[c][k].as_py() for c in ("n", "size", "data")), SEGMENT) for k in range(table.num_rows)]
        bucket = np.repeat(table["bucket"].to_numpy(), [len(x[0]) for x in sent])
        size, place, row, doc, ord_, blob = (np.concatenate(x) for x in zip(*sent, strict=True))
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        encoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(blob)]).dictionary_encode()
        codes, texts = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] :], offsets - offsets[0]
        order = np.lexsort((ord_, doc))
        number = np.zeros(len(doc), np.int64)
        number[order] = np.cumsum(np.concatenate([[0], (doc[order][1:] != doc[order][:-1]) | (ord_[order][1:] != ord_[order][:-1])]))
        least = np.full(len(texts), len(doc))
        np.minimum.at(least, codes, number)
        # texts of one anchor stay together; as many anchors at a time as the bytes allow
        anchor, of_text, _, _ = _segments(data, offsets, width, gram)
        of_anchor = np.zeros(len(texts), _U)
        of_anchor[of_text] = anchor
        size_of = np.diff(offsets)
        by = np.argsort(of_anchor, kind="stable")
        change = np.flatnonzero(np.concatenate([[True], of_anchor[by][1:] != of_anchor[by][:-1], [True]]))
        filled = np.concatenate([[0], np.cumsum(size_of[by])])
        found, begin = np.zeros(int(offsets[-1]), np.int32), 0
        while begin < len(by):
            k = int(np.searchsorted(filled[change], filled[begin] + sorted_bytes, "right")) - 1
            stop = int(change[max(k, int(np.searchsorted(change, begin)) + 1)])
            some = by[begin:stop]
            piece, own = _pieces(data, offsets[some], size_of[some])
            found[np.repeat(offsets[some] - own[:-1], size_of[some]) + np.arange(own[-1])] = _first_documents(piece, own, least[some], width)
            begin = stop
        later = number > least[codes]
        lo = place.astype(np.int64)
        out = [(bucket[later], row[later], lo[later], lo[later] + size[later])]
        # the first document of a text loses the windows that are in another text of a smaller document
        own = np.flatnonzero(~later)
        windows = size[own].astype(np.int64) - width + 1
        which = np.repeat(own, windows)
        step = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        gone = found[offsets[codes[which]] + step] < number[which]
        which, step = which[gone], step[gone]
        if len(which):
            new = np.concatenate([[True], (which[1:] != which[:-1]) | (step[1:] != step[:-1] + 1)])
            b = np.flatnonzero(new)
            e = np.append(b[1:], len(which)) - 1
            out.append((bucket[which[b]], row[which[b]], lo[which[b]] + step[b], lo[which[b]] + step[e] + width))
        bucket, *runs = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((runs[1], runs[0], bucket))
        bucket, runs = bucket[order], [c[order].astype(t) for c, t in zip(runs, RUN, strict=True)]
        told = [(int(bucket[b]), e - b, *_packed([c[b:e] for c in runs])) for b, e in _runs_of(bucket)]
        return pa.table([pa.array([x[k] for x in told], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=names)

    return run


def _remove(docs: pa.Table, runs: pa.Table) -> pa.Table:
    """The documents of a bucket without the bytes that its runs cover."""
    told = [_unpacked(*(runs[c][k].as_py() for c in ("n", "size", "data")), RUN)[:3] for k in range(runs.num_rows)]
    row, lo, hi = _union(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*told, strict=True) if told else ((), (), ()))))
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    rows = docs["_row"].to_numpy()
    first, last = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
    for begin, end, data, offsets in slices(docs["text"]):
        for k in range(begin, end):
            own = data[offsets[k - begin] : offsets[k - begin + 1]]
            some = slice(int(first[k]), int(last[k]))
            n_bytes.append(len(own))
            n_spans.append(some.stop - some.start)
            if n_spans[-1]:
                own = own[~_cover(len(own), lo[some], hi[some])]
            n_removed.append(n_bytes[-1] - len(own))
            kept.append(own.tobytes())
    counts = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
    return pa.table([docs["_id"], *counts, pa.array(kept, pa.binary())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _dealt(docs: DataFrame, id_col: str, bucket_bytes: int) -> tuple[DataFrame, int]:
    """(bucket, _row, _id, _doc, _ord, text) dealt by bucket, and the bytes of all texts."""
    # files are read in one order, so the number of a row is the same when a task is run again
    numbered = docs.select(*named([id_col, "text"])).toDF("_id", "text").withColumn("_row", F.monotonically_increasing_id())
    keyed, _ = with_row_key(numbered, "_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("_row"), F.lit(max(2 * n, size // bucket_bytes))).cast("int").alias("bucket")
    return keyed.select(bucket, "_row", "_id", "_doc", "_ord", "text").repartition(n, "bucket"), int(size)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", width: int = WIDTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, shard_keys: int = SHARD_KEYS, cell_bits: int = CELL_BITS, sorted_bytes: int = SORTED, hot: int = HOT_BUCKETS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes that are left) of each row of docs."""
    if not 8 <= gram <= width:
        raise ValueError("gram must have 8 bytes at least and width at most")
    dealt, size = _dealt(docs, id_col, bucket_bytes)
    shards = 1 + 2 * size // ((width - gram + 2) * shard_keys)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, size // (8 << 20))
    cells = dealt.mapInArrow(_sketch(width, gram, shards, cell_bits), "shard int, bucket int, cells array<int>").groupBy("shard").applyInArrow(_merged(hot), "bucket int, shard int, cells array<int>, hot array<int>")
    segments = dealt.groupBy("bucket").cogroup(cells.groupBy("bucket")).applyInArrow(_candidates(width, gram, shards, cell_bits, parts), SEGMENTS)
    runs = segments.groupBy("part").applyInArrow(_judge(width, gram, sorted_bytes), RUNS)
    schema = docs.select(*named([id_col])).toDF("_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return dealt.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(_remove, schema).withColumnRenamed("_id", id_col)


def digest(df: DataFrame) -> DataFrame:
    """The bytes left replaced by their SHA-256."""
    return df.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
