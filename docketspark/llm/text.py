"""Whole-text tokenising and hashing for Arrow batches, vectorised over many documents at once.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. These bytes never occur inside a
multi-byte UTF-8 character, so byte positions and the code point pattern ``[^\\x20\\x09-\\x0D]+`` agree.
Null texts count as empty. Batches are worked through in slices of about ``CHUNK_BYTES`` so that memory
stays bounded whatever the batch size; a single longer document makes a slice of its own.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18
#: stands for a null id in order and joins: it comes first
NULL_ID = -(1 << 63)
#: ids of several rows that may be broadcast, about 16 bytes each
BROADCAST_IDS = 500_000
#: a key with more than one in so many rows is hot
HOT = 1000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BREAKS = np.ones(256, bool)
_BREAKS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
MAX64 = _U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift-multiply rounds)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=4)
def _byte_values(which: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 101 + which)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(int(n - 1).bit_length(), 12)
        base = int(_BASES[which])
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size <= 1 << 20:  # tables for a giant document are not kept
            _powers[which] = (out[0], out[1])
        return out[0], out[1]
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[starts:ends] for each span, equal for equal contents wherever they stand."""
    power, inverse = _power_tables(len(values) + 1, which)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << _U(40)), 7 + which)


class Words:
    """Words of consecutive documents in one byte buffer; with ``plain``, runs of ASCII letters and digits and other scripts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False) -> None:
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        self.n_docs = len(offsets) - 1
        solid = ~(_BREAKS if plain else _WHITE)[data]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[inner] = False
        after[inner - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        #: first[d]:first[d+1] are the words of document d
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        #: the place of each word in its document
        self.place = np.arange(len(self.starts)) - self.first[self.doc]

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(_byte_values(which)[self.data], self.starts, self.ends, which)

    def windows(self, k: int) -> np.ndarray:
        """Indexes of the words at which a window of k words of one document starts."""
        return np.flatnonzero(self.place + k <= self.counts[self.doc])

    def shingles(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of each run of k words; a document of fewer words gives its whole sequence."""
        at = np.flatnonzero((self.place + k <= self.counts[self.doc]) | (self.place == 0))
        end = np.minimum(at + k, self.first[self.doc[at] + 1])
        return self.doc[at], span_hashes(self.hashes(which), at, end, which)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder the cluster names; on one machine, where none is named, a new one (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder: lineage ends there and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name with as many low lines behind it as no taken name has, in any case of letters."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, bool]:
    """docs with _doc and _ord, by which texts are told apart and ordered, and whether any id has several rows.

    _doc is the id, NULL_ID where it is null; _ord is 0, or the hash of the text where several rows have the id. So rows
    of one id are documents of their own, in the order of their texts' hashes, and equal rows of one id are one document
    that is there several times. Counting the ids reads that column alone; ids of several rows are joined back, and
    broadcast up to BROADCAST_IDS.
    """
    docs = docs.drop("_doc", "_ord").withColumn("_doc", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))
    several = docs.groupBy("_doc").agg(F.count("*").alias("_ord")).where("_ord > 1").select("_doc", F.lit(True).alias("_ord"))
    n = several.limit(BROADCAST_IDS + 1).count()
    if n == 0:  # no literal, which the optimizer would move across exchanges that are to be shared
        return docs.withColumn("_ord", F.col("_doc").bitwiseXOR(F.col("_doc"))), False
    joined = docs.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "_doc", "left")
    return joined.withColumn("_ord", F.when(F.col("_ord"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long"))), True


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with table, which has one row a key with n, the rows of it; both are read several times, so cut them before.

    A key with more than one in HOT of the rows meets its rows by a broadcast, of HOT keys at most; what is left is an
    equi-join by shuffle in which no key is large.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.where(F.col("n") > total / HOT)
    large, small = rows.join(F.broadcast(hot), keys), rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(table.where(F.col("n") <= total / HOT), keys)
    return large.unionByName(small).drop("n")
