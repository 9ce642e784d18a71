"""Document quality by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model over text statistics, each also cut into bins, by the
non-negative unbiased risk

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

with the logistic loss; unlabelled text is the marginal distribution, labelled documents included. The class prior is
estimated as the share of positives among the labelled training rows where both classes are labelled, and otherwise
from the lowest ratio of unlabelled to positive mass among the bins of the features (a bin that has few negatives
shows the prior).

Training takes two bounded samples, drawn by a hash of the id: about ``max_labels`` of the labelled rows (30,000 by
default), however rare labels are among the documents, and about ``max_train`` of the documents (60,000) as unlabelled
text; at most two rows an id and in all about 20 MB of features on the driver. Everything else is distributed. Scores
depend on the text alone. Null and empty texts score like any text without words. With no positive label there is nothing to learn: the
score is 1.0 and nothing is rejected. Rows sharing an id are scored one by one; if labels disagree on an id, the
lower label counts; a null id is never a label. Very long texts are read whole. Other columns stay as they are, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Words, free_name, named, slices

MAX_TRAIN, MAX_LABELS = 60_000, 30_000
BINS = 8

_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" ", 4), (b"\t\n\v\f\r", 5), (b".,;:?", 6), (b"!", 7), (b"\"'()-", 8), (b"#$%&*+/<=>@[\\]^_`{|}~", 9)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
N_FEATURES = 22


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics of each document."""
    w = Words(data, offsets)
    n = w.n_docs
    kind = _CLASS[data]
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    by_class = np.bincount(doc_of_byte * 11 + kind, minlength=11 * n).reshape(n, 11).astype(float)
    size, words = np.diff(offsets).astype(float), w.counts.astype(float)
    bytes_, words_ = np.maximum(size, 1)[:, None], np.maximum(words, 1)
    letters = np.maximum(by_class[:, 1] + by_class[:, 2], 1)
    length = (w.ends - w.starts).astype(float)
    per_word = lambda x: np.bincount(w.doc, weights=x, minlength=n)
    first, last = kind[w.starts] if len(w.starts) else kind[:0], kind[w.ends - 1] if len(w.starts) else kind[:0]
    lower = np.concatenate([[0], np.cumsum((kind == 2) | (kind == 10))])
    symbols = np.concatenate([[0], np.cumsum((kind == 9) | (kind == 7))])
    mean = per_word(length) / words_
    spread = np.sqrt(np.maximum(per_word(length**2) / words_ - mean**2, 0))

    def distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, doc))
        d, h = doc[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        return np.bincount(d[new], minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)

    h = w.hashes()
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            by_class[:, 1] / letters,
            by_class[:, 1:] / bytes_,
            mean,
            spread,
            per_word(first == 1) / words_,
            per_word(last == 6) / words_,
            per_word(symbols[w.ends] > symbols[w.starts]) / words_,
            per_word((lower[w.ends] == lower[w.starts]) & (length > 1)) / words_,
            per_word(last == 9) / words_,
            distinct(w.doc, h),
            distinct(*w.shingles(3)),
        ]
    )


@dataclass
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # features x inner borders of bins
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -4, 4)]
        for j, edge in enumerate(self.edges):
            parts.append(np.eye(len(edge) + 1)[np.searchsorted(edge, x[:, j])])
        return np.hstack(parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -40, 40)))


def _mixture_prior(positive: np.ndarray, unlabelled: np.ndarray, edges: np.ndarray) -> float:
    """The lowest mass ratio of unlabelled to positive over the bins that hold a tenth of the positives or more."""
    best = 1.0
    for j, edge in enumerate(edges):
        p = np.bincount(np.searchsorted(edge, positive[:, j]), minlength=len(edge) + 1) / len(positive)
        u = np.bincount(np.searchsorted(edge, unlabelled[:, j]), minlength=len(edge) + 1) / len(unlabelled)
        best = min([best, *(u[p >= 0.1] / p[p >= 0.1])])
    return float(best)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Minimise the non-negative risk by full-batch Adam; where the negative part falls below zero, its gradient is turned."""
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-6)
    edges = np.quantile(unlabelled, np.arange(1, BINS) / BINS, axis=0).T
    edges = np.hstack([edges, np.quantile(unlabelled, [0.02, 0.98], axis=0).T])
    edges.sort(axis=1)
    prior = _mixture_prior(positive, unlabelled, edges) if prior is None else prior
    model = Model(min(max(prior, 0.01), 0.99), mean, scale, edges, np.zeros(0))
    p, u = model.design(positive), model.design(unlabelled)
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -40, 40))), 1 / (1 + np.exp(-np.clip(fu, -40, 40)))
        negative = np.logaddexp(0, fu).mean() - model.prior * np.logaddexp(0, fp).mean()
        g_pos = model.prior * (p.T @ (sp - 1)) / len(p)
        g_neg = (u.T @ su) / len(u) - model.prior * (p.T @ sp) / len(p)
        g = (g_pos + g_neg if negative >= 0 else -g_neg) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights = w
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in slices(batch.column(2)):
            x = text_features(data, offsets)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.record_batch([*(batch.column(c).slice(row, end - row) for c in (0, 1)), flat], names=["doc", "kind", "x"])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _drawn(rows: int, of: int, *by: str) -> Column:
    """About ``rows`` of ``of`` rows by a hash of the columns, all of them where there are no more."""
    return F.pmod(F.xxhash64(*by, F.lit(7)), F.lit(1 << 40)) < int(min(1.0, rows / max(of, 1)) * (1 << 40))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_train: int = MAX_TRAIN, max_labels: int = MAX_LABELS) -> Model | None:
    """A model from labels outside the held-out fold; None without positives."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.min("quality").alias("quality"))
    known = known.where(_drawn(max_labels, known.count(), "doc"))  # so few that they are broadcast
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("doc"), "text")
    texts = texts.join(F.broadcast(known), "doc", "left").withColumn("u", _drawn(max_train, docs.count(), "doc", "text"))
    kind = (F.coalesce(F.col("quality").cast("int"), F.lit(-1)) * 2 + F.col("u").cast("int")).cast("int").alias("kind")
    found = texts.where(F.col("u") | F.col("quality").isNotNull()).select("doc", kind, "text").mapInArrow(_features, "doc long, kind int, x array<double>")
    table = found.groupBy("doc", "kind").agg(F.min("x").alias("x")).drop("doc").toArrow()  # one row an id, however often it is repeated
    if not table.num_rows:
        return None
    x, kind = np.stack(table["x"].to_numpy()).astype(float), table["kind"].to_numpy()
    order = np.lexsort((kind, *x.T))  # sums do not depend on the order of arrival
    x, kind = x[order], kind[order]
    quality, unlabelled = kind // 2, kind % 2 == 1
    if not (quality == 1).any():
        return None
    prior = (quality == 1).sum() / (quality >= 0).sum() if (quality == 0).any() else None
    return fit_nnpu(x[quality == 1], x[unlabelled] if unlabelled.any() else x, prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score (0 to 1), or score_ where docs has such a column."""
    name, names = free_name("score", docs.columns), docs.columns
    if model is None:
        return docs.withColumn(name, F.lit(1.0))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text_features(data, offsets)) for _, _, data, offsets in slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "score"])

    plain = [f"c{i}" for i in range(len(names))]  # mapInArrow asks for columns by name, which a dot would break
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)), T.StructField("score", T.DoubleType())])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*names, name)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.7, max_train: int = MAX_TRAIN, max_labels: int = MAX_LABELS) -> DataFrame:
    """id, held_out, score, predicted of each row of docs."""
    model = train(docs, labels, id_col, max_train, max_labels)
    scored = score(docs.select(id_col, "text"), model)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.7, max_train: int = MAX_TRAIN, max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    scored = score(docs, train(docs, labels, id_col, max_train, max_labels))
    return scored.where(scored[scored.columns[-1]] >= threshold).select(*named(docs.columns))
