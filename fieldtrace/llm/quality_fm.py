"""Quality of a document by a factorisation machine over hashed words, structure statistics and metadata.

The score is sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair term is taken in linear time as
0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2). Features of a text: log(1 + count) of its hashed words, scaled to length
one; statistics of its bytes, words and lines; and the length that the table states for it, if a column is named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import rows_of, words_of
from .common import column_of
from .training import all_rows, fit_by_mixing, sigmoid

BUCKETS = 1 << 14
STATISTICS = 16
RANK = 8
SIZE = BUCKETS + STATISTICS

_KIND = np.zeros(256, np.int64)  # 1 upper, 2 lower or not ASCII, 3 digit, 4 other printable
_KIND[33:127] = 4
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[128:] = 2


def features(texts: pa.Array, stated: np.ndarray | None = None):
    """Yields (lo, hi, feature, value, first): the features of the texts lo..hi, first[i]:first[i+1] those of the i-th."""
    for w in words_of(texts):
        n = w.hi - w.lo
        bucket = (w.hash >> np.uint64(50)).astype(np.int64)
        key, count = np.unique(w.doc * BUCKETS + bucket, return_counts=True)
        doc, feature, value = key // BUCKETS, key % BUCKETS, np.log1p(count)
        norm = np.sqrt(np.bincount(doc, value**2, n)) + 1e-9
        value = value / norm[doc]
        size = np.diff(w.bounds).astype(float)
        kinds = np.bincount(np.repeat(np.arange(n), np.diff(w.bounds)) * 5 + _KIND[w.buf], minlength=5 * n).reshape(n, 5)
        seen = np.maximum(kinds[:, 1:].sum(1), 1)
        words = np.diff(w.first).astype(float)
        some = np.maximum(words, 1)
        same = np.zeros(max(len(w.hash), 1), bool)
        same[1 : len(w.hash)] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        most = np.zeros(n)
        np.maximum.at(most, doc, count)
        short = (w.end - w.start) <= 1
        last = _KIND[w.buf[w.end - 1]] == 4 if len(w.end) else np.zeros(0, bool)
        lines = np.bincount(np.searchsorted(w.bounds, np.flatnonzero(w.buf == 10), "right") - 1, minlength=n)[:n]
        per = lambda flag: np.bincount(w.doc, flag, n) / some
        told = np.full(n, np.nan) if stated is None else stated[w.lo : w.hi].astype(float)
        dense = np.stack(
            [
                np.log1p(words) / 10, np.log1p(size) / 12, kinds[:, 1] / seen, kinds[:, 3] / seen, kinds[:, 4] / seen,
                size / some / 20, np.bincount(doc, minlength=n) / some, most / some, per(same[: len(w.hash)]), per(short), per(last),
                np.minimum(lines / some, 1), np.sqrt(per(same[: len(w.hash)])), np.sqrt(kinds[:, 4] / seen), np.isnan(told) * 1.0,
                np.log1p(np.maximum(np.nan_to_num(told), 0)) / 12,
            ],
            1,
        )
        first = np.searchsorted(doc, np.arange(n + 1))
        at = first[1:] + np.arange(n) * STATISTICS
        where = np.ones(len(feature) + n * STATISTICS, bool)
        dense_at = (at[:, None] + np.arange(STATISTICS)).ravel()
        where[dense_at] = False
        all_feature, all_value = np.empty(len(where), np.int64), np.empty(len(where))
        all_feature[where], all_value[where] = feature, value
        all_feature[dense_at], all_value[dense_at] = np.tile(BUCKETS + np.arange(STATISTICS), n), dense.ravel()
        yield w.lo, w.hi, all_feature, all_value.astype(np.float32), first + np.arange(n + 1) * STATISTICS


def _split(model: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    return model[0], model[1 : SIZE + 1], model[SIZE + 1 :].reshape(SIZE, RANK)


def margins(model: np.ndarray, feature: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores before the sigmoid, in time linear in the number of features."""
    b, w, v = _split(model)
    linear = np.add.reduceat(w[feature] * value, first[:-1])
    vx = v[feature] * value[:, None]
    total = np.add.reduceat(vx, first[:-1])
    return b + linear + 0.5 * (total**2 - np.add.reduceat(vx * vx, first[:-1])).sum(1)


def _fit(table: pa.Table, model: np.ndarray, evidence: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.1, shrink: float = 1e-5):
    y = np.asarray(table["label"], float)
    stated = table["stated"].to_numpy(zero_copy_only=False).astype(float)
    parts = list(features(table["text"].combine_chunks(), stated))
    feature, value = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    size = np.concatenate([np.diff(p[4]) for p in parts])
    first = np.concatenate([[0], np.cumsum(size)])
    grown = evidence.copy() + 1e-8
    balance = np.where(y > 0, 1.0, 1.0)
    order = np.random.default_rng(3)
    for _ in range(epochs):
        turn = order.permutation(len(y))
        for k in range(0, len(turn), batch):
            rows = turn[k : k + batch]
            n = size[rows]
            at = np.cumsum(n) - n
            take = np.repeat(first[rows] - at, n) + np.arange(n.sum())
            f, x, row = feature[take], value[take], np.repeat(np.arange(len(rows)), n)
            b, w, v = _split(model)
            vx = v[f] * x[:, None]
            total = np.add.reduceat(vx, at)
            m = b + np.add.reduceat(w[f] * x, at) + 0.5 * (total**2 - np.add.reduceat(vx * vx, at)).sum(1)
            g = (sigmoid(m) - y[rows]) * balance[rows] / len(rows) * 16
            own, back = np.unique(f, return_inverse=True)
            gx = g[row] * x
            gw = np.bincount(back, gx, len(own)) + shrink * w[own]
            gv = np.stack([np.bincount(back, gx * (total[row, r] - vx[:, r]), len(own)) for r in range(RANK)], 1) + shrink * v[own]
            index = np.concatenate([[0], 1 + own, (SIZE + 1 + own[:, None] * RANK + np.arange(RANK)).ravel()])
            gradient = np.concatenate([[g.sum()], gw, gv.ravel()])
            grown[index] += gradient**2
            model[index] -= rate * gradient / np.sqrt(grown[index])
    return model, grown


def train(rows: DataFrame, label: str, text: str, stated: str | None, key: Column, rounds: int = 3, epochs: int = 3) -> np.ndarray:
    """Fits on all of ``rows`` that have a 0/1 label; other labels and null are left out.

    A text with several labels counts once for each. Null texts are learned from as empty ones. Without any row, every score is about 0.5.
    """
    chosen = rows.where(F.col(label).isin(0, 1)).select(
        F.col(text).cast("string").alias("text"), F.col(label).cast("double").alias("label"), (F.col(stated).cast("double") if stated else F.lit(None).cast("double")).alias("stated"), key.alias("key")
    )
    shards = all_rows(chosen, F.struct("key", "text")).drop("key")
    start = np.concatenate([np.zeros(SIZE + 1), np.random.default_rng(11).normal(0, 0.02, SIZE * RANK)])
    model, _ = fit_by_mixing(shards, lambda t, m, e: _fit(t, m, e, epochs), start, rounds)
    return model


def score(docs: DataFrame, model: np.ndarray, text: str = "text", stated: str | None = None, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``: the score, 0 to 1, of every row.

    Null and empty texts are scored by their statistics, null lengths by that of being null. A text of any length is scored whole. Equal
    texts with equal lengths have equal scores; repeated rows are kept. A column that is already named ``into`` is replaced, other
    columns stay as they are, whatever their names. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def over(batch: pa.RecordBatch) -> pa.Array:
        out = np.empty(batch.num_rows)
        told = rows_of(batch, "stated").to_numpy(zero_copy_only=False).astype(float)
        for lo, hi, f, x, first in features(rows_of(batch, "text"), told):
            out[lo:hi] = sigmoid(margins(held.value, f, x, first))
        return pa.array(out)

    told = F.col(stated).cast("double") if stated else F.lit(None).cast("double")
    return docs.withColumn(into, column_of(docs.sparkSession, over, "double", text=F.col(text).cast("string"), stated=told))
