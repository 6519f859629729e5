"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words (without marks around them), word pairs and pairs with one or two words between them, hashed. Every
coordinate has its own rate, and the L1 term keeps most weights at exactly zero, so the model that scoring broadcasts is a short list of
(bucket, weight), whose size is bounded by the number of buckets. A feature takes part from ``seen`` training texts of the whole sample
on, as one that only a text or two hold says nothing of others. Shards learn in parallel and their states (z, n) are mixed, see ``training.mixed_state``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, inner_hashes, mix, rows_of, words_of
from .common import column_of, shuffles_removed, slices
from .training import bounded_sample, mixed_state, sigmoid

BITS = 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
GAPS = (1, 2, 3)  # distance of the two words of a pair: a bigram, then skip-grams


def _buckets(w: Words):
    """(bucket, text) of every word and pair, in turn."""
    shift = np.uint64(64 - BITS)
    h = inner_hashes(w, _LETTER)
    yield (h >> shift).astype(np.int64), w.doc
    for gap in GAPS:
        if len(h) > gap:
            ok = w.doc[gap:] == w.doc[:-gap]
            pair = mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap))
            yield (pair[ok] >> shift).astype(np.int64), w.doc[gap:][ok]


def _features(texts: pa.Array):
    """The distinct buckets of each text in turn."""
    for w in words_of(texts):
        key = np.unique(np.concatenate([d * (1 << BITS) + b for b, d in _buckets(w)]))
        cuts = np.searchsorted(key, np.arange(w.hi - w.lo + 1) * (1 << BITS))
        for i in range(w.hi - w.lo):
            yield (key[cuts[i] : cuts[i + 1]] % (1 << BITS)).astype(np.int32)


def _frequent(sample: DataFrame, seen: int) -> np.ndarray:
    """For each bucket, packed into bits, whether ``seen`` texts of ``sample`` or more have it."""

    def over(batches):
        many = np.zeros(1 << BITS, np.int32)
        for batch in slices(batches):
            for f in _features(rows_of(batch, "text")):
                many[f] += 1
        bucket = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(many[bucket])], names=["bucket", "many"])

    counts = sample.select("text").mapInArrow(over, "bucket int, many int")
    often = np.zeros(1 << BITS, bool)
    with shuffles_removed(sample.sparkSession):
        often[np.asarray(counts.groupBy("bucket").agg(F.sum("many").alias("many")).where(F.col("many") >= seen).select("bucket").toArrow()["bucket"])] = True
    return np.packbits(often)


@dataclass(frozen=True)
class Rule:
    """The constants of FTRL-proximal. ``l1`` holds for the sums that a coordinate gathers, whatever the number of rows or shards."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0

    def weights(self, z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        """The weights that the state (z, n) stands for: the proximal step in closed form."""
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, z: np.ndarray, n: np.ndarray, f: np.ndarray, l1: np.ndarray, label: float) -> None:
        """One row: the coordinates ``f`` are 1, all others 0. Moves z and n in place."""
        zf, nf = z[f], n[f]
        w = self.weights(zf, nf, l1)
        g = float(sigmoid(w.sum())) - label
        z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / self.alpha * w
        n[f] = nf + g * g


def _over_shard(table: pa.Table, z: np.ndarray, n: np.ndarray, rule: Rule, epochs: int, frequent: np.ndarray) -> None:
    """Online updates over the shard's rows, from the common state."""
    y = np.asarray(table["label"], float)
    often = np.unpackbits(frequent).astype(bool)
    bias = np.array([1 << BITS])
    rows = [np.concatenate([bias, f[often[f]]]) for f in _features(table["text"].combine_chunks())]
    thresholds = [np.append(0.0, np.full(len(f) - 1, rule.l1)) for f in rows]  # the bias isn't drawn to zero
    for _ in range(epochs):
        for f, l1, label in zip(rows, thresholds, y, strict=True):
            rule.update(z, n, f, l1, label)


def train(rows: DataFrame, label: str, text: str, key: Column, most: int = 20000, rounds: int = 4, epochs: int = 3, rule: Rule = Rule(), seen: int = 3) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """Sparse weights (bucket, weight) fitted on about ``most`` of ``rows`` (those with a 0/1 label); the last bucket is the bias.

    The state of the learner, the sums z and the squared gradients n, goes on from round to round. A text with several labels counts
    once for each; other labels and null are left out. Without any row there is no weight, and every score is 0.5.
    """
    chosen = rows.where(F.col(label).isin(0, 1)).select(F.col(text).cast("string").alias("text"), F.col(label).cast("double").alias("label"), key.alias("key"))
    sample = bounded_sample(chosen, F.struct("key", "text"), most).drop("key")
    frequent = _frequent(sample, seen)
    z, n = mixed_state(sample, lambda t, z, n: _over_shard(t, z, n, rule, epochs, frequent), (1 << BITS) + 1, rounds)
    w = rule.weights(z, n, np.append(np.full(1 << BITS, rule.l1), 0.0)).astype(np.float32)
    index = np.flatnonzero(w)
    return index, w[index]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``: the score, 0 to 1, of every row.

    A null or empty text has the score of the bias alone. A text of any length is scored whole. Equal texts have equal scores; repeated
    rows are kept. A column that is already named ``into`` is replaced, other columns stay as they are, whatever their names. An
    empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    opened: list[np.ndarray] = []

    def over(batch: pa.RecordBatch) -> pa.Array:
        if not opened:
            dense = np.zeros((1 << BITS) + 1, np.float32)
            dense[held.value[0]] = held.value[1]
            opened.append(dense)
        dense, out = opened[0], np.empty(batch.num_rows)
        for w in words_of(rows_of(batch, "text")):
            keys = []
            for bucket, doc in _buckets(w):
                hit = dense[bucket] != 0
                keys.append(doc[hit] * (1 << BITS) + bucket[hit])
            key = np.unique(np.concatenate(keys))
            total = np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], w.hi - w.lo)
            out[w.lo : w.hi] = sigmoid(dense[-1] + total)
        return pa.array(out)

    return docs.withColumn(into, column_of(docs.sparkSession, over, "double", text=F.col(text).cast("string")))
