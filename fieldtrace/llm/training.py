"""Fitting on labelled rows, split into shards whose models are mixed after each round."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffles_removed

SHARDS = 8
#: How many rows a shard of ``all_rows`` holds, about, and how many of many shards one task takes.
SHARD_ROWS, SHARDS_A_TASK = 2000, 8

Fit = Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Step = Callable[[pa.Table, np.ndarray, np.ndarray], None]


def sharded(rows: DataFrame, key: Column, share: Column, shards: int = SHARDS, tasks: int | None = None) -> DataFrame:
    """The ``share`` of the rows that a hash of ``key`` picks, put into shards by another. Adds ``shard`` and ``order``, the sequence of training.

    It is written with a partition for each shard, or ``tasks`` of them for several shards each, so that no round of training shuffles it again.
    """
    picked = rows.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 20)) < share * (1 << 20))
    with shuffles_removed(rows.sparkSession):
        return cut(picked.withColumns({"order": F.xxhash64(F.lit(17), key), "shard": F.pmod(F.xxhash64(F.lit(29), key), F.lit(shards)).cast("int")}).repartitionById(tasks or shards, F.pmod("shard", F.lit(tasks or shards))))


def on_shards(sample: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each shard's rows, which are one partition of a table that ``sharded`` has written (of several shards, if it was asked for fewer tasks). Empty ones give nothing."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield from fn(table).combine_chunks().to_batches()

    return sample.mapInArrow(over, schema)


def bounded_sample(rows: DataFrame, key: Column, most: int, shards: int = SHARDS) -> DataFrame:
    """About ``most`` of the rows (all, if there are fewer), in shards.

    The share is ``most`` by the number of rows, so that no sort or limit is needed and every size is treated alike.
    """
    return sharded(rows, key, F.lit(min(1.0, most / max(rows.count(), 1))), shards)


def all_rows(rows: DataFrame, key: Column) -> DataFrame:
    """Every row, in shards of about ``SHARD_ROWS``, ``SHARDS`` of them at least. So neither a task's memory nor the training of one shard grows with the table."""
    shards = max(SHARDS, -(-rows.count() // SHARD_ROWS))
    return sharded(rows, key, F.lit(1.0), shards, max(SHARDS, -(-shards // SHARDS_A_TASK)))


SLICES = 32
#: How many tasks' slices are summed in one place before their sums are.
TOGETHER = 64


def _on_shard(fit: Fit, held) -> Callable[[pa.Table], pa.Table]:
    def over(table: pa.Table) -> pa.Table:
        values, evidence = held.value
        own = np.unique(table["shard"])
        top, low = np.zeros((2, len(values)))
        for k in own:
            rows = table.filter(pc.equal(table["shard"], int(k)))
            v, e = fit(rows.take(pc.sort_indices(rows, [("order", "ascending")])), values.copy(), evidence.copy())
            grown = np.maximum(e.astype(np.float32) - evidence, 0).astype(np.float64)
            top += v.astype(np.float32) * grown
            low += grown
        blocks = [pa.array([x.tobytes() for x in np.array_split(whole, SLICES)], pa.binary()) for whole in (top, low)]
        return pa.table({"slice": pa.array(range(SLICES), pa.int32()), "turn": pa.array([int(own[0])] * SLICES, pa.int32()), "many": pa.array([len(own)] * SLICES, pa.int64()), "top": blocks[0], "low": blocks[1]})

    return over


_SUMS = "slice int, turn int, many long, top binary, low binary"


def _summed(table: pa.Table) -> pa.Table:
    # in the order of shards, so that the sum of a run is that of another
    table = table.sort_by("turn")
    top, low = (sum(np.frombuffer(x.as_buffer(), np.float64) for x in table[c]) for c in ("top", "low"))
    return pa.table({"slice": table["slice"].slice(0, 1), "turn": table["turn"].slice(0, 1), "many": pa.array([pc.sum(table["many"]).as_py()], pa.int64()), "top": pa.array([top.tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary())})


def fit_by_mixing(sample: DataFrame, fit: Fit, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Iterative parameter mixing: every shard trains from the common values, then values are averaged by their evidence.

    ``fit(rows, values, evidence)`` returns the shard's values and the evidence that it has for each (a sum of squared
    gradients). A value that one shard alone has seen is taken as that shard has it. A task sums its shards; their sums are summed by slices, of
    ``TOGETHER`` tasks and then of those, so the driver holds one model whatever the number of shards.
    """
    sc = sample.sparkSession.sparkContext
    values, evidence = start.astype(np.float32), np.zeros(len(start), np.float32)
    for _ in range(rounds):
        held = sc.broadcast((values, evidence))
        parts = on_shards(sample, _on_shard(fit, held), _SUMS)
        with shuffles_removed(sample.sparkSession):
            some = parts.groupBy("slice", F.floor(F.col("turn") / TOGETHER).alias("together")).applyInArrow(_summed, _SUMS)
            sums = some.groupBy("slice").applyInArrow(_summed, _SUMS).toArrow().sort_by("slice")
        held.unpersist()
        if not sums.num_rows:
            break
        top, low = (np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in sums[c]]) for c in ("top", "low"))
        values = np.where(low > 0, top / np.maximum(low, 1e-30), values).astype(np.float32)
        evidence = (evidence + low / sums["many"][0].as_py()).astype(np.float32)
    return values, evidence


def _packed(at: np.ndarray, *values: np.ndarray) -> bytes:
    """Rising places as differences, then the numbers at them, of 32 bits each."""
    return np.diff(at, prepend=0).astype("<i4").tobytes() + b"".join(v.astype("<f4").tobytes() for v in values)


def _unpacked(block: bytes, fields: int) -> list[np.ndarray]:
    n = len(block) // (4 * (fields + 1))
    return [np.cumsum(np.frombuffer(block, "<i4", n)), *(np.frombuffer(block, "<f4", n, 4 * n * (k + 1)) for k in range(fields))]


def _on_shard_sparse(step: Step, size: int, held) -> Callable[[pa.Table], pa.Table]:
    def over(table: pa.Table) -> pa.Table:
        index, *before = held.value
        state = [np.zeros(size) for _ in before]
        for whole, part in zip(state, before, strict=True):
            whole[index] = part
        old = [s.copy() for s in state]
        step(table.take(pc.sort_indices(table, [("order", "ascending")])), *state)
        moved = [new - was for new, was in zip(state, old, strict=True)]
        at = np.flatnonzero(np.logical_or.reduce([m != 0 for m in moved]))
        cuts = np.searchsorted(at, np.arange(SLICES + 1) * (-(-size // SLICES)))
        blocks = [_packed(at[a:b], *(m[at[a:b]] for m in moved)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"slice": pa.array(range(SLICES), pa.int32()), "shard": pa.array([table["shard"][0].as_py()] * SLICES, pa.int32()), "block": pa.array(blocks, pa.binary())})

    return over


def _mean_of_slice(size: int) -> Callable[[pa.Table], pa.Table]:
    width = -(-size // SLICES)

    def over(table: pa.Table) -> pa.Table:
        base = table["slice"][0].as_py() * width
        total, many = np.zeros((2, width)), np.zeros(width)
        # in the order of shards, so that the sum of a run is that of another
        for block in table.sort_by("shard")["block"].to_pylist():
            at, first, second = _unpacked(block, 2)
            total[0, at - base] += first
            total[1, at - base] += second
            many[at - base] += 1
        at = np.flatnonzero(many)
        return pa.table({"slice": table["slice"].slice(0, 1), "block": pa.array([_packed(at + base, *(total[:, at] / many[at]))], pa.binary())})

    return over


def mixed_state(sample: DataFrame, step: Step, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The two state arrays of an online learner, from zeros, after ``rounds`` over shards in parallel.

    ``step(rows, first, second)`` moves the arrays in place. In each round every shard begins with the common state and emits only the
    places that it moved and by how much, in slices; a task for each slice takes the mean of a place over the shards that moved it. So
    the whole state goes on from round to round, a place that one shard alone knows moves as that shard moved it, and the driver holds
    one sparse state whatever the number of shards.
    """
    sc = sample.sparkSession.sparkContext
    state = [np.zeros(size), np.zeros(size)]
    for _ in range(rounds):
        index = np.flatnonzero((state[0] != 0) | (state[1] != 0))
        held = sc.broadcast((index.astype(np.int32), *(s[index].astype(np.float32) for s in state)))
        parts = on_shards(sample, _on_shard_sparse(step, size, held), "slice int, shard int, block binary")
        with shuffles_removed(sample.sparkSession):
            means = parts.groupBy("slice").applyInArrow(_mean_of_slice(size), "slice int, block binary").toArrow()
        held.unpersist()
        if not means.num_rows:
            break
        for block in means["block"]:
            at, first, second = _unpacked(block.as_py(), 2)
            state[0][at] += first
            state[1][at] += second
    return state[0], state[1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
