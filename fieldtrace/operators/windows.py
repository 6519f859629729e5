"""Runs, sessions and order-dependent filters.

Runs are windows. Filters that compare a row with the last one they kept are folds over a key's rows in order; a fold restarts
at any gap that is longer than what it can remember, so a busy key is split at its gaps before it is grouped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine

def with_runs(rows: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """Adds the number of the run (from 0) of each row; a run begins where ``breaks`` holds. ``breaks`` may use ``F.lag`` over ``ordered``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = rows.withColumn("__new", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn(name, F.sum("__new").over(w)).drop("__new")


def gap_runs(rows: DataFrame, keys: list[str], t: str, most: int, name: str = "run", tie: str | None = None) -> DataFrame:
    """Runs of rows no more than ``most`` apart in time."""
    order = [t, *([tie] if tie else [])]
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))
    return with_runs(rows, keys, order, F.col(t) - before > most, name)


def heard_next(rows: DataFrame, keys: list[str], t: str, name: str, most: int) -> DataFrame:
    """(a, b), a < b, once each: names next to each other in time, no more than ``most`` apart. They have the connected components of all pairs of names that are so near.

    Times are cut into buckets of ``most``; a row is in its bucket and in the next one, so no key is sorted as a whole.
    """
    bucket = F.floor(F.col(t) / most)
    spread = rows.select(*keys, t, name, F.explode(F.array(bucket, bucket + 1)).alias("__bucket"))
    w = Window.partitionBy(*keys, "__bucket").orderBy(t, name)
    near = spread.withColumn("__before", F.when(F.col(t) - F.lag(t).over(w) <= most, F.lag(name).over(w))).where(F.col("__before") != F.col(name))
    return near.select(F.least("__before", name).alias("a"), F.greatest("__before", name).alias("b")).distinct()


def merged_intervals(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Overlapping or touching intervals of a key as one, with how many they were."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return with_runs(rows, keys, [low, high], F.col(low) > reach).groupBy(*keys, "run").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("run")


def _begins(table: pa.Table, by: list[str]) -> np.ndarray:
    """Which rows differ from the one before in a column of ``by``; the first one does."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for c in by:
        codes = pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def over_groups(rows: DataFrame, by: list[str], order: list[str], make: Callable[[pa.Table, list[int]], pa.Table], schema: str) -> DataFrame:
    """``make(table, cuts)`` of the rows of whole groups of ``by``, each group in ``order`` and between two of the ``cuts``.

    A task sorts its groups and hands over as many together as a batch has, so many short groups cost no call of Python each; only a group longer than a batch is gathered.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cuts = [*np.flatnonzero(_begins(table, by)).tolist(), table.num_rows]
            yield from make(table, cuts).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            new = np.flatnonzero(_begins(pa.concat_tables([*before, table]), by)[1:]) + 1 - len(before)
            if not len(new):
                held.append(table)
                continue
            last = int(new[-1])
            whole = pa.concat_tables([*held, table.slice(0, last)])
            if whole.num_rows:
                yield from made(whole)
            held = [table.slice(last)]
        if held:
            yield from made(pa.concat_tables(held))

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(over, schema)


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[dict[str, np.ndarray]], np.ndarray], flag: str = "kept", restart: tuple[str, int] | None = None) -> DataFrame:
    """Adds ``flag``, which ``step`` works out from the ordered columns of one key as numpy arrays (object arrays for text).

    ``restart`` (column, gap) says that the state never reaches across a larger gap of that column; keys are split there, and the parts
    of a key are dealt out, so neither one busy key nor many short parts cost much.
    """
    by = list(keys)
    if restart:
        rows, by = gap_runs(rows, keys, restart[0], restart[1], "__part"), [*keys, "__part"]

    def over(table: pa.Table, cuts: list[int]) -> pa.Table:
        columns = {c: table[c].to_numpy() for c in table.column_names if c != "__part"}
        made = [np.asarray(step({c: v[a:b] for c, v in columns.items()}), bool) for a, b in zip(cuts, cuts[1:], strict=False)]
        return table.append_column(flag, pa.array(np.concatenate(made)))

    out = over_groups(rows, by, order, over, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + f", `{flag}` boolean")
    return out.drop("__part")


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Haversine of two points, for folds."""
    a, b = math.radians(lat1), math.radians(lat2)
    s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(s)))


def no_teleports(c: dict[str, np.ndarray], speed: float = 38.0, within_ms: int = 300_000) -> np.ndarray:
    """Drops a fix that implies more than ``speed`` m/s against the last kept one, if that is at most ``within_ms`` before."""
    kept = np.ones(len(c["t_ms"]), bool)
    last = 0
    for k in range(1, len(kept)):
        dt = c["t_ms"][k] - c["t_ms"][last]
        if dt <= within_ms and metres(c["lat"][last], c["lon"][last], c["lat"][k], c["lon"][k]) > speed * max(dt, 1) / 1000:
            kept[k] = False
        else:
            last = k
    return kept


def thinned(c: dict[str, np.ndarray], within_ms: int = 30_000, within_m: float = 25.0) -> np.ndarray:
    """Drops a fix that is both less than ``within_ms`` and less than ``within_m`` from the last kept one."""
    kept = np.ones(len(c["t_ms"]), bool)
    last = 0
    for k in range(1, len(kept)):
        if c["t_ms"][k] - c["t_ms"][last] < within_ms and metres(c["lat"][last], c["lon"][last], c["lat"][k], c["lon"][k]) < within_m:
            kept[k] = False
        else:
            last = k
    return kept


#: After so long, no place on Earth is too far for the default speed of ``cleaned_path``: half a circumference at 250 km/h.
ANYWHERE_MS = 289_000_000


def cleaned_path(c: dict[str, np.ndarray], speed: float = 250 / 3.6, reprieve: int = 3) -> np.ndarray:
    """Drops fixes beyond ``speed`` from the last kept one, unless ``reprieve`` of them in a row agree with each other."""
    n = len(c["t_ms"])
    kept = np.zeros(n, bool)
    last, rejected = -1, []

    def fast(a: int, b: int) -> bool:
        return metres(c["lat"][a], c["lon"][a], c["lat"][b], c["lon"][b]) > speed * max(c["t_ms"][b] - c["t_ms"][a], 1) / 1000

    for k in range(n):
        if last < 0 or not fast(last, k):
            kept[k], last, rejected = True, k, []
            continue
        rejected = [*rejected, k] if not rejected or not fast(rejected[-1], k) else [k]
        if len(rejected) >= reprieve:
            kept[rejected] = True
            last, rejected = k, []
    return kept


def throttled(within: int) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """Lets the first row through, then none until ``within`` after the last one let through."""

    def step(c: dict[str, np.ndarray]) -> np.ndarray:
        kept, last = np.zeros(len(c["t_ms"]), bool), None
        for k, t in enumerate(c["t_ms"]):
            if last is None or t - last >= within:
                kept[k], last = True, t
        return kept

    return step


def kept_within(within: int, closeness: str) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """Merges events of a key: one within ``within`` of the kept event replaces it if it is closer, else it is dropped."""

    def step(c: dict[str, np.ndarray]) -> np.ndarray:
        kept, now = np.zeros(len(c["t_ms"]), bool), None
        for k, t in enumerate(c["t_ms"]):
            if now is None or t - c["t_ms"][now] > within:
                kept[k], now = True, k
            elif c[closeness][k] < c[closeness][now]:
                kept[now], kept[k], now = False, True, k
        return kept

    return step


def stay_points(rows: DataFrame, keys: list[str], metres_around: float = 150.0, least_ms: int = 600_000) -> DataFrame:
    """Stays of a key: rows that remain within ``metres_around`` of their own running centroid for ``least_ms`` at least.

    The row before is never farther than that from the centroid that it is part of, so a step of more than twice as far always ends a stay:
    keys are split there, and their parts are dealt out.
    """
    kinds = dict(rows.dtypes)
    w = Window.partitionBy(*keys).orderBy("t_ms", "lat", "lon")
    far = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) > 2 * metres_around + 1
    rows = with_runs(rows, keys, ["t_ms", "lat", "lon"], far, "__part")

    def over(table: pa.Table, cuts: list[int]) -> pa.Table:
        t, lat, lon = (table[x].to_numpy() for x in ("t_ms", "lat", "lon"))
        part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        found, first, sums = [], 0, np.zeros(2)
        for k in range(len(t) + 1):
            count = k - first
            if k < len(t) and (not count or part[k] == part[k - 1] and metres(*(sums / count), lat[k], lon[k]) <= metres_around):
                sums += lat[k], lon[k]
                continue
            if count and t[k - 1] - t[first] >= least_ms:
                found.append((t[first], t[k - 1], *(sums / count), count, first))
            if k < len(t):
                first, sums = k, np.array([lat[k], lon[k]])
        cols = list(zip(*found, strict=True)) or [()] * 6
        at = pa.array(cols[5], pa.int64())
        return pa.table({**{c: table[c].take(at) for c in keys}, "from_ms": pa.array(cols[0], pa.int64()), "to_ms": pa.array(cols[1], pa.int64()), "lat": pa.array(cols[2], pa.float64()), "lon": pa.array(cols[3], pa.float64()), "n": pa.array(cols[4], pa.int64())})

    return over_groups(rows, [*keys, "__part"], ["t_ms", "lat", "lon"], over, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", from_ms long, to_ms long, lat double, lon double, n long")
