"""Best-fit packing of documents into sequences by bin completion with branch and bound.

A document's ids end with a separator; one longer than ``room`` is cut into pieces of ``room`` ids, of which the first may be
shorter. Full pieces are sequences of their own. What is left has one of ``room - 1`` lengths, so the number of pieces of each length
(a table of fewer than ``room`` rows, whatever the corpus) decides how many sequences are needed, and the search runs on it:

 * every level takes the largest length left and enumerates the fillings around it that no other filling dominates;
 * a filling is applied as often as its lengths last, as all those sequences are alike;
 * the search goes depth first by least waste. A branch is cut when its waste so far already makes it no better than the incumbent;
   the first incumbent is the best-fit decreasing solution of the same table.

The search ends at the volume bound, or after ``nodes`` fillings with the incumbent, and looks at the ``width`` fullest fillings of a level; a result says
by how many sequences it lies over the bound. Without a limit (None for both) a level takes every undominated filling, applied once, and the
search runs until it has proved that no fewer sequences will do. Then pieces are ranked within their length
and take the places that the plan has for it. Ranks come from running numbers inside each partition and sums of partition counts, so
that a length of any frequency is spread over all tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .bytetext import rows_of
from .common import cut, slices, small_batches
from .tokens import Tokens

ROOM = 1024
Filling = tuple[int, ...]  # lengths, the largest first


def _sums(room: int, counts: dict[int, int], lengths: list[int]) -> list[int]:
    """For each of the rising lengths, a bit set of the sums up to ``room`` that it and the smaller ones can make; first of none."""
    mask = (1 << room + 1) - 1
    reach = [1]
    for n in lengths:
        now, copies, step = reach[-1], min(counts[n], room // n), 1
        while copies > 0:  # copies in powers of two
            take = min(step, copies)
            now |= now << n * take & mask
            copies, step = copies - take, step * 2
        reach.append(now)
    return reach


def _fillings(room: int, counts: dict[int, int], lengths: list[int], width: int, most_waste: int) -> Iterator[Filling]:
    """Up to ``width`` undominated fillings of ``room``, fullest first, those of larger pieces before others of the same sum.

    None leaves more than ``most_waste``. The sums that can be made are known exactly, so the first is the fullest there is. A filling is dominated if one of its
    pieces, or the gap alone, can be swapped for a single larger piece that is left and fits.
    """
    lengths = [n for n in lengths if n <= room]
    reach = _sums(room, counts, lengths)

    def taken(total: int, top: int) -> Filling | None:
        """The pieces of ``total`` with lengths[top] as the largest."""
        out: list[int] = []
        for k in range(top, -1, -1):
            n = lengths[k]
            for c in range(min(counts[n], total // n), -1 if k < top else 0, -1):
                if reach[k] >> total - c * n & 1:
                    out += [n] * c
                    total -= c * n
                    break
            else:
                return None
            if not total:
                return tuple(out)
        return tuple(out) if not total else None

    made, total = 0, reach[-1].bit_length() - 1
    while made < width and total >= max(0, room - most_waste):
        if total == 0:
            if not made:
                yield ()
            return
        if reach[-1] >> total & 1:
            for top in range(len(lengths) - 1, -1, -1):
                if lengths[top] <= total and (f := taken(total, top)) and (total == room or not _dominated(f, room - total, counts, lengths)):
                    yield f
                    made += 1
                    if made == width:
                        return
        total -= 1


def _all_fillings(room: int, counts: dict[int, int], lengths: list[int]) -> Iterator[Filling]:
    """Every undominated filling of ``room``, larger pieces first."""

    def grow(left: int, top: int, chosen: Filling) -> Iterator[Filling]:
        if top < 0:
            if not _dominated(chosen, left, counts, lengths):
                yield chosen
            return
        n = lengths[top]
        for c in range(min(counts[n], left // n), -1, -1):
            yield from grow(left - c * n, top - 1, chosen + (n,) * c)

    return grow(room, len(lengths) - 1, ())


def _dominated(filling: Filling, left: int, counts: dict[int, int], lengths: list[int]) -> bool:
    if not left:
        return False
    have = Counter(filling)
    return any(counts[m] > have[m] for n in have for m in lengths if n < m <= n + left) or any(counts[m] > have[m] and m <= left for m in lengths)


def _times(first: int, filling: Filling, counts: dict[int, int]) -> int:
    need = Counter((first, *filling))
    return min(counts[n] // c for n, c in need.items())


def _best_fit(counts: dict[int, int], room: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over the table: equal sequences are kept as one entry with their number."""
    import bisect

    open_, closed = [], []  # (left, filling, how many), by rising room left
    for n in sorted(counts, reverse=True):
        many = counts[n]
        while many:
            k = bisect.bisect_left(open_, (n,))
            left, filling, t = open_.pop(k) if k < len(open_) else (room, (), many)
            each = min(left // n, many)
            used = min(t, many // each)
            many -= used * each
            if used < t and filling:
                bisect.insort(open_, (left, filling, t - used))
            made = (left - n * each, filling + (n,) * each, used)
            bisect.insort(open_, made) if made[0] else closed.append(made)
    return [(f, t) for _, f, t in open_ + closed]


@dataclass
class Packing:
    """``plan``: (lengths, how many sequences). ``over`` the volume bound by so many sequences; ``proven`` that no fewer will do."""

    plan: list[tuple[Filling, int]]
    over: int
    proven: bool


def plan(counts: dict[int, int], room: int = ROOM, nodes: int | None = 1200, width: int | None = 4) -> list[tuple[Filling, int]]:
    """(lengths, how many sequences) that hold ``counts[n]`` pieces of each length ``n``."""
    return search(counts, room, nodes, width).plan


def search(counts: dict[int, int], room: int = ROOM, nodes: int | None = 1200, width: int | None = 4) -> Packing:
    """The best packing that the search finds; the best there is if ``nodes`` and ``width`` are None."""
    counts = {n: int(c) for n, c in counts.items() if c}
    if any(not 0 < n <= room for n in counts):
        raise ValueError("every length must be from 1 to the room")
    volume = sum(n * c for n, c in counts.items())
    bound = -(-volume // room)
    best = _best_fit(counts, room)
    best_bins = sum(t for _, t in best)
    left_nodes = float("inf") if nodes is None else nodes
    dived = False

    # depth first without recursion: each level keeps its remaining choices
    state, done, used, waste = dict(counts), [], 0, 0
    levels: list[Iterator[Filling]] = []

    def undo() -> None:
        nonlocal used, waste
        filling, t = done.pop()
        for n in filling:
            state[n] = state.get(n, 0) + t
        used -= t
        waste -= t * (room - sum(filling))

    def choices() -> Iterator[Filling]:
        own = {n: c for n, c in state.items() if c}
        first = max(own)
        own[first] -= 1
        lengths = sorted(n for n in own if own[n])
        if width is None:
            return ((first, *f) for f in _all_fillings(room - first, own, [n for n in lengths if n <= room - first]))
        around = _fillings(room - first, own, lengths, width, (best_bins - 1) * room - volume - waste)
        return ((first, *f) for f in around)

    while True:
        if not any(state.values()):
            dived = True
            if used < best_bins:
                best, best_bins = list(done), used
            descend = False
        else:
            # sequences that the waste so far allows: all else is at least the volume
            descend = used == 0 or -(-(volume + waste) // room) < best_bins
        if best_bins <= bound or (dived and left_nodes <= 0) or left_nodes <= -4 * room:
            return Packing(best, best_bins - bound, best_bins <= bound)
        if descend:
            levels.append(choices())
        elif done:
            undo()
        while levels:
            filling = next(levels[-1], None)
            if filling is not None:
                break
            levels.pop()
            if done:
                undo()
        if not levels:
            return Packing(best, best_bins - bound, best_bins <= bound or (width is None and nodes is None))
        left_nodes -= 1
        t = 1 if width is None else _times(filling[0], filling[1:], state)
        for n in filling:
            state[n] -= t
        done.append((filling, t))
        used += t
        waste += t * (room - sum(filling))


def pieces(docs: DataFrame, id_col: str, text_col: str, room: int, end: int, ids: bool) -> DataFrame:
    """The pieces of every row: id, piece, start, length, ids_crc32, part and rank (its number among those of its length in the partition)."""
    kind = to_arrow_type(docs.schema[id_col].dataType)
    fields = [("id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * ids)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = Tokens(), TaskContext.get().partitionId()
        next_rank = np.zeros(room + 1, np.int64)
        for batch in slices(batches, 1 << 20):
            made: list[list] = [[] for _ in schema]
            for i, text in zip(rows_of(batch, "id").to_pylist(), rows_of(batch, "text").to_pylist(), strict=True):
                raw = tokens.encode(text or "", end)
                n = len(raw) // 4
                cuts = [0, *range(n % room or min(room, n), n + 1, room)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    piece = raw[4 * a : 4 * b]
                    for column, value in zip(made, (i, k, a, b - a, zlib.crc32(piece), part, int(next_rank[b - a]), piece), strict=False):
                        column.append(value)
                    next_rank[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over, f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * ids)


def _places(spark: SparkSession, made: list[tuple[Filling, int]], base: int) -> DataFrame:
    """(length, low, high, each, first_sequence, at): ranks low..high of a length go ``each`` to a sequence, from place ``at``."""
    rows, taken, sequence = [], Counter(), base
    for filling, t in made:
        at = 0
        for n, each in sorted(Counter(filling).items(), reverse=True):
            rows.append((n, taken[n], taken[n] + each * t, each, sequence, at))
            taken[n] += each * t
            at += n * each
        sequence += t
    return spark.createDataFrame(rows, "length long, low long, high long, each long, first_sequence long, at long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end: int = 2, nodes: int | None = 1200, width: int | None = 4, ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, over_bound, proven (and the ids as bytes, if asked for).

    ``over_bound`` and ``proven`` are the same for all: by how many sequences the packing lies over the bound that the number of ids sets, and whether no packing has fewer.
    The search takes ``nodes`` steps and tries ``width`` fillings around each largest piece at most; with None for both it is exact, whatever it takes. Pieces of
    equal length are exchangeable: they are placed in the order of the input's partitions.

    A null text counts as empty and is a piece of the separator alone. Repeated ids and rows are packed row by row, a text of any length by as many pieces as it takes. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, id_col, text_col, room, end, ids))
    by_part = cut(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(room, 0)
    run = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    ranked = made.join(before, ["part", "length"]).withColumn("place", F.col("rank") + F.col("before"))
    whole = ranked.where(F.col("length") == room).withColumns({"sequence_id": F.col("place"), "offset": F.lit(0).cast("long")})
    # fewer than room lengths, and each filling of the plan but the last few uses one up: the places are bounded by the room alone
    found = search(counts, room, nodes, width)
    places = F.broadcast(_places(spark, found.plan, full))
    short = ranked.where(F.col("length") < room).join(places.withColumnRenamed("length", "of"), (F.col("length") == F.col("of")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    turn = F.col("place") - F.col("low")
    short = short.withColumns({"sequence_id": F.col("first_sequence") + F.floor(turn / F.col("each")).cast("long"), "offset": F.col("at") + (turn % F.col("each")) * F.col("length")})
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.lit(found.over).cast("long").alias("over_bound"), F.lit(found.proven).alias("proven"), *["ids"] * ids]
    return whole.select(columns).union(short.select(columns))
