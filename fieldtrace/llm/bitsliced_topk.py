"""Exact top-k search by inner product over a bit-sliced index.

Components are whole numbers, ``floor(256 * x)``. The index holds blocks of vectors; in a block each bit of each attribute is one
bitmap over its vectors, a slice. A query's scores are never worked out vector by vector: its components are written in signed binary digits,
each digit adds one attribute's slices at that digit's weight, and carry-save adders over bitmaps bring all of them to the slices of
the sum. The best rows are then selected from the sum's most significant slice downward; the rows that still tie at the last slice are
resolved by the smaller id. Nothing is approximate.

Vectors that are null, or that hold a null or a non-finite component, take no part, nor do rows without an id. So do vectors whose whole
components have a sum of squares of 2^62 or more, for whose scores a long isn't wide enough. A shorter vector counts as zero beyond its
end; the empty vector has the score 0 with any other. A query's own row is no candidate, but other rows of its id are. Rows that are the same are
separate queries and separate candidates. An empty table gives no rows, and other columns of the table don't matter.

On the cluster, blocks of the index meet blocks of the queries in an equi-join on the pair of their numbers, each a
row of bounded size; a pair gives k + 1 rows for each query, of which a ranking window keeps k + 1. More queries or vectors make more
pairs, never larger ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches

SCALE = 256
#: Most vectors of a block of the index, and most queries of a block of queries.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 17, 1 << 13
#: Vectors whose slices are added at a time: their bitmaps stay in a core's cache.
TILE_ROWS = 1 << 14

_BLOCK = "block long, n long, dims int, ids binary, lows binary, slices binary"
_QUERIES = "group long, n long, dims int, ids binary, copies binary, parts binary"
_FOUND = "group long, nth int, query_id long, copies long, vec_id long, score long, own boolean"


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, parts): whole components of the vectors that take part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE))
    square = F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    sound = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return sound.where(F.abs(square) < float(1 << 62)).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("parts"))


def _matrix(parts: pa.ListArray) -> np.ndarray:
    """Vectors as rows, padded with zeros to the longest."""
    sizes = np.diff(parts.offsets.to_numpy())
    flat = parts.values.slice(parts.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of ``most`` rows, the last of fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            take = min(batch.num_rows, most - sum(b.num_rows for b in held))
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            if sum(b.num_rows for b in held) == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _chunk(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).chunk(0)


def bit_slices(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lows, slices) of vectors in rows: each attribute's least value, and bitmaps (attribute, bit, word) of what is above it."""
    rows, dims = parts.shape
    lows = parts.min(axis=0, initial=np.iinfo(np.int64).max) if rows else np.zeros(dims, np.int64)
    above = parts - lows
    bits = max(1, int(above.max(initial=0)).bit_length())
    words = -(-rows // 64)
    planes = np.zeros((dims, bits, words * 8), np.uint8)
    for start in range(0, rows, TILE_ROWS):
        part = np.ascontiguousarray(above[start : start + TILE_ROWS].T)
        for b in range(bits):
            packed = np.packbits(((part >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
            planes[:, b, start // 8 : start // 8 + packed.shape[1]] = packed
    return lows, planes.view("<u8")


def signed_digits(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(attribute, weight's bit, whether negative) of the digits of each number, no two neighbours of which are set."""
    whole = np.abs(value).astype(np.int64)
    half = whole >> 1
    more = whole + half
    plus, minus = more & (half ^ more), half & (half ^ more)
    found = []
    for sign, bits in ((False, plus), (True, minus)):
        for bit in range(int(bits.max(initial=0)).bit_length()):
            at = np.flatnonzero((bits >> bit) & 1)
            found.append((at, np.full(len(at), bit), (value[at] < 0) != sign))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def added(planes: np.ndarray, bits: int, dims: int, digits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The slices of the sum, least significant first. ``planes``: the slices of all attributes, then their complements, as rows."""
    at, weight, negative = digits
    first = negative * (dims * bits) + at * bits
    out: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    top = int(weight.max(initial=-1)) + bits
    while len(out) < top or carried:
        place = len(out) - weight
        here = (place >= 0) & (place < bits)
        rows = planes[first[here] + place[here]]
        rows = np.concatenate([rows, *carried]) if carried else rows
        carried = []
        while len(rows) >= 3:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            odd = a ^ b
            carried.append((a & b) | (c & odd))
            rows = np.concatenate([odd ^ c, rows[3 * third :]])
        if len(rows) == 2:
            carried.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        out.append(rows[0] if len(rows) else np.zeros(planes.shape[1], np.uint64))
    return out


def selected(sums: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """The k best rows: sure ones and those that still tie, from the most significant slice down; of the rows that tie at last, the first ones."""
    sure, tied = np.zeros_like(valid), valid
    for plane in reversed(sums):
        high = tied & plane
        n = int(np.bitwise_count(sure).sum() + np.bitwise_count(high).sum())
        if n > k:
            tied = high
        else:
            sure, tied = sure | high, tied & ~plane
            if n == k:
                tied = np.zeros_like(tied)
                break
    rows, more = _rows(sure), _rows(tied)
    return np.concatenate([rows, more[: k - len(rows)]])


def _rows(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].astype("<u8").view(np.uint8), bitorder="little").reshape(len(words), 64)
    at, bit = np.nonzero(bits)
    return words[at] * 64 + bit


def _tile_best(ids: np.ndarray, lows: np.ndarray, slices: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, rows, scores) of the best rows of a tile, for each query. Rows are in order of their ids."""
    dims, bits, words = slices.shape
    planes = np.concatenate([slices, ~slices]).reshape(2 * dims * bits, words)
    valid = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view("<u8")
    full, wrap = (1 << bits) - 1, 1 << 64
    for nth, query in enumerate(queries):
        at, weight, negative = digits = signed_digits(query)
        sums = added(planes, bits, dims, digits)
        rows = selected(sums, valid, k)
        # what the least values and the complements leave out; the sum is exact modulo 2^64 and a score is within a long
        rest = sum(int(q) * int(low) for q, low in zip(query, lows)) - full * sum(1 << int(w) for w in weight[negative])
        score = np.full(len(rows), rest % wrap, np.uint64)
        for bit, plane in enumerate(sums[:64]):
            score += ((plane[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)) << np.uint64(bit)
        yield nth, rows, score.view(np.int64)


def _whole(slices: np.ndarray, lows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows, put together again from their bits."""
    flags = (slices[:, :, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
    return ((flags << np.arange(slices.shape[1], dtype=np.uint64)[:, None]).sum(axis=1).astype(np.int64) + lows[:, None]).T


def _pair_best(block: dict, group: dict, k: int) -> tuple[np.ndarray, ...]:
    """(nth, vec_id, score, own) of the k best rows of a block for each query of a group."""
    ids, lows = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["lows"], np.int64)
    words = -(-len(ids) // 64)
    slices = np.frombuffer(block["slices"], np.uint64).reshape(len(lows), -1, words) if len(lows) else np.zeros((0, 1, words), np.uint64)
    query_ids = np.frombuffer(group["ids"], np.int64)
    whole = np.frombuffer(group["parts"], np.int64).reshape(len(query_ids), group["dims"])
    short = np.zeros((len(whole), len(lows)), np.int64)  # what a query has beyond the block's attributes meets zeros
    short[:, : min(whole.shape[1], len(lows))] = whole[:, : len(lows)]
    beyond = whole[:, len(lows) :].any(axis=1)
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(ids), TILE_ROWS):
        tile, own_ids = slices[:, :, start // 64 : (start + TILE_ROWS) // 64], ids[start : start + TILE_ROWS]
        for nth, rows, score in _tile_best(own_ids, lows, tile, short, k):
            own = (own_ids[rows] == query_ids[nth]) & ~beyond[nth]
            own[own] = (_whole(tile, lows, rows[own]) == short[nth]).all(axis=1)
            found.append((np.full(len(rows), nth), own_ids[rows], score, own))
    nth, vec, score, own = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((~own, vec, -score, nth))
    nth, vec, score, own = nth[order], vec[order], score[order], own[order]
    place = np.arange(len(nth)) - np.searchsorted(nth, nth)
    keep = place < k
    return nth[keep], vec[keep], score[keep], own[keep]


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int | None = None) -> DataFrame:
    """The index: a row for each block, of ``BLOCK_ROWS`` vectors at most, with its ids in order and its slices, written to the shared folder.

    ``blocks`` asks for so many partitions that blocks are built in; by default there are as many as the session shuffles into, if each has 4,096 vectors or more.
    """
    sound = _usable(vectors, id_col, vec_col)
    n = sound.count()
    spread = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096))
    small_batches(vectors.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in enumerate(_gathered(batches, BLOCK_ROWS)):
            ids = _chunk(table, "vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            lows, slices = bit_slices(_matrix(_chunk(table, "parts"))[order])
            block = TaskContext.get().partitionId() << 32 | k
            yield pa.RecordBatch.from_pylist([{"block": block, "n": len(ids), "dims": len(lows), "ids": ids[order].tobytes(), "lows": lows.tobytes(), "slices": slices.tobytes()}], _arrow(_BLOCK))

    return cut(sound.repartition(max(1, blocks or spread, math.ceil(n / BLOCK_ROWS))).mapInArrow(sliced, _BLOCK))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _query_groups(queries: DataFrame, most: int) -> DataFrame:
    """Blocks of queries. Those that are the same in id and vector are one, with the number of its copies."""
    each = queries.groupBy("vec_id", "parts").agg(F.count("*").alias("copies"))
    small_batches(queries.sparkSession)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in enumerate(_gathered(batches, most)):
            parts = _matrix(_chunk(table, "parts"))
            ids, copies = (_chunk(table, c).to_numpy() for c in ("vec_id", "copies"))
            group = TaskContext.get().partitionId() << 32 | k
            yield pa.RecordBatch.from_pylist([{"group": group, "n": len(ids), "dims": parts.shape[1], "ids": ids.tobytes(), "copies": copies.tobytes(), "parts": parts.tobytes()}], _arrow(_QUERIES))

    return cut(each.repartition(max(1, math.ceil(each.count() / most))).mapInArrow(grouped, _QUERIES))


def search(index: DataFrame, vectors: DataFrame, of: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", most: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for each row of ``vectors`` that ``of`` names, or all, if there are fewer."""
    groups = _query_groups(_usable(vectors.where(of), id_col, vec_col), most)
    numbers = lambda df, c: [r[0] for r in df.select(c).collect()]  # noqa: E731  one number for a block of 8,192 queries or 131,072 rows
    blocks, others = numbers(index, "block"), numbers(groups, "group")
    left = index.withColumn("group", F.explode(F.array(*map(F.lit, others)).cast("array<long>")))
    right = groups.withColumn("block", F.explode(F.array(*map(F.lit, blocks)).cast("array<long>")))
    pairs = left.select("block", "group", F.struct("ids", "lows", "slices").alias("vectors")).join(right.select("block", "group", F.struct("dims", "ids", "copies", "parts").alias("queries")), ["block", "group"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                nth, vec, score, own = _pair_best(pair["vectors"], pair["queries"], k + 1)
                ids, copies = (np.frombuffer(pair["queries"][c], np.int64) for c in ("ids", "copies"))
                columns = [np.full(len(nth), pair["group"]), nth.astype(np.int32), ids[nth], copies[nth], vec, score, own]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_arrow(_FOUND))

    query = Window.partitionBy("group", "nth")
    best = pairs.mapInArrow(scored, _FOUND).withColumn("place", F.row_number().over(query.orderBy(F.desc("score"), "vec_id", F.desc("own")))).where(F.col("place") <= k + 1)
    best = best.withColumn("left_out", F.coalesce(F.min(F.when(F.col("own"), F.col("place"))).over(query), F.lit(k + 1)))
    rank = (F.col("place") - (F.col("place") > F.col("left_out")).cast("int")).alias("rank")
    best = best.where("place <> left_out").select("query_id", rank, "vec_id", "score", "copies")
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")
