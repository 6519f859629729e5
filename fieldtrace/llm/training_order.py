"""Token ids in training order: a keyed permutation gives every sequence a global slot, and shards hold the slots in order.

A document's ids, with a separator after them, are cut into sequences of ``length`` ids; the last one is shorter and padded. All
sequences are numbered 0..N-1 by a hash of their id, piece and ids: they are dealt to ranges of the hash, sorted there, and numbered
after the sums of the ranges before. So numbers depend on the documents alone, not on files, partitions or the cluster. A Feistel network
over the smallest even number of bits that holds N permutes the numbers. Where it leaves 0..N-1 it is applied again until it is
back (cycle-walking), which is a permutation of 0..N-1 again. Any slot can be worked out from the key, every key gives another epoch, and a
shard that is lost can be made again.

A shard holds ``rows`` neighbouring slots as one block of bytes with a fixed stride: slot s is at ``s % rows * stride`` of shard
``s // rows``. Sequences are dealt to ranges of shards, whose number grows as the root of the number of shards, and each range is written as
a Parquet file in the order of slots. A record is the document's id (little-endian 64 bits), the piece, the number of ids (32 bits each),
then a null flag of 32 bits and 32 bits of padding, and ``length`` ids of 16 bits. A reader resumes from a slot by
the shard's first slot, which Parquet's statistics prune, and one offset.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import mix, rows_of
from .common import map_arrow, shared_folder, shuffles_removed, slices, small_batches
from .tokens import Tokens

LENGTH = 512
ROWS = 2048
PAD = 50256
ROUNDS = 6
HEAD = 24


def permuted(number: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slot of each number of 0..count-1. The same key gives the same order."""
    if count <= 1:
        return np.zeros(len(number), np.int64)
    half = np.uint64(max(1, -(-(count - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.uint64(key & (1 << 64) - 1) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << half | right

    out = network(number.astype(np.uint64))
    while len(far := np.flatnonzero(out >= np.uint64(count))):
        out[far] = network(out[far])
    return out.astype(np.int64)


def stride(length: int) -> int:
    return HEAD + 2 * length


def sequences(docs: DataFrame, id_col: str, text_col: str, length: int, end: int) -> DataFrame:
    """(id, piece, n_ids, ids) of every sequence; ``ids`` as unsigned 16-bit integers without padding."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("n_ids", pa.int32()), ("ids", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in slices(batches, 1 << 20):
            made: list[list] = [[] for _ in schema]
            for i, text in zip(rows_of(batch, "id").to_pylist(), rows_of(batch, "text").to_pylist(), strict=True):
                whole = np.frombuffer(tokens.encode(text or "", end), "<u4")
                if int(whole.max(initial=0)) > 0xFFFF:
                    raise ValueError("a token id needs more than the 16 bits of a record")
                ids = whole.astype("<u2")
                for k, a in enumerate(range(0, len(ids), length)):
                    piece = ids[a : a + length]
                    for column, value in zip(made, (i, k, len(piece), piece.tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    # records have a number of 64 bits for the id: other kinds of id fail here rather than become null
    rows = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(id_col).alias("given"), F.col(text_col).cast("string").alias("text"))
    checked = F.when(F.col("given").isNotNull() & F.col("id").isNull(), F.raise_error(F.lit("an id isn't a number of 64 bits"))).otherwise(F.col("id"))
    return rows.select(checked.cast("long").alias("id"), "text").mapInArrow(over, "id long, piece int, n_ids int, ids binary")


def _ranked(made: DataFrame) -> DataFrame:
    """Adds ``part``, the range of a hash of the sequence, and ``rank``, its place by that hash in the range. Equal sequences may swap places."""
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = made.withColumn("hash", F.xxhash64("id", "piece", "ids"))
    part = F.floor(F.shiftrightunsigned("hash", 32) * parts / F.lit(1 << 32)).cast("int")
    # ranges are cut by the hash as an unsigned number, so rows are sorted by it as one: the order is the same whatever the number of ranges
    hashed = hashed.withColumns({"part": part, "hash": F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))})
    dealt = hashed.repartitionById(parts, "part").sortWithinPartitions("part", "hash", "id", "piece", "ids")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, seen = None, 0, 0
        for batch in batches:
            ranks = []
            for p in rows_of(batch, "part").to_pylist():
                if p != now:
                    now, begun = p, seen
                ranks.append(seen - begun)
                seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], names=[*batch.schema.names, "rank"])

    return dealt.drop("hash").mapInArrow(over, "id long, piece int, n_ids int, ids binary, part int, rank long")


def _written(df: DataFrame, path: str) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.parquet(path)


def _slots(numbered: DataFrame, count: int, key: int) -> DataFrame:
    def over(batch: pa.RecordBatch):
        slot = permuted(rows_of(batch, "number").to_numpy(), count, key)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], names=[*batch.schema.names, "slot"])

    return map_arrow(numbered, over, ", ".join(f"{c} {t}" for c, t in numbered.dtypes) + ", slot long")


def shards(docs: DataFrame, key: int, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, rows: int = ROWS, end: int = 2, pad: int = PAD) -> DataFrame:
    """Writes the shards to ``path``/shards, beside what was numbered for them, and gives them back: shard, first_slot, n, stride, data.

    A null text counts as empty and is a sequence of the separator alone. Repeated ids and rows are sequences of their own. A text of
    any length is cut into as many sequences as it takes. Other columns are ignored, whatever their names; an empty table gives no
    shard. Ids are numbers of 64 bits, or text that is one; another id or a token id beyond 16 bits is an error.
    """
    made = _written(_ranked(sequences(docs, id_col, text_col, length, end)), f"{path}/numbered")
    # one row for each range of hashes, as many as there are shuffle partitions
    by_part = made.groupBy("part").agg(F.count("*").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    count = made.count()
    numbered = made.join(F.broadcast(before), "part").withColumn("number", F.col("rank") + F.col("before")).drop("part", "rank", "before")
    n_shards = max(1, -(-count // rows))
    each = -(-n_shards // tasks_for(n_shards))  # shards of a task
    placed = _slots(numbered, count, key).withColumn("task", F.floor(F.col("slot") / (rows * each)).cast("int"))
    held = placed.repartitionById(-(-n_shards // each), "task").sortWithinPartitions("slot")
    size = stride(length)
    schema = pa.schema([("shard", pa.int32()), ("first_slot", pa.int64()), ("n", pa.int64()), ("stride", pa.int32()), ("data", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, n = None, bytearray(), 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([now], [now * rows], [n], [size], [bytes(data)]), schema, strict=True)], schema=schema)

        for batch in slices(batches, 1 << 20):
            for i, piece, n_ids, ids, _, slot in zip(*(rows_of(batch, c).to_pylist() for c in ("id", "piece", "n_ids", "ids", "number", "slot")), strict=True):
                if slot // rows != now:
                    if now is not None:
                        yield full()
                    now, data, n = slot // rows, bytearray(), 0
                data += np.array([i or 0], "<i8").tobytes() + np.array([piece, n_ids, i is None, 0], "<i4").tobytes()
                data += ids + np.full(length - n_ids, pad, "<u2").tobytes()
                n += 1
        if now is not None:
            yield full()

    blocked = held.select("id", "piece", "n_ids", "ids", "number", "slot").mapInArrow(blocks, "shard int, first_slot long, n long, stride int, data binary")
    return _written(blocked, f"{path}/shards")


def tasks_for(n_shards: int) -> int:
    """How many tasks write so many shards: four times the root, so that neither tasks nor what one of them holds grow in proportion."""
    return min(n_shards, math.isqrt(16 * n_shards - 1) + 1) if n_shards else 0


def new_folder(docs: DataFrame) -> str:
    """A folder of its own below the one that the executors share."""
    return f"{shared_folder(docs.sparkSession)}/training-order-{uuid.uuid4().hex}"


def records(shard_rows: DataFrame, from_slot: int = 0, id_col: str = "doc_id") -> DataFrame:
    """What shards hold from a slot on, in order inside each shard: slot, shard, at (byte offset), id, piece, n_ids, ids, ids_crc32."""
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("n_ids", pa.int32()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def over(batch: pa.RecordBatch):
        for shard, first, n, size, data in zip(*(rows_of(batch, c).to_pylist() for c in ("shard", "first_slot", "n", "stride", "data")), strict=True):
            made: list[list] = [[] for _ in schema]
            for k in range(max(0, from_slot - first), n):
                at = k * size
                piece, n_ids, none, _ = np.frombuffer(data, "<i4", 4, at + 8).tolist()
                ids = data[at + HEAD : at + HEAD + 2 * n_ids]
                row = (first + k, shard, at, None if none else int(np.frombuffer(data, "<i8", 1, at)[0]), piece, n_ids, ids, zlib.crc32(ids))
                for column, value in zip(made, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    wanted = shard_rows.where(F.col("first_slot") + F.col("n") > from_slot)
    return map_arrow(wanted, over, "slot long, shard int, at long, id long, piece int, n_ids int, ids binary, ids_crc32 long").withColumnRenamed("id", id_col)
