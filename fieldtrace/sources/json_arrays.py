"""Elements of the arrays of huge JSON files, read by ranges of bytes.

A range may begin anywhere: inside a text, behind a backslash, at any depth. So a first job looks at every range twice, as if it began outside a text and as
if it began inside one, and gives a few numbers for each; these are put in order, from the first range to the last, which tells how each one
really begins. A second job then gives the elements that begin in each range. Neither a file nor an array is ever one value: a task
holds a block and the element that it is at, whatever the order of keys, the nesting of arrays or what stands between the elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20
#: A key and its bracket may stand so many bytes apart.
_SPAN = 256


@lru_cache(8)
def _opened(path: str):
    fs, place = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(place)


class Scanner:
    """Walks over blocks of a file and knows what is outside of texts, and at which depth."""

    def __init__(self, in_text: bool, depth: int = 0, slashes: int = 0) -> None:
        self.in_text, self.depth, self.slashes = in_text, depth, slashes

    def feed(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, whether they open, depths after them) of the brackets outside of texts, and the places of quotes that begin or end a text; moves on behind ``data``."""
        b = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(b == 34)
        slash = b == 92
        if slash.any() or self.slashes:
            plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))
            before = np.concatenate([[-1], plain[:-1]])
            run = quotes - 1 - before[quotes] + np.where(before[quotes] < 0, self.slashes, 0)
            quotes = quotes[run % 2 == 0]
            self.slashes = len(b) - 1 - int(plain[-1]) + (self.slashes if plain[-1] < 0 else 0)
        at = np.flatnonzero((b == 123) | (b == 125) | (b == 91) | (b == 93))
        at = at[(np.searchsorted(quotes, at) + self.in_text) % 2 == 0]
        opens = (b[at] == 123) | (b[at] == 91)
        depth = self.depth + np.cumsum(np.where(opens, 1, -1))
        self.before, self.began_in_text = self.depth, self.in_text
        self.in_text ^= bool(len(quotes) % 2)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return at, opens, depth, quotes

    def arrays(self, data: bytes, rest: bytes, key: re.Pattern, at: np.ndarray, depth: np.ndarray, quotes: np.ndarray) -> list[tuple[int, int]]:
        """(place, depth inside) of the arrays named ``key`` that begin in the block last fed; ``rest`` is what follows it."""
        found = []
        for m in key.finditer(data + rest[:_SPAN]):
            if m.start() < len(data) and (int(np.searchsorted(quotes, m.start())) + self.began_in_text) % 2 == 0:
                k = int(np.searchsorted(at, m.start()))
                found.append((m.start(), (int(depth[k - 1]) if k else self.before) + 1))
        return found


def _pattern(key: str) -> re.Pattern:
    return re.compile(rb'"' + re.escape(key.encode()) + rb'"\s{0,64}:\s{0,64}\[')


def _blocks(path: str, start: int, stop: int) -> Iterator[tuple[bytes, bytes]]:
    """Blocks of a range, each with what follows it."""
    file = _opened(path)
    for a in range(start, stop, BLOCK_BYTES):
        data = file.read_at(min(BLOCK_BYTES, stop - a) + _SPAN, a)
        yield data[: min(BLOCK_BYTES, stop - a)], data[min(BLOCK_BYTES, stop - a) :]


def slashes_before(path: str, start: int) -> int:
    """How many backslashes stand right before a place."""
    file, n = _opened(path), 0
    while start - n > 0:
        size = min(4096, start - n)
        tail = file.read_at(size, start - n - size)
        own = len(tail) - len(tail.rstrip(b"\\"))
        n += own
        if own < size:
            break
    return n


def summary(path: str, start: int, stop: int, key: str, in_text: bool) -> dict:
    """How a range changes the state: whether texts are turned over, the change of depth, and its arrays with the least depth before each and after the last."""
    scan, low, lows, arrays, pattern = Scanner(in_text, 0, slashes_before(path, start)), 1 << 30, [], [], _pattern(key)
    for data, rest in _blocks(path, start, stop):
        at, _, depth, quotes = scan.feed(data)
        for place, inside in scan.arrays(data, rest, pattern, at, depth, quotes):
            k = int(np.searchsorted(at, place))
            seen = depth[:k]
            lows.append(min(low, int(seen.min())) if len(seen) else low)
            arrays.append(inside)
            at, depth, low = at[k:], depth[k:], 1 << 30
        low = min(low, int(depth.min())) if len(depth) else low
    return {"turned": scan.in_text != in_text, "depth": scan.depth, "lows": [*lows, low], "arrays": arrays}


def following(state: tuple[bool, int, int], s: dict) -> tuple[bool, int, int]:
    """The state (in a text, depth, depth inside the open array or -1) behind a range."""
    in_text, depth, inside = state
    for k, low in enumerate(s["lows"]):
        if inside >= 0 and depth + low < inside:
            inside = -1
        if k < len(s["arrays"]) and inside < 0:
            inside = depth + s["arrays"][k]
    return in_text != s["turned"], depth + s["depth"], inside


def texts_of(path: str, start: int, stop: int, size: int, key: str, state: tuple[bool, int, int]) -> Iterator[bytes]:
    """The elements, objects right inside an array named ``key``, that begin in a range; the last is read to its end."""
    in_text, depth, inside = state
    scan, pattern, base, held, taken = Scanner(in_text, depth, slashes_before(path, start)), _pattern(key), start, None, []
    for data, rest in _blocks(path, start, size):
        if base >= stop and held is None:
            return
        at, opens, depths, quotes = scan.feed(data)
        arrays = scan.arrays(data, rest, pattern, at, depths, quotes)
        k = first = 0
        while True:
            if inside < 0:
                coming = next(((p, d) for p, d in arrays if p >= first), None)
                if coming is None:
                    break
                first, inside = coming
                k = int(np.searchsorted(at, first))
            own = depths[k:]
            gone = np.flatnonzero(own < inside)
            end = k + int(gone[0]) if len(gone) else len(at)
            edge = np.flatnonzero((opens[k:end] & (own[: end - k] == inside + 1)) | (~opens[k:end] & (own[: end - k] == inside))) + k
            for i in edge.tolist():
                if opens[i]:
                    held = int(at[i]) if data[at[i]] == 123 and base + at[i] < stop else None
                elif held is not None:
                    yield b"".join(taken) + data[held : at[i] + 1]
                    held, taken = None, []
            if end == len(at):
                break
            k, first, inside = end + 1, int(at[end]) + 1, -1
        if held is not None:
            taken.append(data[held:])
            held = 0
        base += len(data)


def elements(spark: SparkSession, path: str, key: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects that stand right inside the arrays named ``key`` of JSON files, wherever those are nested, one row each by ``schema``.

    An array of that name inside such an array isn't looked into. What stands between elements is left out, unless it leaves quotes or brackets open. An
    object that the parser can't read gives a row of nulls. Paths are those that pyarrow opens: shared folders, S3, GCS, HDFS.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))).withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size")))
    ranges = ranges.repartition(max(1, min(2000, ranges.count())), "path", "start")

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                both = [summary(r["path"], r["start"], r["stop"], key, t) for t in (False, True)]
                yield pa.RecordBatch.from_pylist([{"path": r["path"], "start": r["start"], "turned": [s["turned"] for s in both], "depth": [s["depth"] for s in both], "lows": [s["lows"] for s in both], "arrays": [s["arrays"] for s in both]}], _SUMMARY)

    # a few numbers for each range, so one row for each ``range_bytes`` of all files
    found = ranges.mapInArrow(looked_at, "path string, start long, turned array<boolean>, depth array<long>, lows array<array<long>>, arrays array<array<long>>").collect()
    states, state, now = [], (False, 0, -1), None
    for r in sorted(found, key=lambda r: (r.path, r.start)):
        state = state if r.path == now else (False, 0, -1)
        states.append((r.path, r.start, *state))
        now, t = r.path, int(state[0])
        state = following(state, {"turned": r.turned[t], "depth": r.depth[t], "lows": r.lows[t], "arrays": r.arrays[t]})
    begins = spark.createDataFrame(states, "path string, start long, in_text boolean, depth long, inside long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                texts: list[str] = []
                for t in texts_of(r["path"], r["start"], r["stop"], r["size"], key, (r["in_text"], r["depth"], r["inside"])):
                    texts.append(t.decode("utf-8", "replace"))
                    if len(texts) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(texts)], names=["element"])
                        texts = []
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["element"])

    texts = ranges.join(begins, ["path", "start"]).mapInArrow(read, "element string")
    return texts.select(F.from_json("element", schema).alias("e")).select("e.*")


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("turned", pa.list_(pa.bool_())), ("depth", pa.list_(pa.int64())), ("lows", pa.list_(pa.list_(pa.int64()))), ("arrays", pa.list_(pa.list_(pa.int64())))])
