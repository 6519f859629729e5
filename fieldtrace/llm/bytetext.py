"""Word and shingle hashes of whole texts, computed with numpy over Arrow buffers.

Every operator that needs the words of a text in Python gets them here. A word is a maximal run of bytes other than space
and U+0009..U+000D, with A-Z lower-cased. The 64-bit hash of a word is a difference of prefix sums (a polynomial over random
byte values) that is mixed afterwards, so the cost is a few array passes over the bytes and no Python object per word.

Texts are handled in chunks of about ``CHUNK`` bytes; a longer text makes a chunk of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            table = np.full(max(n, CHUNK + 1), base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of the texts ``lo..hi`` of an array, in order. ``first[i]:first[i+1]`` are the words of the i-th text."""

    lo: int
    hi: int
    buf: np.ndarray  # bytes of all these texts
    bounds: np.ndarray  # byte offsets of the texts in buf, one more than there are texts
    start: np.ndarray  # byte offset of each word in buf
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # word offsets of the texts
    doc: np.ndarray  # text of each word, counted from 0


def text_chunks(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, byte offsets) of runs of texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(texts: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
    for lo, hi, buf, bounds in text_chunks(texts, chunk):
        yield _words(lo, hi, buf, bounds)


def _words(lo: int, hi: int, buf: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(buf)
    inside = ~_BREAK[buf]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    h = range_hashes(buf, start, end)
    first = np.searchsorted(start, bounds).astype(np.int64)
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(lo, hi, buf, bounds, start, end, h, first, doc)


def inner_hashes(w: Words, letter: np.ndarray) -> np.ndarray:
    """Hashes of the words without the bytes before their first letter and after their last; words without a letter keep theirs."""
    at = np.flatnonzero(letter[w.buf])
    if not len(at):
        return w.hash
    first, behind = np.searchsorted(at, w.start), np.searchsorted(at, w.end)
    some = behind > first
    start = np.where(some, at[np.minimum(first, len(at) - 1)], w.start)
    end = np.where(some, at[np.maximum(behind - 1, 0)] + 1, w.end)
    return range_hashes(w.buf, start, end)


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, as those of words."""
    n = len(buf)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[buf] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def sequence_hashes(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``length`` words inside a text, in order."""
    n = len(w.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h += w.hash[k : k + n] * _SHINGLE[k]
    ok = w.doc[:n] == w.doc[length - 1 : length - 1 + n]
    return mix(h[ok]), w.doc[:n][ok]


def shingle_sets(texts: pa.Array, length: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct uint64 shingle hashes) of every text.

    A text of fewer words has its whole word sequence as its only shingle; one without words has none.
    """
    for w in words_of(texts):
        h, doc = sequence_hashes(w, length)
        cuts = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
        count = np.diff(w.first)
        for i in range(w.hi - w.lo):
            if count[i] >= length:
                yield w.lo + i, np.unique(h[cuts[i] : cuts[i + 1]])
            elif count[i]:
                part = w.hash[w.first[i] : w.first[i + 1]]
                whole = (part * _SHINGLE[length : length + len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
                yield w.lo + i, mix(np.array([whole], np.uint64))
            else:
                yield w.lo + i, np.zeros(0, np.uint64)


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
