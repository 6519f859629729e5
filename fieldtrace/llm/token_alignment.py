"""Alignment of two tokenizers over the bytes of each text, by byte-owner arrays.

Each byte of a text is owned by one token of A and one of B: ``np.repeat`` of the tokens' numbers by their lengths gives both arrays. Where the
pair of owners changes, a pair of overlapping tokens begins (a link); where both change at once, both tokenizers cut, and the tokens between two
such cuts are a group. A is the byte-level BPE vocabulary over a space and the text, B the sentence-piece model over the text, which adds the space.

Counts of linked id pairs are of the whole corpus. Texts are taken in chunks of a few MB: a chunk's distinct pairs, with how often each
occurs there, are what is counted, and the pairs of the vocabulary, of which there are at most as many as |A| times |B|, meet the chunks' pairs in a join by pair. A chunk's documents
name their pairs by place in the chunk's list, so neither tokens nor links are ever shuffled, and a frequent pair is one row a chunk.

A text has no tokens if it is null or empty, or if the bytes that A's or B's tokens stand for, joined, aren't those of the space and the text
(a text whose white space B changes, for example): all its numbers are 0 and its hash is the empty string. The strings of special tokens inside
texts are plain text. Repeated rows and rows without an id each get their own row, in the same way; an empty table gives none; other columns
don't matter. The rows of a text of any length stay in one chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut, slices, small_batches
from .tokens import Tokens

#: Bytes of text of a chunk, unless a single text has more.
CHUNK_BYTES = 8 << 20
#: A pair is one number: A's id times this, and B's id.
PAIR = 1 << 32

MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    own = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    others = [b for b in range(256) if b not in own]
    return {c: b for b, c in (own | {b: chr(256 + k) for k, b in enumerate(others)}).items()}


class Pair:
    """Both tokenizers: ids of a text, and the bytes of each id."""

    def __init__(self, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k") -> None:
        import public_tokenizers
        import sentencepiece

        self.a = Tokens(a)
        alphabet = _byte_of()
        entries = self.a.whole.get_vocab()
        special = set(self.a.special)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = entry.encode() if entry in special else bytes(alphabet[c] for c in entry)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{b}.model"))
        pieces = (self.b.id_to_piece(k) for k in range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # ids in decimal, each with what can follow it: nothing, the next of its side, the other side, the next group
        self.written = np.array([[f"{k}{end}" for end in ("", ",", "|", ";")] for k in range(max(len(self.a_bytes), len(self.b_bytes)))], object)

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both, or None where the text has no tokens."""
        if not text:
            return None
        whole = " " + text
        a = np.array(self.a.plain.encode_ordinary(whole), np.int64)
        b = np.array(self.b.encode(text, num_threads=1), np.int64)
        raw = whole.encode()
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join([table[k] for k in ids.tolist()]) != raw:
                return None
        return a, b


def aligned(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A's token, B's token) of each link, and the group of each token of A and of B, from the tokens' lengths in bytes."""
    a_owner = np.repeat(np.arange(len(a_sizes)), a_sizes)
    b_owner = np.repeat(np.arange(len(b_sizes)), b_sizes)
    a_new, b_new = np.diff(a_owner, prepend=-1) != 0, np.diff(b_owner, prepend=-1) != 0
    links = np.flatnonzero(a_new | b_new)
    group = np.cumsum(a_new & b_new) - 1
    return a_owner[links], b_owner[links], group[np.flatnonzero(a_new)], group[np.flatnonzero(b_new)]


def groups_text(written: np.ndarray, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, A's and then B's."""
    ids = np.concatenate([a, b])
    part = np.concatenate([2 * a_group, 2 * b_group + 1])
    order = np.argsort(part, kind="stable")
    ids, part = ids[order], part[order]
    follows = np.diff(part, append=part[-1])
    end = np.where(follows == 0, 1, np.where(part % 2 == 0, 2, 3))
    end[-1] = 0
    return "".join(written[ids, end].tolist())


@cache
def _pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    return numbers.astype(kind).tobytes()


def _chunked(batches: Iterator[pa.RecordBatch], schema: pa.Schema, a: str, b: str, most: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its documents with their measures and links, and its distinct pairs with how often each occurs."""
    both = _pair(a, b)
    docs: list[dict] = []
    links: list[np.ndarray] = []
    size = made = 0

    def chunk() -> pa.RecordBatch:
        every = np.concatenate(links) if links else np.zeros(0, np.int64)
        pairs, place, times = np.unique(every, return_inverse=True, return_counts=True)
        at = 0
        for doc in docs:
            own = np.sort(place[at : at + doc["n_links"]])
            at += doc["n_links"]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            doc["places"], doc["repeats"] = _packed(own[first], "<i4"), _packed(np.diff(first, append=len(own)), "<i4")
        number = TaskContext.get().partitionId() << 32 | made
        return pa.RecordBatch.from_pylist([{"chunk": number, "docs": docs, "pairs": pairs.tolist(), "times": times.tolist()}], schema)

    for batch in slices(batches):
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if docs and size + len(text or "") > most:
                yield chunk()
                docs, links, size, made = [], [], 0, made + 1
            doc = {"doc_id": doc_id, **dict.fromkeys(MEASURES, 0), "groups_sha256": ""}
            if (found := both.ids(text)) is not None:
                one, other = found
                left, right, one_group, other_group = aligned(both.a_sizes[one], both.b_sizes[other])
                links.append(one[left] * PAIR + other[right])
                said = groups_text(both.written, one, other, one_group, other_group)
                doc |= {"n_a": len(one), "n_b": len(other), "n_groups": int(one_group[-1]) + 1, "n_links": len(left), "groups_sha256": hashlib.sha256(said.encode()).hexdigest()}
            docs.append(doc)
            size += len(text or "")
    if docs:
        yield chunk()


def _summed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents of chunks, with the counts of their links summed up."""
    for batch in batches:
        for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
            known, docs = row.column("known"), row.column("docs").values
            known = known.values.slice(known.offsets[0].as_py(), known.offsets[1].as_py() - known.offsets[0].as_py()) if known.is_valid().to_pylist()[0] else None
            total = known.field("total").to_numpy() if known is not None else np.zeros(0, np.int64)
            best = known.field("best").to_numpy(zero_copy_only=False) if known is not None else np.zeros(0, bool)
            first, last = (row.column("docs").offsets[k].as_py() for k in (0, 1))
            out = {name: [] for name in schema.names}
            for doc in docs.slice(first, last - first).to_pylist():
                place, times = (np.frombuffer(doc[c], "<i4").astype(np.int64) for c in ("places", "repeats"))
                for name in ("doc_id", *MEASURES, "groups_sha256"):
                    out[name].append(doc[name])
                out["n_best"].append(int(times[best[place]].sum()))
                out["count_sum"].append(int((total[place] * times).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, total, best): how many links of the corpus hold each pair of ids linked, and whether no pair of its B id has more."""
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("total"))
    # a B id has as many pairs as A has ids, at most
    most = F.max("total").over(Window.partitionBy(F.col("pair") % PAIR))
    return counts.withColumn("best", F.col("total") == most)


def align(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", most: int = CHUNK_BYTES) -> DataFrame:
    """For each row of (doc_id, text): tokens of both, groups, links, links whose pair is the most frequent one of its B id, the sum of the links' counts and the hash of the groups."""
    kind = docs.schema["doc_id"].dataType
    numbers = [StructField(c, LongType()) for c in MEASURES]
    doc = StructType([StructField("doc_id", kind), *numbers, StructField("groups_sha256", StringType()), StructField("places", BinaryType()), StructField("repeats", BinaryType())])
    chunk = StructType([StructField("chunk", LongType()), StructField("docs", ArrayType(doc)), StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(LongType()))])
    result = StructType([StructField("doc_id", kind), *numbers, StructField("n_best", LongType()), StructField("count_sum", LongType()), StructField("groups_sha256", StringType())])
    chunk_arrow, result_arrow = to_arrow_schema(chunk), to_arrow_schema(result)
    small_batches(docs.sparkSession)
    chunks = cut(docs.select("doc_id", "text").mapInArrow(lambda batches: _chunked(batches, chunk_arrow, a, b, most), chunk))
    own = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    known = own.join(pair_counts(chunks), "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("known"))
    met = chunks.select("chunk", "docs").join(known, "chunk", "left").select("docs", "known")
    return met.mapInArrow(lambda batches: _summed(batches, result_arrow), result)
