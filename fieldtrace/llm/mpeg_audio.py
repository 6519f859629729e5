"""MPEG audio columns: streams written frame by frame, and read back by resynchronising on frame headers.

``store`` puts bytes into a valid MPEG-1 Layer III stream: an ID3v2 tag, a Xing frame with the table of a variable bitrate, and
frames with a checksum whose side information says silence, so the payload is ancillary data that a decoder skips. ``read`` knows
nothing of how a stream was made. It finds ID3v1 and ID3v2 tags, resynchronises on headers (a header counts if another of the same
version, layer and rate follows where its length says, or the stream ends there), parses Xing, Info and VBRI tables, verifies
the CRC-16 of protected frames, and gives exact durations and the seek offset of every ``seek`` frames.

Bytes, not texts, are the interface; a stream is handled by itself, so memory is bounded by the longest one.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytetext import rows_of
from .common import map_arrow

#: Fixed values of the format. Bitrates in kbit/s by (MPEG-1?, layer), rates in Hz by version bits, samples by (MPEG-1?, layer).
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

# What the writer uses: MPEG-1 Layer III with checksums, 48 kHz, mono. A frame of b kbit/s has 3 * b bytes.
HEAD, SIDE = 6, 17
FRAME_BYTES = np.array([3 * k for k in KBITS[True, 3]])
SEEK = 16


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for x in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ x]
    return c


def _head(bitrate: int) -> bytes:
    """Header and checksum of a silent frame with the given index of bitrate."""
    two = bytes([bitrate << 4 | 1 << 2, 0xC0])
    return b"\xff\xfa" + two + crc16(two + bytes(SIDE)).to_bytes(2, "big")


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum of the first ``bits`` bits."""
    c = crc16(data[: bits // 8])
    for k in range(bits - bits % 8, bits):
        top = (c >> 15) ^ (data[k // 8] >> (7 - k % 8) & 1)
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if top else 0)
    return c


#: Fixed values of layer II: bits of an allocation for runs of subbands (bits, subbands).
ALLOCATIONS = {
    "high": ((4, 11), (3, 12), (2, 7)),
    "middle": ((4, 11), (3, 12), (2, 4)),
    "low": ((4, 2), (3, 6)),
    "low, 32 kHz": ((4, 2), (3, 10)),
    "half rates": ((4, 4), (3, 7), (2, 19)),
}


_HEADS = [_head(k) for k in range(15)]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def store(payload: bytes) -> bytes:
    """A stream that holds ``payload``; ``payload_of`` gives it back."""
    room = int(FRAME_BYTES[14]) - HEAD - SIDE
    parts, at, offsets = [], 0, []
    pos = 0
    while pos < len(payload):
        chunk = payload[pos : pos + room]
        k = int(np.searchsorted(FRAME_BYTES[1:], len(chunk) + HEAD + SIDE)) + 1
        offsets.append(at)
        parts += [_HEADS[k], bytes(SIDE), chunk, bytes(int(FRAME_BYTES[k]) - HEAD - SIDE - len(chunk))]
        at += int(FRAME_BYTES[k])
        pos += len(chunk)
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + _synchsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _synchsafe(len(frame)) + frame
    k = int(np.searchsorted(FRAME_BYTES[1:], HEAD + SIDE + 120)) + 1
    first = int(FRAME_BYTES[k])
    total = first + at
    n = len(offsets)
    toc = bytes(min(255, (first + offsets[i * n // 100]) * 256 // total) if n else 0 for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    xing = _HEADS[k] + bytes(SIDE) + table
    return b"".join([tag, xing, bytes(first - len(xing)), *parts])


class Header:
    """The fields of four bytes that may be a frame header; ``size`` is 0 if they aren't one (free formats have no size)."""

    __slots__ = ("kbits", "layer", "mode", "mono", "one", "protected", "rate", "samples", "shared_from", "size", "version")

    def __init__(self, b: bytes, at: int):
        self.size = 0
        if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
            return
        version, layer, kbit, rate = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 4, b[at + 2] >> 2 & 3
        if version == 1 or layer == 4 or kbit in (0, 15) or rate == 3:
            return
        self.version, self.layer, self.rate, self.one = version, layer, RATES[version][rate], version == 3
        self.protected, self.mono = not b[at + 1] & 1, b[at + 3] >> 6 == 3
        self.samples = SAMPLES[self.one, layer]
        self.kbits, self.mode, self.shared_from = KBITS[self.one, layer][kbit], b[at + 3] >> 6, 4 * ((b[at + 3] >> 4 & 3) + 1)
        padding, bits = b[at + 2] >> 1 & 1, self.kbits * 1000
        self.size = (12 * bits // self.rate + padding) * 4 if layer == 1 else self.samples // 8 * bits // self.rate + padding

    @property
    def side(self) -> int:
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.one else (9 if self.mono else 17)

    def protected_bits(self, body: bytes) -> int:
        """How many bits of what follows the checksum it covers: allocations and, in layer II, the choices of scale factors; the side information in layer III."""
        if self.layer == 3:
            return 8 * self.side
        channels = 1 if self.mono else 2
        if self.layer == 1:
            shared = self.shared_from if self.mode == 1 else 32
            return 4 * (shared * channels + 32 - shared)
        each = self.kbits // channels
        kind = "half rates" if not self.one else ("low, 32 kHz" if self.rate == 32000 else "low") if each <= 48 else "middle" if each <= 80 or self.rate == 48000 else "high"
        widths = [w for w, n in ALLOCATIONS[kind] for _ in range(n)]
        shared = min(self.shared_from, len(widths)) if self.mode == 1 else len(widths)
        value, at, chosen = int.from_bytes(body[:48], "big"), 0, 0
        for k, w in enumerate(widths):
            for _ in range(channels if k < shared else 1):
                some = value >> (8 * len(body[:48]) - at - w) & ((1 << w) - 1) if at + w <= 8 * len(body[:48]) else 0
                chosen += bool(some) * (1 if k < shared else channels)
                at += w
        return at + 2 * chosen

    def like(self, other: Header) -> bool:
        return self.size > 0 and (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


def _tags(b: bytes) -> tuple[int, int, dict[str, str]]:
    """(start of the audio, its end, tag fields)."""
    start, end, fields = 0, len(b), {}
    while b[start : start + 3] == b"ID3" and start + 10 <= end and max(b[start + 6 : start + 10], default=128) < 128:
        size = sum(x << s for x, s in zip(b[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        at, stop, major = start + 10, min(start + 10 + size, end), b[start + 3]
        while at + 10 <= stop and b[at] and major >= 3:
            n = sum(x << s for x, s in zip(b[at + 4 : at + 8], (21, 14, 7, 0) if major == 4 else (24, 16, 8, 0), strict=True))
            body = b[at + 10 : min(at + 10 + n, stop)]
            if b[at : at + 1] == b"T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").strip("\0")
                name, _, value = text.partition("\0") if b[at : at + 4] == b"TXXX" else (b[at : at + 4].decode("latin-1"), "", text)
                fields[name] = value
            at += 10 + n
        start = start + 10 + size + (10 if b[start + 5] & 16 else 0)
    if end - start >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
        fields.setdefault("TIT2", b[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    return min(start, end), end, fields


def read(b: bytes, seek: int = SEEK) -> dict:
    """Tags, table, frames, checksums, durations and seek offsets of a stream. Bytes without a frame give zeros."""
    start, end, fields = _tags(b)
    out = {"tags": fields, "audio_start": start, "audio_end": end, "frames": [], "skipped": 0, "table": "", "table_frames": None, "table_bytes": None, "toc": b"", "checked": 0, "wrong": 0, "samples": 0, "micros": 0}
    at, known, ticks = start, None, {}
    while at + 4 <= end:
        h = Header(b, at)
        fits = h.size and at + h.size <= end and (known is None or h.like(known))
        if fits and known is None and at + h.size + 4 <= end:
            fits = Header(b, at + h.size).like(h)
        if not fits:  # resynchronise at the next byte that may begin a header
            nxt = b.find(b"\xff", at + 1, end)
            out["skipped"] += (nxt if nxt >= 0 else end) - at
            if nxt < 0:
                at = end
                break
            at = nxt
            continue
        if known is None:
            known = h
        body = at + 4 + 2 * h.protected
        if h.protected:
            bits = 16 + h.protected_bits(b[body : at + h.size])
            covered = b[at + 2 : at + 4] + b[body : body + (bits + 7) // 8 - 2]
            out["checked"] += 1
            out["wrong"] += 8 * len(covered) < bits or crc16_bits(covered, bits) != int.from_bytes(b[at + 4 : at + 6], "big")
        if not out["frames"] and not out["table"]:
            mark, vbri = body + h.side, at + 36
            if b[mark : mark + 4] in (b"Xing", b"Info"):
                flags = int.from_bytes(b[mark + 4 : mark + 8], "big")
                p = mark + 8
                for bit, name in ((1, "table_frames"), (2, "table_bytes")):
                    if flags & bit:
                        out[name], p = int.from_bytes(b[p : p + 4], "big"), p + 4
                out["toc"] = b[p : p + 100] if flags & 4 else b""
                out["table"] = b[mark : mark + 4].decode()
            elif b[vbri : vbri + 4] == b"VBRI":
                out["table"], out["table_bytes"], out["table_frames"] = "VBRI", *struct.unpack(">II", b[vbri + 10 : vbri + 18])
            if out["table"]:
                out["table_size"] = h.size
                at += h.size
                continue
        out["frames"].append((at, h.size, body + h.side))
        ticks[h.rate] = ticks.get(h.rate, 0) + h.samples
        at += h.size
    out["skipped"] += end - at if at < end else 0
    out["samples"] = sum(ticks.values())
    out["rate"] = known.rate if known else 0
    out["micros"] = sum(n * 1_000_000 // r for r, n in ticks.items())
    out["layer"], out["version"] = (known.layer, {3: "1", 2: "2", 0: "2.5"}[known.version]) if known else (0, "")
    out["seek"] = [f[0] for f in out["frames"][::seek]]
    return out


def payload_of(b: bytes, info: dict | None = None) -> bytes:
    """What ``store`` put into a stream: the ancillary bytes of its frames, as many as its tag says."""
    info = info or read(b)
    whole = b"".join(b[body : at + size] for at, size, body in info["frames"])
    return whole[: int(info["tags"].get("payload_bytes", len(whole)))]


def feature(info: dict) -> str:
    """One line of what ``read`` found: version and layer, frames, samples, duration, table, checksums, and the number and the hash of all seek offsets."""
    import hashlib

    return (
        f"mpeg{info['version']}-layer{info['layer']};rate={info['rate']};frames={len(info['frames'])};samples={info['samples']};us={info['micros']};"
        f"table={info['table']}:{info['table_frames']}:{info['table_bytes']};crc={info['checked'] - info['wrong']}/{info['checked']};skipped={info['skipped']};"
        f"seek={len(info['seek'])}:{hashlib.sha256(','.join(map(str, info['seek'])).encode()).hexdigest()[:16]}"
    )


def encode_column(rows: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``rows`` with the column ``media``: a stream that holds the bytes of ``payload``. Null becomes null."""
    schema = rows.schema

    def over(batch: pa.RecordBatch):
        made = [None if p is None else store(p) for p in rows_of(batch, payload).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.large_binary())], names=[*batch.schema.names, media])

    return map_arrow(rows, over, _ddl(schema, f"`{media}` binary"))


def _ddl(schema, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [more])


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as UTF-8, with zero bytes up to a positive multiple of 64, stored as a stream."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("payload"))
    schema = f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary"

    def over(batch: pa.RecordBatch):
        n, made = [], []
        for p in rows_of(batch, "payload").to_pylist():
            n.append(len(p))
            made.append(store(p + bytes(-len(p) % 64 if p else 64)))
        yield pa.RecordBatch.from_arrays([rows_of(batch, "id"), pa.array(n, pa.int64()), pa.array(made, pa.large_binary())], names=["id", "n_bytes", "media"])

    return map_arrow(rows, over, schema)


def described(rows: DataFrame) -> DataFrame:
    """What is read from the column ``media`` of ``streams``: digests, counts, duration, all seek offsets and the feature line."""
    import hashlib
    import zlib

    schema = pa.schema([("id", to_arrow_type(rows.schema["id"].dataType)), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_us", pa.int64()), ("seek_offsets", pa.list_(pa.int64()))])

    def over(batch: pa.RecordBatch):
        made: list[list] = [[] for _ in schema]
        for i, n, b in zip(rows_of(batch, "id").to_pylist(), rows_of(batch, "n_bytes").to_pylist(), rows_of(batch, "media").to_pylist(), strict=True):
            info = read(b)
            p = payload_of(b, info)
            row = (i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(b), hashlib.sha256(b).hexdigest(), feature(info), info["micros"], info["seek"])
            for column, value in zip(made, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    kinds = f"id {dict(rows.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, seek_offsets array<long>"
    return map_arrow(rows, over, kinds)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: what ``described`` gives, with the id's own name.

    Null and empty texts have a payload of 64 zero bytes. Equal texts give equal values; repeated ids and rows are kept as they are, and ids keep their type.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    return described(streams(docs, id_col, text_col)).withColumnRenamed("id", id_col)
