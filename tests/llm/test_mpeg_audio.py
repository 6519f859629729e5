import hashlib
import random
import zlib

import pytest

from fieldtrace.llm import mpeg_audio as M


@pytest.mark.parametrize("n", [0, 64, 100, 937, 938, 5000, 100_000])
def test_round_trip(n):
    p = random.Random(n).randbytes(n)
    b = M.store(p)
    info = M.read(b)
    if b"\xff" not in p:
        assert info["wrong"] == 0 and info["skipped"] == 0
    assert M.payload_of(b, info) == p
    assert info["samples"] == 1152 * len(info["frames"]) == 48 * info["micros"] // 1000
    assert info["table"] == "Xing" and info["table_frames"] == len(info["frames"])
    assert info["table_bytes"] == len(b) - info["audio_start"] and len(info["toc"]) == 100
    assert info["seek"] == [f[0] for f in info["frames"]][:: M.SEEK]


def test_resynchronises_and_sees_damage():
    b = M.store(b"text " * 2000)
    info = M.read(b)
    at = info["frames"][3][0]
    noisy = M.read(b"junk\xff\xfb" + b[info["audio_start"] : at] + b"\x00\xff\xff noise" + b[at:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(noisy["frames"]) == len(info["frames"]) and noisy["skipped"] == 15
    assert noisy["tags"]["TIT2"] == "title"
    flipped = bytearray(b)
    flipped[at + 8] ^= 1
    assert M.read(bytes(flipped))["wrong"] == 1
    assert M.read(b"")["frames"] == [] and M.read(b"\xff" * 50)["frames"] == []
    assert M.feature(M.read(b"no audio")).startswith("mpeg-layer0;rate=0;frames=0")


def test_other_layers_and_vbri():
    frame = lambda head, size: head + bytes(size - len(head))
    layer1 = frame(b"\xff\xff\x10\xc0", 12 * 32000 // 44100 * 4)
    got = M.read(layer1 * 4)
    assert (got["layer"], len(got["frames"]), got["samples"]) == (1, 4, 1536)
    low = frame(b"\xff\xf3\x80\xc0", 72 * 64000 // 22050)
    got = M.read(low * 3)
    assert (got["version"], got["layer"], got["samples"]) == ("2", 3, 1728)
    first = bytearray(frame(b"\xff\xfb\x90\xc0", 417))
    first[36:40], first[46:50], first[50:54] = b"VBRI", (4170).to_bytes(4, "big"), (9).to_bytes(4, "big")
    got = M.read(bytes(first) + frame(b"\xff\xfb\x90\xc0", 417) * 9)
    assert (got["table"], got["table_bytes"], got["table_frames"], len(got["frames"])) == ("VBRI", 4170, 9, 9)


def test_table(spark):
    texts = [(1, "abc", 9), (2, None, 9), (3, "", 9), (4, "é" * 40_000, 9), (1, "abc", 9), (None, "abc", 9), (5, "x" * 64, 9)]
    rows = M.media_table(spark.createDataFrame(texts, "doc_id long, text string, feature int")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = next((t or "").encode() for i, t, _ in texts if i == r.doc_id)
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 3}) == 1
    assert M.media_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_column_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc"), "k"), (2, None, None)], "media_id long, payload binary, note string")
    out = {r.media_id: r for r in M.encode_column(df).collect()}
    assert M.payload_of(bytes(out[1].media)) == b"abc" and out[2].media is None and out[1].note == "k"


def by_bits(bits):
    c = 0xFFFF
    for bit in bits:
        c = ((c << 1) ^ (0x8005 if (c >> 15) ^ bit else 0)) & 0xFFFF
    return c


def bits_of(data):
    return [x >> (7 - k) & 1 for x in data for k in range(8)]


@pytest.mark.parametrize("head, widths, shared, channels, scales, size", [
    (b"\xff\xfe\x80\xc0", [4] * 32, 32, 1, False, 12 * 256000 // 44100 * 4),  # layer I, mono
    (b"\xff\xfe\x80\x50", [4] * 32, 8, 2, False, 12 * 256000 // 44100 * 4),  # layer I, joint stereo, shared from subband 8
    (b"\xff\xfc\xa0\x00", [4] * 11 + [3] * 12 + [2] * 7, 30, 2, True, 144 * 192000 // 44100),  # layer II, 96 kbit/s a channel
    (b"\xff\xfc\x80\x40", [4] * 11 + [3] * 12 + [2] * 4, 4, 2, True, 144 * 128000 // 44100),  # 64 a channel, joint from subband 4
    (b"\xff\xfc\x28\xc0", [4] * 2 + [3] * 10, 12, 1, True, 144 * 48000 // 32000),  # 48 kbit/s at 32 kHz
    (b"\xff\xf4\x80\xc0", [4] * 4 + [3] * 7 + [2] * 19, 30, 1, True, 144 * 64000 // 22050),  # half the rates
])
def test_checksums_of_layers_one_and_two(head, widths, shared, channels, scales, size):
    """Allocations at random, with the choices of scale factors of those that aren't 0; any covered bit that is turned over is seen, and none behind."""
    rng = random.Random(5)
    bits, chosen = [], 0
    for k, w in enumerate(widths):
        for _ in range(channels if k < shared else 1):
            value = rng.choice([0, rng.randrange(1 << w)])
            bits += [value >> (w - 1 - j) & 1 for j in range(w)]
            chosen += bool(value) * (1 if k < shared else channels)
    bits += [rng.randrange(2) for _ in range(2 * chosen * scales)]
    covered = len(bits)
    bits += [0] * (8 * (size - 6) - covered)
    body = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))
    frame = head + by_bits(bits_of(head[2:4]) + bits[:covered]).to_bytes(2, "big") + body
    assert len(frame) == size
    info = M.read(frame * 3)
    assert (len(info["frames"]), info["checked"], info["wrong"]) == (3, 3, 0)
    spoilt = bytearray(frame)
    spoilt[6 + (covered - 1) // 8] ^= 1 << (7 - (covered - 1) % 8)
    assert M.read(bytes(spoilt) + frame * 2)["wrong"] == 1
    spoilt = bytearray(frame)
    spoilt[-1] ^= 1
    assert M.read(bytes(spoilt) + frame * 2)["wrong"] == 0


def test_ids_of_any_type(spark):
    rows = M.media_table(spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string")).collect()
    assert {r.doc_id for r in rows} == {"a", None}
