"""Streams over several files, one to a batch, so that state crosses batches and rows come late."""

import os
import random
import time

from fieldtrace.operators.windows import metres
from fieldtrace.streaming import live

DAY = 86_400_000


def fed(spark, folder, schema, parts):
    """A stream of files in the order of ``parts``, one to a batch."""
    for k, rows in enumerate(parts):
        path = str(folder / f"part{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (time.time() - 1000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


SCANS = "ms long, device string, bssid string, scan long, dbm long"


def differences(rows):
    """Scan by scan, from the whole table."""
    best, out = {}, set()
    for _, device, bssid, scan, dbm in rows:
        best[device, bssid, scan] = max(dbm, best.get((device, bssid, scan), dbm))
    before = {}
    for (device, bssid, scan), dbm in sorted(best.items()):
        last, was = before.get((device, bssid), (None, None))
        event = "new" if last is None else "back" if scan - last > 2 else "up" if dbm - was >= 8 else "down" if was - dbm >= 8 else "same"
        out.add((device, bssid, scan, event))
        before[device, bssid] = (scan, dbm)
    return out


def test_scan_difference_over_many_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for _ in range(240):
        ms = rng.randrange(20 * DAY)
        rows.append((ms, f"d{rng.randrange(2)}", f"b{rng.randrange(4)}", ms // DAY, rng.randint(-90, -40)))
    rows.sort()
    rows.append((40 * DAY, "d9", "b9", 40, -50))  # moves the watermark beyond all others
    cut = [rows[k : k + 85] for k in range(0, len(rows), 85)]
    for k in range(len(cut) - 1):  # some rows come a batch late, but not later than the watermark allows
        cut[k][-5:], cut[k + 1][:5] = cut[k + 1][:5], cut[k][-5:]
    stream = fed(spark, tmp_path, SCANS, cut).selectExpr("timestamp_millis(ms) as ts", "device", "bssid", "scan", "dbm")
    got = {tuple(r) for r in live.drained(live.scan_difference(stream, late="2 days")).collect()}
    assert got == {r for r in differences(rows) if r[0] != "d9"}


def test_transmitters_are_forgotten(spark, tmp_path):
    """c isn't heard for more than five scans of the watermark and is new again; b comes before the watermark has passed so far."""
    rows = [[(k * DAY, "d", b, k, -50)] for k, b in ((1, "b"), (11, "c"), (12, "b"), (19, "x"), (20, "x"), (22, "c"), (41, "x"))]
    stream = fed(spark, tmp_path, SCANS, rows).selectExpr("timestamp_millis(ms) as ts", "device", "bssid", "scan", "dbm")
    got = {tuple(r)[1:] for r in live.drained(live.scan_difference(stream, forget=5)).collect()}
    assert {r for r in got if r[0] != "x"} == {("b", 1, "new"), ("c", 11, "new"), ("b", 12, "back"), ("c", 22, "new")}


def test_nudged_positions_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"b{k % 3}", k, 40 + rng.gauss(0, 1e-4), -75 + rng.gauss(0, 1e-4), rng.choice([5.0, 30.0])) for k in range(90)]
    rows[50] = ("b2", 50, 41.0, -75.0, 5.0)
    stream = fed(spark, tmp_path, "bssid string, event_id long, lat double, lon double, acc double", [rows[k : k + 30] for k in (0, 30, 60)])
    out = live.drained(live.nudged_positions(stream.selectExpr("timestamp_seconds(event_id + 1) as ts", "*"))).collect()
    want = {}
    for b, _, lat, lon, acc in rows:
        x, y, v, n = want.get(b, (0.0, 0.0, 1e6, 0))
        r2 = max(acc, 1.0) ** 2
        if n and ((lon - x) ** 2 + (lat - y) ** 2) * 111_320.0**2 / (v + r2) > 900:
            continue
        g = v / (v + r2) if n else 1.0
        want[b] = (x + g * (lon - x), y + g * (lat - y), (1 - g) * v + 4.0 if n else r2, n + 1)
    assert len(out) == 9
    for b, (x, y, v, n) in want.items():
        last = max((r for r in out if r.bssid == b), key=lambda r: r.n)
        assert last.n == n and abs(last.lat - y) < 1e-12 and abs(last.lon - x) < 1e-12 and abs(last["var"] - v) < 1e-6
    assert sum(n for *_, n in want.values()) == 89


def test_live_passes_hold_a_row_for_each_stay(spark, tmp_path):
    """Six hundred fixes beside three assets come to the state as stays, across 180 degrees and at a pole too; the result is that of all pairs."""
    rng = random.Random(4)
    cams = [(1, 40.0, 180.0), (2, 40.0002, -179.9999), (3, 89.9999, 10.0)]
    near = lambda: rng.choice([(40.0 + rng.uniform(-8e-4, 8e-4), rng.choice([180.0, -180.0]) + 0.0), (89.9998, rng.uniform(-180, 180))])
    rows = [(k * 60 + (k // 200) * 10_000, "d", *near()) for k in range(600)] + [(100_000, "d", 0.0, 0.0)]
    stream = fed(spark, tmp_path, "s long, device string, lat double, lon double", [rows]).selectExpr("timestamp_seconds(s) as ts", "device", "lat", "lon")
    passes = live.live_passes(stream, spark.createDataFrame(cams, "id long, lat double, lon double"), leave="2 hours")
    got = sorted((r.id, r.from_ts.timestamp(), r.n, round(r.closest, 4)) for r in live.drained(passes).collect())
    want = []
    for i, lat, lon in cams:
        at = [(s, m) for s, _, y, x in rows if (m := metres(y, x, lat, lon)) <= 65]
        for part in range(3):
            own = [(s, m) for s, m in at if part * 22_000 <= s < (part + 1) * 22_000]
            want.append((i, float(own[0][0]), len(own), round(min(m for _, m in own), 4)))
    assert got == sorted(want) and sum(w[2] for w in want) > 600
    near_rows = spark.createDataFrame([("d", list(range(500)), [40.0] * 500, [10.0] * 500, 499, [(1, 40.0, 10.0)])], "device string, us array<long>, lat array<double>, lon array<double>, top long, near array<struct<id: long, lat: double, lon: double>>")
    out = "device string, id long, from_us long, to_us long, closest double, n long"
    stays = near_rows.mapInArrow(live._stays(65.0, 1000, live.to_arrow_schema(spark.createDataFrame([], out).schema)), out).where("id is not null")
    assert [tuple(r) for r in stays.collect()] == [("d", 1, 0, 499, 0.0, 500)]
