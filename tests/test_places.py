"""Vantage spots, stops, sightings, segments, relative places and site locks, against plain Python and on known scenes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.functions.geo import haversine
from fieldtrace.operators import joins as J
from fieldtrace.operators import locate, ranging, stops, vantage
from fieldtrace.operators.windows import metres
from fieldtrace.streaming import live, site

from .test_roads import WAY, at, road
from .test_streams import fed

ASSET = "id long, lat double, lon double, dirs array<double>, half double, most_m double"


def bearing(a, b):
    y = math.sin(math.radians(b[1] - a[1])) * math.cos(math.radians(b[0]))
    x = math.cos(math.radians(a[0])) * math.sin(math.radians(b[0])) - math.sin(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.cos(math.radians(b[1] - a[1]))
    return math.degrees(math.atan2(y, x)) % 360


def off(a, b):
    d = abs(a - b) % 360
    return min(d, 360 - d)


def spots_by_hand(cams, ways, cam):
    i, lat, lon, dirs, _, _ = cam
    points = []
    for _, highway, _, _, _, pts in ways:
        if highway == "motorway_x":
            continue
        for (a, b), (c, d) in zip(pts, pts[1:], strict=False):
            n = max(1, math.ceil(metres(a, b, c, d) / 5))
            points += [((a + k / n * (c - a), b + k / n * (d - b)), highway) for k in range(n + 1)]

    def judged(points):
        out = set()
        for (y, x), highway in points:
            far = metres(lat, lon, y, x)
            if not 20 <= far <= 60:
                continue
            if any(metres(c[1], c[2], y, x) <= 15 or (metres(c[1], c[2], y, x) <= min(125, c[5] * 1.5 + 10) and any(off(bearing(c[1:3], (y, x)), e) <= c[4] + 15 for e in c[3])) for c in cams):
                continue
            to, sides = bearing((lat, lon), (y, x)), []
            for e in dirs:
                back, front = off(to, (e + 180) % 360), off(to, e)
                sides.append((back * 0.01, "behind") if back <= 90 else (10 + (180 - front) * 0.01, "beside") if front > 90 else (25 + front * 0.01, "front"))
            s, side = min(sides, default=(0.0, "any"))
            score = max(0, 25 - far, far - 45) + s + (10 if highway == "service" else -5 if highway in ("footway", "path") else 0)
            out.add((math.floor(score * 1000 + 0.5), math.floor(far * 1000 + 0.5), y, x, highway, side))
        return sorted(out)

    found = judged(points) or judged([((lat + r * math.cos(math.radians(t)) / 111_194.92664455873, lon + r * math.sin(math.radians(t)) / 111_194.92664455873 / math.cos(math.radians(lat))), "ground") for r in (30, 40, 50) for t in range(0, 360, 15)])
    out = []
    for s in found:
        if len(out) < 3 and all(metres(s[2], s[3], o[2], o[3]) >= 10 for o in out):
            out.append(s)
    return out


def test_vantage_spots_against_a_loop(spark):
    rng = random.Random(2)
    ways = [road(k, rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(-300, 300), k * 100, highway=rng.choice(["residential", "service", "footway", "path"]), parts=3) for k in range(12)]
    cams = [(k, *at(rng.uniform(-250, 250), rng.uniform(-250, 250)), [float(rng.randrange(360)) for _ in range(k % 3)], 12.5, 35.0) for k in range(20)] + [(90, *at(4000, 4000), [10.0], 12.5, 35.0), (91, *at(4000, 4010), [], 12.5, 35.0)]
    got = {}
    for r in vantage.vantage_spots(spark.createDataFrame(cams, ASSET), spark.createDataFrame(ways, WAY)).collect():
        got.setdefault(r.id, []).append((r.spot, round(r.score, 3), round(r.far, 2), r.side, r.highway))
    assert set(got) == {c[0] for c in cams}
    for c in cams:
        want = [(k + 1, round(s[0] / 1000, 3), round(s[1] / 1000, 2), s[5], s[4]) for k, s in enumerate(spots_by_hand(cams, ways, c))]
        own = sorted(got[c[0]])
        assert [x[0] for x in own] == [x[0] for x in want] and all(a[1] == pytest.approx(b[1], abs=0.002) and a[2] == pytest.approx(b[2], abs=0.02) and a[3:] == b[3:] for a, b in zip(own, want, strict=True))
    assert got[90][0][4] == "ground"


def test_stops_get_their_departures(spark):
    rows = [
        ("a", 0, 0, *at(0, 0), "gps"), ("a", 1, 60_000, *at(10, 0), "gps"), ("a", 2, 90_000, *at(9_000, 0), "ip"), ("a", 3, 120_000, *at(20, 0), "gps"), ("a", 4, 180_000, *at(500, 0), "gps"),
        ("a", 5, 240_000, *at(505, 0), "wifi"), ("a", 6, 240_000 + 50_000_000, *at(9_000, 0), "ip"), ("b", 0, 5, *at(0, 0), "ip"), ("b", 1, 6, *at(1, 0), "gps"),
    ]
    got = stops.stop_log(spark.createDataFrame(rows, "device string, n long, t_ms long, lat double, lon double, source string")).orderBy("device", "arrived_ms").collect()
    assert [(r.device, r.arrived_ms, r.departed_ms, r.source, r.n) for r in got] == [
        ("a", 0, 120_000, "gps", 3), ("a", 180_000, 180_000, "gps", 1), ("a", 240_000, 240_000, "wifi", 1), ("a", 50_240_000, None, "ip", 1), ("b", 5, 5, "ip", 1), ("b", 6, None, "gps", 1),
    ]


def test_sightings_against_a_list(spark):
    rng = random.Random(4)
    rows = [(f"b{rng.choice([0] * 9 + [1])}", k, k * 1000, *at(rng.uniform(-4000, 4000), rng.uniform(-4000, 4000)), rng.choice([5.0, 50.0, 400.0, -1.0, None])) for k in range(300)]
    got = {}
    for r in stops.place_sightings(spark.createDataFrame(rows, "bssid string, event_id long, t_ms long, lat double, lon double, acc double")).orderBy("bssid", "place").collect():
        got.setdefault(r.bssid, []).append((r.lat, r.lon, r.acc, r.t_ms))
    want = {}
    for b, _, t, lat, lon, acc in rows:
        acc, places = acc if acc and acc > 0 else 50_000.0, want.setdefault(b, [])
        for p in places:
            if metres(p[0], p[1], lat, lon) <= max(p[2], acc):
                p[3] = t
                if acc < p[2]:
                    p[:3] = [lat, lon, acc]
                break
        else:
            places.append([lat, lon, acc, t])
            if len(places) > 24:
                places.pop(0)
    assert got == {b: [tuple(p) for p in v] for b, v in want.items()}


def test_reference_anchors_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(50), *at(rng.uniform(-400, 400), rng.uniform(-400, 400))) for k in range(150)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(metres(*r[2:], *k[2:]) > 100 for k in kept):
            kept.append(r)
    got = stops.reference_anchors(spark.createDataFrame(rows, "id long, placed_ms long, lat double, lon double")).collect()
    assert sorted(r.id for r in got if r.kept) == sorted(k[0] for k in kept) and len(got) == 150


def test_fixes_at_rest(spark):
    steps = [((0, 0), 5.0, True, False, "free"), ((10, 0), 5.0, True, False, "held"), ((20, 0), 20.0, True, False, "held"), ((200, 0), 5.0, True, False, "rejected"), ((205, 0), 5.0, True, False, "rejected"),
             ((5, 0), 20.0, True, False, "held"), ((200, 0), 5.0, True, False, "rejected"), ((204, 0), 5.0, True, False, "rejected"), ((203, 0), 5.0, True, False, "free"), ((210, 0), None, True, False, "held"),
             ((400, 0), 5.0, True, True, "free"), ((400, 0), 5.0, False, False, "free"), ((900, 0), 5.0, True, False, "free")]
    rows = [("a", k, k * 1000, *at(*p), a, still, stirred) for k, (p, a, still, stirred, _) in enumerate(steps)]
    got = stops.still_fixes(spark.createDataFrame(rows, "device string, n long, t_ms long, lat double, lon double, acc double, still boolean, stirred boolean")).orderBy("n").collect()
    assert [r.state for r in got] == [s[-1] for s in steps]
    assert metres(got[1].lat, got[1].lon, *at(0.6, 0)) < 0.01 and metres(got[2].lat, got[2].lon, *at(0.6, 0)) < 0.01


def test_segments_of_a_day(spark):
    """A rest, a drive with a red light and a jump, a walk with a spike and a coarse fix, a rest after a gap."""
    rows, t = [], 0

    def add(dt, p, acc=5.0, source="gps"):
        nonlocal t
        t += dt * 1000
        rows.append(("a", len(rows), t, *at(*p), acc, source))

    for k in range(4):
        add(60, (0.01 * k, 0))
    for k in range(1, 6):
        add(10, (k * 150, 0))
    add(100, (750, 0))
    add(10, (750, 700), acc=80.0)
    for k in range(6, 9):
        add(10, (k * 150, 0))
    for k in range(1, 8):
        add(20, (1200 + k * 8, 0 if k != 4 else 45), acc=60.0 if k == 6 else 5.0)
    add(700, (1400, 0), source="phone-stationary")
    add(30, (1402, 0), source="phone-stationary")
    schema = "device string, n long, t_ms long, lat double, lon double, acc double, source string"
    found = {}
    for r in stops.mode_segments(spark.createDataFrame(rows, schema)).orderBy("start_ms", "k").collect():
        found.setdefault((r.start_ms, r.end_ms, r.mode), []).append(r)
    kinds = [k[2] for k in sorted(found)]
    assert kinds[0] == "still" and kinds[-1] == "still" and "vehicle" in kinds and "foot" in kinds
    drive = max((k for k in found if k[2] == "vehicle"), key=lambda k: k[1] - k[0])
    assert (drive[1] - drive[0]) >= 150_000 and all(r.lat < 40.003 for r in found[drive])  # the light is in it, the jump isn't
    rest = found[sorted(found)[-1]]
    assert len(rest) == 1 and metres(rest[0].lat, rest[0].lon, *at(1401, 0)) < 0.1
    walk = next(v for k, v in sorted(found.items()) if k[2] == "foot" and len(v) > 2)
    assert all(r.lat < 40.0001 for r in walk)


def test_modes_against_a_walk_over_rows():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 14)
        t = np.cumsum([rng.choice([1, 20, 100, 200]) * 1000 for _ in range(n)])
        x = np.cumsum([rng.choice([0, 0.2, 5, 40, 300, -40]) for _ in range(n)])
        lat, lon = np.array([at(v, 0)[0] for v in x]), np.array([at(v, 0)[1] for v in x])
        told = np.array([rng.choice([-1, -1, -1, -1, 0, 1, 2]) for _ in range(n)])
        mode, chunk, out = (told[0] if told[0] >= 0 else 0), [0], []
        for k in range(1, n):
            dt, d = (t[k] - t[k - 1]) / 1000, metres(lat[k - 1], lon[k - 1], lat[k], lon[k])
            if told[k] >= 0:
                point = told[k]
            elif k + 1 < n and d > 30 and metres(lat[k], lon[k], lat[k + 1], lon[k + 1]) > 30 and metres(lat[k - 1], lon[k - 1], lat[k + 1], lon[k + 1]) < 18:
                point = None
            else:
                v = d / dt * 3.6 if dt > 0.5 else 0
                point = 2 if v >= 14 else 1 if v >= 0.8 else 0
            new = mode if point is None or (point == 0 and ((mode == 2 and dt < 180) or (mode == 1 and dt < 120))) else point
            if len(chunk) >= 2 and new != mode:
                out.append((chunk[0], mode))
                chunk = [k - 1]
            mode = new
            chunk.append(k)
        out.append((chunk[0], mode))
        starts, modes = stops.segment_modes(t, lat, lon, told)
        assert list(zip(starts, modes, strict=True)) == out


def test_offsets_are_found_and_posteriors_are_sound():
    rng = np.random.default_rng(7)
    miss, inside = [], 0
    for _ in range(60):
        true = rng.uniform(-25, 25, 2)
        gain = rng.normal(0, 3)
        p = rng.uniform(-60, 60, (12, 2))
        delta = gain - 26 * np.log10(np.maximum(0.5, np.hypot(*(true - p).T)) / np.hypot(*p.T)) + rng.normal(0, 1.5, 12)
        f = ranging.offset_fit(p[:, 0], p[:, 1], delta, np.full(12, 2.6), np.full(12, 1.5), np.full(12, 0.5))
        miss.append(math.hypot(f["east"] - true[0], f["north"] - true[1]))
        d = np.array([f["east"] - true[0], f["north"] - true[1]])
        inside += d @ np.linalg.inv([[f["cee"], f["cen"]], [f["cen"], f["cnn"]]]) @ d < 5.99
    assert np.median(miss) < 8 and inside >= 52
    assert ranging.offset_fit(*(np.array(v) for v in ([10.0, 12, 14], [0.0, 0, 0], [1.0, 2, 3], [2.6] * 3, [1.0] * 3, [1.0] * 3))) is None
    # a sharp place far away: distance and bearing are those of the place; a range alone has no bearing
    far = ranging.relative_posterior(None, [(30.0, 40.0, 4.0, 0.0, 4.0)])
    assert far["distance"] == pytest.approx(50, abs=1) and far["bearing"] == pytest.approx(math.degrees(math.atan2(30, 40)), abs=1) and far["kind"] == "far"
    assert (far["high"] - far["low"]) / 2 == pytest.approx(2, abs=0.7)
    alone = ranging.relative_posterior((1.0, 0.01), [])
    assert alone["bearing"] is None and alone["distance"] == pytest.approx(10, rel=0.02) and alone["high"] == pytest.approx(10**1.1, rel=0.03) and alone["kind"] == "near"
    assert ranging.relative_posterior(None, []) is None


def test_calibration_by_anchors(spark):
    rng = np.random.default_rng(8)
    fits = [(k, *at(rng.normal(0, 20), rng.normal(0, 20)), 100.0, 0.0, 100.0, 24.5) for k in range(400)]
    pins = [(k, *at(0, 0)) for k in range(400)]
    c = ranging.anchor_calibration(spark.createDataFrame(fits, "k long, lat double, lon double, cxx double, cxy double, cyy double, r95 double"), spark.createDataFrame(pins, "k long, lat double, lon double"), "k").first()
    assert c.n == 400 and c.kappa == pytest.approx(2.0, rel=0.08) and c.coverage == pytest.approx(1 - math.exp(-(24.5**2) / 800), abs=0.08)
    few = ranging.anchor_calibration(spark.createDataFrame(fits[:2], "k long, lat double, lon double, cxx double, cxy double, cyy double, r95 double"), spark.createDataFrame(pins, "k long, lat double, lon double"), "k").first()
    assert few.kappa == 1.0


def test_site_lock_over_batches(spark, tmp_path):
    """Learned while placed, kept through one bad scan, left after two, entered again by the neighbourhood alone; another site never matches."""
    rows, hour = [], 3_600_000
    home = [(f"n{k}", -50.0 - 3 * k) for k in range(6)]

    def scan(s, heard, placed=False):
        rows.append([("a", (100 + s) * hour, b, dbm, placed) for b, dbm in heard])

    for s in range(6):
        scan(s, home, placed=s == 0)
    scan(6, [("x", -60.0)])
    scan(7, home)
    scan(8, [("x", -60.0)])
    scan(9, [("y", -60.0)])
    scan(10, home[:2])
    scan(11, home[:4])
    scan(12, [(b, d - 40) for b, d in home])
    rows[3], rows[4] = rows[4], rows[3]  # a scan comes a batch late
    rows.append([("z", 140 * hour, "x", -50.0, False)])
    stream = fed(spark, tmp_path, "site string, scan_ms long, bssid string, dbm double, placed boolean", rows).selectExpr("timestamp_millis(scan_ms) as ts", "*")
    got = sorted((r.scan_ms // hour - 100, r.on, r.changed, r.common) for r in live.drained(site.site_lock(stream, late="3 hours")).collect() if r.site == "a")
    assert [g[0] for g in got] == list(range(13))
    assert [g[1] for g in got] == [True] * 9 + [False, False, True, True]
    assert [g[0] for g in got if g[2]] == [0, 9, 11] and [g[3] for g in got[5:]] == [6, 0, 6, 0, 0, 2, 4, 2]


def test_fits_feed_the_calibration(spark):
    assert "cxx" in locate.level_fit(spark.createDataFrame([], "bssid string, lat double, lon double, dbm double, acc double"), "bssid").columns


def test_scans_are_brought_together_before_the_state(spark):
    """A thousand rows of a transmitter in a scan come as one for each task, at the highest level and placed if any was."""
    rows = spark.range(0, 4000, 1, 1).selectExpr("timestamp_millis(id % 2) as ts", "1L as site", "id % 2 as scan_ms", "concat('n', id % 4) as bssid", "-90.0D + id % 30 as dbm", "id = 7 as placed")
    got = {(r.scan_ms, r.bssid, r.dbm, r.placed) for r in site.strongest(rows).collect()}
    assert got == {tuple(r) for r in rows.groupBy("scan_ms", "bssid").agg({"dbm": "max"}).join(rows.groupBy("scan_ms", "bssid").agg({"placed": "max"}), ["scan_ms", "bssid"]).collect()}
    assert site.strongest(rows).count() == 4


def test_thin_ring_has_few_cells(spark, monkeypatch):
    """The nearest points beyond a radius that is many times their spacing: all as by brute force, from cells that hold some tens of points each."""
    points = spark.range(40_000).select(F.col("id").alias("event_id"), (40.0 + (F.col("id") % 200 - 100) * 0.00001).alias("lat"), (-75.0 + (F.floor(F.col("id") / 200) - 100) * 0.000012).alias("lon"))
    asset, cells, ring = spark.createDataFrame([(1, 40.0, -75.0)], "id long, lat double, lon double"), [], J._ring_cells

    def counted(*args):
        made = ring(*args)
        cells.append(made.count())
        return made

    monkeypatch.setattr(J, "_ring_cells", counted)
    got = {(r.event_id, r.r) for r in J.nearest(points, asset, "id", 5, 100.0, [F.col("__mm"), F.col("event_id")], beyond=60.0).select("event_id", "r").collect()}
    far = points.withColumn("m", haversine(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-75.0))).where("m > 60").withColumn("mm", F.floor(F.col("m") * 1000 + 0.5))
    want = {(r.event_id, k + 1) for k, r in enumerate(far.orderBy("mm", "event_id").limit(5).collect())}
    assert got == want
    assert cells[0] < 100
