"""A receiver's place against a plain solver, radii against integration, and the pace of bursts against a plain loop."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from fieldtrace.operators import receiver

HEARD = "scan string, id string, lat double, lon double, acc double, dbm double, mhz int, weight double"
K = 111_320.0


def scan(name, n, seed, wrong=()):
    """Transmitters around (40, -75), heard from 30 m east and 20 m north of it; ``wrong`` are mapped two kilometres off."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, y = rng.uniform(-120, 120), rng.uniform(-120, 120)
        mhz, p0 = rng.choice([(2437, -40), (5180, -46), (6105, -48)])
        dbm = p0 - 24 * math.log10(max(1.0, math.hypot(x - 30, y - 20)))
        if i in wrong:
            y += 2000
        rows.append((name, f"a{i:02d}", 40 + y / K, -75 + x / (K * math.cos(math.radians(40))), 8.0, dbm, mhz, 1.0))
    return rows


def loss_at(rows, lat, lon, gone):
    total = 0.0
    for _, k, a, o, acc, dbm, mhz, w in rows:
        if k in gone:
            continue
        d = min(1500.0, max(1.0, 10 ** (((-48 if mhz >= 5925 else -46 if mhz >= 4900 else -40) - dbm) / 24)))
        r = max(1.0, math.hypot((lon - o) * K * math.cos(math.radians(40)), (lat - a) * K))
        z = abs(r - d) / math.sqrt((d * math.log(10) * 6 / 24) ** 2 + acc**2)
        total += max(0.05, w) * (z * z if z <= 2 else 4 * z - 4)
    return total


def test_places_are_least_and_moved_transmitters_are_left_out(spark):
    rows = scan("clean", 12, 1) + scan("moved", 12, 2, {3}) + scan("two", 12, 3, {0, 5}) + scan("three", 3, 4) + scan("pair", 2, 5) + scan("one", 1, 6)
    odd = [("clean", "zz", None, -75.0, 5.0, -50.0, 2437, 1.0), ("pair", "zz", 40.0, -75.0, 5.0, None, 2437, 1.0)]
    got = {r["scan"]: r for r in receiver.self_locations(spark.createDataFrame(rows + odd, HEARD), "scan").collect()}
    assert set(got) == {"clean", "moved", "two", "three", "pair"}
    assert got["clean"]["integrity"] == "ok" and got["clean"]["excluded"] == []
    assert got["moved"]["integrity"] == "repaired" and got["moved"]["excluded"] == ["a03"]
    assert got["two"]["excluded"] == ["a00", "a05"] and got["pair"]["integrity"] == "unverified"
    for name in ("clean", "moved", "two"):
        r, own = got[name], [x for x in rows if x[0] == name]
        off = math.hypot((r["lon"] + 75) * K * math.cos(math.radians(40)) - 30, (r["lat"] - 40) * K - 20)
        assert off < 12 and r["acc"] >= 15 and r["r95"] >= 2.45 * r["acc"] - 1e-9
        best = loss_at(own, r["lat"], r["lon"], r["excluded"])
        for dx, dy in ((1.5, 0), (-1.5, 0), (0, 1.5), (0, -1.5)):
            assert loss_at(own, r["lat"] + dy / K, r["lon"] + dx / K, r["excluded"]) > best - 1e-3


def test_batches_of_scans_don_t_matter(spark):
    rows = [x for k in range(40) for x in scan(f"s{k}", 2 + k % 17, k, {1} if k % 3 == 0 else ())]
    df = spark.createDataFrame(rows, HEARD)
    one = {r["scan"]: tuple(r)[1:7] for r in receiver.self_locations(df, "scan").collect()}
    for k in (0, 7, 16):
        alone = receiver.self_locations(df.where(F.col("scan") == f"s{k}"), "scan").collect()[0]
        assert np.allclose(tuple(alone)[1:6], one[f"s{k}"][:5], rtol=0, atol=1e-6)
    assert receiver.self_locations(df.where("false"), "scan").collect() == []


def test_radius(spark):
    rng = np.random.default_rng(0)
    for s1, s2 in ((10.0, 10.0), (10.0, 3.0), (4.0, 9.0)):
        r = receiver.radius_for(np.array([s1]), np.array([s2]))[0]
        t = np.linspace(-math.pi / 2, math.pi / 2, 4001)
        big, small = max(s1, s2), min(s1, s2)
        f = np.exp(-0.5 * (r * np.sin(t) / big) ** 2) / (big * math.sqrt(2 * math.pi)) * (2 * receiver.normal_cdf(r * np.cos(t) / small) - 1) * r * np.cos(t)
        assert abs(np.trapezoid(f, t) - 0.95) < 1e-5
        assert abs((np.hypot(*(rng.standard_normal((2, 200_000)) * [[s1], [s2]])) <= r).mean() - 0.95) < 0.003
    assert abs(receiver.radius_for(np.array([1.0]), np.array([1.0]))[0] - math.sqrt(-2 * math.log(0.05))) < 1e-9
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, None, 1.0), (3, -1.0, 1.0)], "k long, a double, b double")
    got = {r["k"]: r["radius"] for r in receiver.with_radius(df, "a", "b").collect()}
    assert got[2] is None and got[3] is None and got[1] > 4


def pace(ticks):
    """Every tick looks back over all ticks since the last change, from lists."""
    out, since, ref, lev, last, seen = [], None, None, None, None, []
    for ms, metres, moving, peer, dbm in ticks:
        seen += [(ms, v) for v in dbm or []]
        recent = sorted(v for t, v in seen if ms - t <= 10_000)
        level = float(np.median(recent)) if len(recent) >= 5 else None
        why = "moving" if moving else "peer moving" if peer else "no estimate" if metres is None else None
        if not why and ref is not None and abs(metres - ref) > max(0.5, 0.2 * ref):
            why = "distance"
        if not why and lev is not None and level is not None and abs(level - lev) > 6:
            why = "level"
        if why:
            since, ref, lev = (ms if metres is not None else None), metres, level
        else:
            if since is None:
                since, ref = ms, metres
            lev = level if lev is None else lev
        slow = since is not None and ms - since >= 120_000
        due = not slow or last is None or ms - last >= 30_000
        last = ms if due else last
        out.append((ms, due, slow, why))
    return out


def test_pace(spark):
    rng, rows = random.Random(3), []
    for s in ("a", "b", "c"):
        for k in range(400):
            quiet = k % 100 > 5
            rows.append((s, k * 2500, None if not quiet and rng.random() < 0.1 else 5.0 + rng.uniform(-0.8, 0.8) + (3 if k % 150 == 149 else 0), not quiet and rng.random() < 0.2, not quiet and rng.random() < 0.2, [-60 - rng.randrange(4) - (9 if s == "c" and k > 250 else 0)] * (k % 3)))
    df = spark.createDataFrame(rows, "session string, t_ms long, metres double, moving boolean, peer_moving boolean, dbm array<int>")
    got = {}
    for r in receiver.paced(df, "session").collect():
        got.setdefault(r["session"], []).append((r["t_ms"], r["burst"], r["slow"], r["reason"]))
    for s in ("a", "b", "c"):
        assert sorted(got[s]) == pace([r[1:] for r in rows if r[0] == s])
    assert any(slow and not burst for _, burst, slow, _ in got["a"]) and any(w == "level" for *_, w in got["c"])


def test_pace_of_a_crowded_session(spark):
    """Fifteen thousand ticks within ten seconds: a tick's median costs no sort of all levels of the ten seconds."""
    rows = spark.range(15_000).selectExpr("'a' as session", "id div 2 as t_ms", "5.0D as metres", "false as moving", "false as peer_moving", "transform(sequence(0, 5), j -> cast(-60 - (id + j) % 5 as int)) as dbm")
    receiver.paced(rows.limit(10), "session").count()
    begun = time.monotonic()
    assert receiver.paced(rows, "session").where("burst and reason is null").count() == 15_000
    assert time.monotonic() - begun < 20
