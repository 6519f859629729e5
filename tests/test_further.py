"""Operators without SQL of equal rows, against plain Python over small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import plates
from fieldtrace.operators import aggregates, folds, graph, joins, locate, merge, passes
from fieldtrace.operators.windows import metres


def at(east, north, lat=40.0, lon=-75.0):
    return lat + north / 111_320, lon + east / (111_320 * math.cos(math.radians(lat)))


def walk(rng, n, step=30.0, device="a"):
    east = north = 0.0
    rows = []
    for k in range(n):
        east, north = east + rng.uniform(-step, step), north + rng.uniform(-step, step)
        lat, lon = at(east, north)
        rows.append((device, k, k * 20_000 + (k // 40) * 900_000, lat, lon, rng.choice([4.0, 9.0, 20.0])))
    return rows


TRACK = "device string, n long, t_ms long, lat double, lon double, acc double"


ASSETS = "id long, lat double, lon double, dirs array<double>, half double, least_m double, most_m double"


def test_views_against_sampling_every_shift(spark):
    rng = random.Random(1)
    rows = [r for r in walk(rng, 120) if r[1] % 40 != 20]
    rows += [("b", 0, 5_000_000, *at(10, 20), 6.0), ("b", 1, 9_000_000, *at(-20, 5), -1.0)]
    cams = [(k, *at(rng.uniform(-150, 150), rng.uniform(-150, 150)), [float(rng.randrange(360)) for _ in range(k % 3)], 30.0, 3.0, 60.0) for k in range(15)]
    near = passes.with_pass(passes.near_legs(passes.legs(spark.createDataFrame(rows, TRACK)), spark.createDataFrame(cams, ASSETS)))
    legs = {}
    for r in near.collect():
        legs.setdefault((r.device, r.id, r["pass"]), []).append(r)
    found = {(r.device, r.id, r["pass"]): r for r in passes.passes_of(near).collect()}
    got = {(r.device, r.id, r["pass"]): r for r in passes.views(near).collect()}
    assert set(got) == set(legs) == set(found) and len(got) >= 10 and any(k[0] == "b" for k in got)
    nodes, weights = np.polynomial.hermite.hermgauss(7)
    kinds = set()
    for key, own in legs.items():
        dirs, c_ms, c_acc = own[0].dirs, found[key].c_ms, found[key].c_acc
        sigma, samples, front, rear, inside, ranged, seen = max(1.0, (c_acc if c_acc > 0 else 8.0) / 1.515), [], 0.0, 0.0, 0.0, 0.0, []
        kinds.add(len(dirs))

        def view(x, y, dirs=dirs):
            d = math.hypot(x, y)
            return [k for k in dirs if 3.0 <= d <= 60.0 and abs((math.degrees(math.atan2(x, y)) - k + 180) % 360 - 180) <= 33.0]

        own.sort(key=lambda r: r.n)
        for r in own:
            n = max(math.ceil(max((r.t1 - r.t0) / 1000 / 0.2, math.hypot(r.x1 - r.x0, r.y1 - r.y0))), 1)
            for i in range(n):
                u = (i + 0.5) / n
                x, y = r.x0 + u * (r.x1 - r.x0), r.y0 + u * (r.y1 - r.y0)
                samples.append((x, y))
                dt = (r.t1 - r.t0) / 1000 / n
                if math.hypot(x, y) <= 65:
                    inside += dt
                    ranged += dt * (3.0 <= math.hypot(x, y) <= 60.0)
                if view(x, y):
                    seen += view(x, y)
                    if r.t0 + u * (r.t1 - r.t0) < c_ms:
                        front += dt
                    else:
                        rear += dt
        g = got[key]
        if dirs:
            p = 0.0
            for (a, wa), (b, wb) in itertools.product(zip(nodes, weights, strict=True), repeat=2):
                ox, oy = math.sqrt(2) * sigma * a, math.sqrt(2) * sigma * b
                if any(view(x + ox, y + oy) for x, y in samples):
                    p += wa * wb / math.pi
            assert g.p_view == pytest.approx(min(p, 1.0), abs=1e-9) and g.in_view_s == pytest.approx(front + rear, abs=1e-6)
            assert g.facing == bool(seen) and g.camera_dir == next((d for d in dirs if d in seen), dirs[0])
            if key[0] == "b":
                assert (g.front, g.rear) == (bool(seen), bool(seen))
            else:
                assert (g.front, g.rear) == (front > 0, rear > 0)
        else:
            share = ranged / inside if inside else float(3.0 <= found[key].enter_m <= 60.0)
            assert g.p_view == pytest.approx(share / 2, abs=1e-9) and (g.facing, g.camera_dir, g.front, g.rear) == (-1, None, False, False)
    assert kinds == {0, 1, 2}


def test_passes_find_every_leg_that_comes_near(spark):
    """Legs up to 1.5 km long, held against all assets."""
    rng = random.Random(2)
    rows = walk(rng, 80, step=900.0)
    cams = [(k, *at(rng.uniform(-4000, 4000), rng.uniform(-4000, 4000)), [0.0]) for k in range(300)]
    legs = passes.legs(spark.createDataFrame(rows, TRACK))
    got = {(r.n, r.id) for r in passes.near_legs(legs, spark.createDataFrame(cams, "id long, lat double, lon double, dirs array<double>")).collect()}
    want = set()
    for r in legs.collect():
        for i, lat, lon, _ in cams:
            k = 111_194.93 * math.cos(math.radians(lat))
            ends = [((x - lon) * k, (y - lat) * 111_194.93) for y, x in ((r.lat, r.lon), (r.lat2, r.lon2))]
            if min(math.hypot(ends[0][0] + u * (ends[1][0] - ends[0][0]), ends[0][1] + u * (ends[1][1] - ends[0][1])) for u in np.linspace(0, 1, 3001)) <= 65:
                want.add((r.n, i))
    assert want <= got and len(got - want) <= 1 and len(want) > 5


def test_legs_across_days_and_lone_fixes(spark):
    """Legs are found in days, whatever the hour; a fix without a neighbour is a leg of its own, and breaks a run."""
    day = 86_400_000
    rows = [("a", k, day - 200_000 + k * 100_000, *at(k * 10, 0), 5.0) for k in range(5)] + [("a", 5, day + 2_000_000, *at(0, 0), 5.0), ("a", 6, day + 4_000_000, *at(0, 0), 5.0), ("a", 7, day + 4_001_000, *at(9_000, 0), 5.0), ("a", 8, day + 4_002_000, *at(9_001, 0), 5.0)]
    got = sorted((r.n, r["last"], r.t1 - r.t0) for r in passes.legs(spark.createDataFrame(rows, TRACK)).collect())
    assert got == [(0, 1, 100_000), (1, 2, 100_000), (2, 3, 100_000), (3, 4, 100_000), (5, 5, 0), (6, 6, 0), (7, 8, 1000)]
    near = passes.with_pass(passes.near_legs(passes.legs(spark.createDataFrame(rows, TRACK)), spark.createDataFrame([(1, *at(0, 5), None)], "id long, lat double, lon double, dirs array<double>")))
    found = sorted((r.start_ms, r.n_fixes, round(r.metres, 1)) for r in passes.passes_of(near).collect())
    assert found == [(day - 200_000, 5, 5.0), (day + 2_000_000, 1, 5.0), (day + 4_000_000, 1, 5.0)]


def test_course_speed_and_bearings_of_a_pass(spark):
    """East at 20 m/s, 30 m north of the asset, a fix every ten seconds; the last pass has nothing after it, so its velocity tells."""
    rows = [("a", k, k * 10_000, *at(k * 200 - 700, 30), 10.0) for k in range(8)] + [("b", 0, 0, *at(-200, 30), 10.0), ("b", 1, 10_000, *at(0, 30), 10.0)]
    own = passes.legs(spark.createDataFrame(rows, TRACK))
    near = passes.with_pass(passes.near_legs(own, spark.createDataFrame([(1, *at(0, 0), [90.0])], "id long, lat double, lon double, dirs array<double>")))
    a, b = sorted(passes.with_bearings(passes.passes_of(near), own).collect(), key=lambda r: r.device)
    assert (a.c_ms, b.c_ms) == (35_000, 10_000)
    for r in (a, b):
        assert r.speed_kmh == pytest.approx(72, rel=0.01) and r.heading == pytest.approx(90, abs=0.5) and r.metres == pytest.approx(30, abs=0.2) and r.c_acc == 10.0
        assert r.approach == pytest.approx(0, abs=0.5) or r.approach == pytest.approx(360, abs=0.5)
        assert r.front == pytest.approx(360 - math.degrees(math.atan2(200, 30)), abs=0.3) and r.rear == pytest.approx(math.degrees(math.atan2(200, 30)), abs=0.3)


@pytest.mark.parametrize("lat", [0.0, 60.0, -78.0, 89.9])
def test_grid_join_at_any_latitude_and_across_the_date_line(spark, lat):
    rng = random.Random(3)
    place = lambda: (min(90.0, max(-90.0, lat + rng.uniform(-0.004, 0.004))), (rng.uniform(-0.02, 0.02) / max(math.cos(math.radians(lat)), 0.01) + 360) % 360 - 180)
    a, b = [(k, *place()) for k in range(300)], [(k, *place()) for k in range(300)]
    for radius, per_degree in ((65.0, 1000), (150.0, 1000)):
        met = joins.grid_join(spark.createDataFrame(a, "p long, lat double, lon double"), spark.createDataFrame(b, "q long, lat double, lon double"), radius, per_degree)
        got = [(r.p, r.q) for r in met.collect()]
        want = {(i, j) for i, y, x in a for j, v, u in b if metres(y, x, v, u) <= radius}
        assert len(got) == len(set(got)) and set(got) == want and want


def test_superset_join_against_all_pairs(spark):
    rng = random.Random(4)
    bag = lambda: rng.sample("a b c d e f g".split(), rng.randint(0, 4)) + ["a"] * rng.randint(0, 2)
    w, o = [(k, bag()) for k in range(60)], [(k, bag()) for k in range(60)]
    got = {tuple(r) for r in joins.superset_join(spark.createDataFrame(w, "w long, tokens array<string>"), spark.createDataFrame(o, "o long, tokens array<string>"), "w", "o").collect()}
    assert got == {(i, j, len(set(x)), len(set(y))) for i, x in w for j, y in o if x and set(x) <= set(y)}


def test_numbers_follow_the_key_with_one_busy_value(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.lit("same")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    out = merge.numbered(rows, "k").orderBy("number").collect()
    assert [r.number for r in out] == list(range(1000)) and [r.k for r in out] == sorted(r.k for r in out)


def test_best_strings_against_all_strings(spark):
    rng = random.Random(5)
    rows = [(k, [[(c, rng.uniform(0.01, 1)) for c in "XYZ"[: rng.randint(1, 3)]] for _ in range(rng.randint(1, 4))]) for k in range(40)]
    out = spark.createDataFrame(rows, "k long, slots array<array<struct<char: string, p: double>>>").select("k", plates.likeliest("slots", 5).alias("best")).collect()
    for r in out:
        every = sorted((math.prod(p for _, p in x), "".join(c for c, _ in x)) for x in itertools.product(*rows[r.k][1]))[::-1][:5]
        assert [(b.text, pytest.approx(b.p)) for b in r.best] == [(t, p) for p, t in every]


def test_hotlist_against_every_reading(spark):
    rng = random.Random(6)
    reads = [(f"u{k}", "".join(rng.choices("O0I1A5", k=3)), rng.choice([0.6, 0.9, 0.999])) for k in range(200)]
    wanted = [("".join(rng.choices("O0I1A5", k=3)), rng.choice([None, 50, 150])) for _ in range(40)]
    own = ["0OI", "A5A"]
    got = {tuple(r)[:3]: r.ratio for r in plates.hotlist(spark.createDataFrame(reads, "uid string, plate string, sure double"), spark.createDataFrame(wanted, "wanted string, expires_ms long"), spark.createDataFrame([(o,) for o in own], "own string"), "uid", "plate", F.col("sure"), F.lit(100)).collect()}
    live, want = {w for w, e in wanted if e is None or e > 100}, {}
    for uid, text, sure in reads:
        slots = [[(c, sure), (plates.ALIKE[c], 1 - sure)] if c in plates.ALIKE else [(c, 1.0)] for c in text]
        every = {"".join(c for c, _ in x): math.prod(p for _, p in x) for x in itertools.product(*slots)}
        found = {t: p / every[text] for t, p in every.items() if t == text or p / every[text] >= 0.002}
        if any(t in own for t in found):
            continue
        if text in live:
            want[uid, text, "exact"] = 1.0
        else:
            want |= {(uid, t, "possible"): r for t, r in found.items() if t in live}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and {k[2] for k in want} == {"exact", "possible"}


def test_correlation_time(spark):
    rng = np.random.default_rng(7)
    x = [0.0]
    for e in rng.normal(size=3999):
        x.append(0.8 * x[-1] + float(e))
    rows = [("ar", k, v) for k, v in enumerate(x)] + [("white", k, float(v)) for k, v in enumerate(rng.normal(size=2000))] + [("flat", k, 1.0) for k in range(40)] + [("short", k, float(k)) for k in range(5)]
    out = {r.s: r for r in aggregates.correlation_time(spark.createDataFrame(rows, "s string, n long, x double"), ["s"], "n", "x").collect()}
    assert out["ar"].converged and 7 < out["ar"].tau < 11.5 and 0.9 < out["white"].tau < 1.3  # (1 + 0.8) / (1 - 0.8) = 9
    assert out["flat"].tau is None and out["short"].tau is None


def observed(rng, n):
    rows = []
    for k in range(n):
        lat, lon = at(rng.choice([0, 60, 300]) + rng.uniform(-20, 20), rng.uniform(-20, 20))
        rows.append((f"b{k % 3}", k, f"d{k % 2 if k % 7 == 0 else 0}", k * 60_000 + (k // 30) * 700_000, lat, lon, rng.choice([5.0, 20.0, 60.0]), rng.randint(-90, -40)))
    return rows


OBSERVED = "bssid string, event_id long, device string, t_ms long, lat double, lon double, acc double, dbm int"


def test_vantages_and_samples_against_loops(spark):
    rows = observed(random.Random(8), 300)
    df = spark.createDataFrame(rows, OBSERVED).repartition(5)
    places, kept = {}, {}
    for b, e, dev, t, lat, lon, acc, dbm in rows:
        own = places.setdefault(b, [])
        hit = next((v for v in own if metres(v[0], v[1], lat, lon) < max(80.0, v[2] + acc)), None)
        if hit:
            n = hit[4]
            hit[:] = [(hit[0] * n + lat) / (n + 1), (hit[1] * n + lon) / (n + 1), min(hit[2], acc), (hit[3] * n + dbm) / (n + 1), n + 1]
        else:
            own.append([lat, lon, acc, float(dbm), 1])
        s = kept.setdefault(b, [])
        if not s or metres(s[-1][1], s[-1][2], lat, lon) >= max(12.0, 0.5 * max(s[-1][3], acc)) or s[-1][4] != dev or t - s[-1][5] >= 600_000:
            s.append((e, lat, lon, acc, dev, t))
        elif acc < s[-1][3]:
            s[-1] = (e, lat, lon, acc, dev, t)
    got = folds.vantages(df, "bssid", "event_id").orderBy("bssid", "place").collect()
    assert [(r.bssid, r.place, r.n, round(r.lat, 9), round(r.dbm, 6)) for r in got] == [(b, k, v[4], round(v[0], 9), round(v[3], 6)) for b in sorted(places) for k, v in enumerate(places[b])]
    assert {(r.bssid, r.event_id) for r in folds.sampled(df, "bssid").collect()} == {(b, s[0]) for b, own in kept.items() for s in own}


def test_route_lines(spark):
    # a walk with a spike, a jump, near points and a gap
    steps = [(0, 0), (30, 60), (60, 120), (62, 125), (90, 180), (300, 300), (120, 185), (120, 240), (9000, 240), (150, 300)]
    rows = [("a", k, k * 20_000 + (2_000_000 if k > 8 else 0), *at(e, n), 5.0) for k, (e, n) in enumerate(steps)]
    rows += [("a", 10, 2_300_000, *at(200, 350), 900.0), ("a", 11, 2_320_000, *at(200, 350), 5.0), ("b", 0, 0, *at(0, 0), 5.0)]
    got = [(r.device, r.line, r.n) for r in folds.route_lines(spark.createDataFrame(rows, TRACK), "device").orderBy("device", "n").collect()]
    assert got == [("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 0, 4), ("a", 0, 5), ("a", 0, 6), ("a", 0, 7), ("a", 1, 9), ("a", 1, 11), ("b", 0, 0)] or got == [("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 0, 4), ("a", 0, 6), ("a", 0, 7), ("a", 1, 9), ("a", 1, 11), ("b", 0, 0)]


def test_route_lines_of_a_busy_key_in_parts(spark):
    """Lines are numbered over the parts between gaps, and no point of a line is near the one before it."""
    rng = random.Random(14)
    rows = [("a", k, k * 20_000 + (k // 30) * 2_000_000, *at(k * 12 + rng.uniform(-4, 4), rng.uniform(-4, 4)), 5.0) for k in range(300)]
    got = {r.n: r.line for r in folds.route_lines(spark.createDataFrame(rows, TRACK), "device").collect()}
    assert [got[k] for k in range(0, 300, 30)] == list(range(10)) and got[299] == 9
    for line in range(10):
        own = sorted(n for n, x in got.items() if x == line)
        assert all(n // 30 == line for n in own) and all(metres(*rows[a][3:5], *rows[b][3:5]) >= 20 for a, b in itertools.pairwise(own[:-1]))


def test_interval_nearest_against_all_pairs(spark):
    rng = random.Random(15)
    left = [(k, rng.choice([0, 100, rng.randrange(20_000)])) for k in range(300)]
    right = [(k, rng.choice([0, 100, 101, rng.randrange(20_000)]), rng.random()) for k in range(300)]
    got = {r.a: (r.gap, r.b, r.r_t, r.x) for r in joins.interval_nearest(spark.createDataFrame(left, "a long, t long"), spark.createDataFrame(right, "b long, t long, x double"), "t", 50, "a", "b").collect()}
    want = {a: min((abs(t - u), b, u, x) for b, u, x in right) for a, t in left}
    assert got == {a: w for a, w in want.items() if w[0] <= 50} and len(got) > 100


EVENT = "uid string, camera_id long, t_ms long, source_rank int, confidence int, note string"


def merged(old, new, aliases, within=600_000):
    """One event after another into a plain list; those of a known uid first."""
    there, known = [dict(zip(("uid", "camera_id", "t_ms", "source_rank", "confidence", "note"), r, strict=True)) for r in old], dict(aliases)
    names = {r["uid"] for r in there}

    def root(uid):
        while uid not in names and uid in known:
            uid = known[uid]
        return uid

    order = sorted(new, key=lambda r: (root(r[0]) not in names, r[2], r[0]))
    for r in order:
        e = dict(zip(("uid", "camera_id", "t_ms", "source_rank", "confidence", "note"), r, strict=True))
        to = next((x for x in there if x["uid"] == root(e["uid"])), None)
        near = [x for x in there if x["camera_id"] == e["camera_id"] and abs(x["t_ms"] - e["t_ms"]) <= within]
        to = to or min(near, key=lambda x: (abs(x["t_ms"] - e["t_ms"]), x["t_ms"], x["uid"]), default=None)
        if to is None:
            there.append(e)
            continue
        if (e["source_rank"], e["confidence"]) > (to["source_rank"], to["confidence"]):
            to |= {c: e[c] for c in ("t_ms", "source_rank", "confidence")}
        to["note"] = to["note"] or e["note"]
        if to["uid"] != e["uid"]:
            known[e["uid"]] = to["uid"]
    return sorted((tuple(x.values()) for x in there), key=str), known


def test_event_merge_against_one_by_one(spark):
    """Two new events a minute apart merge; chains of events, aliases of aliases, one camera with nine tenths of all."""
    rng = random.Random(16)
    event = lambda k, kind: (f"{kind}{k}", rng.choice([1] * 9 + [2]), rng.randrange(400) * 120_000, rng.randrange(3), rng.randrange(4), rng.choice([None, f"n{k}"]))
    old, new = [event(k, "o") for k in range(60)], [event(k, "e") for k in range(90)]
    new[3] = ("second", *new[3][1:])
    new[4] = ("o7", *new[4][1:])
    aliases = [("first", "o5"), ("second", "first")]
    new += [("x1", 77, 1_000, 0, 1, None), ("x2", 77, 61_000, 1, 0, "better"), ("x3", 77, 5_000_000, 0, 0, None)]
    kept, known = merge.merge_events(spark.createDataFrame(old, EVENT), spark.createDataFrame(new, EVENT), spark.createDataFrame(aliases, "uid string, target string"))
    want, names = merged(old, new, aliases)
    assert sorted((tuple(r) for r in kept.collect()), key=str) == want
    got = {r.uid: r.target for r in known.collect()}
    assert {k: v for k, v in got.items() if k not in ("first", "second")} == {k: v for k, v in names.items() if k not in ("first", "second")}
    assert ("x1", 77, 61_000, 1, 0, "better") in want and got["x2"] == "x1"


def test_places_in_order_against_a_loop(spark):
    rng = random.Random(17)
    nodes = list(range(200))
    pairs = [(a, b) for a in nodes for b in nodes if a < b and rng.random() < (0.9 if a == 0 and b % 3 else 0.02)]
    kept = []
    for n in nodes:
        if not any((k, n) in set(pairs) for k in kept):
            kept.append(n)
    out = graph.first_come(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(pairs, "before long, after long")).collect()
    assert sorted(r.node for r in out if r.kept) == kept and len(out) == 200


def test_trilateration_finds_the_place_and_keeps_to_the_prior(spark):
    rng = random.Random(9)
    anchors = [(-80, 10), (70, 40), (10, -90), (40, 90)]
    rows, truth = [], {}
    for k in range(20):
        e, n = rng.uniform(-50, 50), rng.uniform(-50, 50)
        truth[k] = at(e, n)
        rows += [(k, *at(*a), math.hypot(a[0] - e, a[1] - n) + rng.gauss(0, 1), 1.0) for a in anchors]
    rows.append((99, *at(0, 0), 5.0, 1000.0))
    prior = [(k, *at(0, 0), 500.0) for k in range(20)] + [(99, *at(7, 7), 1.0)]
    out = {r.k: r for r in locate.trilaterated(spark.createDataFrame(rows, "k long, lat double, lon double, metres double, sd double"), spark.createDataFrame(prior, "k long, p_lat double, p_lon double, p_sd double"), ["k"]).collect()}
    assert max(metres(out[k].lat, out[k].lon, *truth[k]) for k in truth) < 3
    assert metres(out[99].lat, out[99].lon, *at(7, 7)) < 0.1


def test_streamed_folds_take_a_busy_key_and_an_empty_table(spark):
    rows = observed(random.Random(10), 60)
    df = spark.createDataFrame([("b0", *r[1:]) if r[1] < 54 else r for r in rows], OBSERVED)
    assert folds.vantages(df, "bssid", "event_id").agg(F.sum("n")).first()[0] == 60
    assert folds.vantages(df.where("false"), "bssid", "event_id").count() == 0
