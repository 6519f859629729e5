"""Steps whose work must follow the rows, not their pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import fusion, plates
from fieldtrace.operators import blocks, folds, joins, merge, stops, vantage, windows
from fieldtrace.operators.windows import metres
from fieldtrace.plans import catalog
from fieldtrace.streaming import tracking


def test_token_sets_meet_once_whatever_their_rows(spark):
    w = spark.range(4000).select(F.col("id").alias("w"), F.array(F.lit("x"), F.when(F.col("id") % 2 == 0, "x").otherwise("y")).alias("tokens"))
    o = spark.range(4000).select(F.col("id").alias("o"), F.array(F.lit("y"), F.lit("x"), F.lit("z")).alias("tokens"))
    assert joins.superset_classes(w, o).count() == 2
    assert joins.with_superset(w, o).count() == 4000 and joins.only_best_superset(w, o, "w", "o").count() == 0
    one = o.limit(1)
    assert joins.only_best_superset(w, one, "w", "o").agg(F.count("*"), F.min("m"), F.max("m")).first() == (4000, 3, 3)


def test_only_best_superset_against_all_pairs(spark):
    rng = random.Random(8)
    bag = lambda: rng.sample("a b c d e f g h i".split(), rng.randint(0, 5)) + ["a"] * rng.randint(0, 2)
    w, o = [(k, bag()) for k in range(80)], [(k, bag()) for k in range(60)]
    want = set()
    for i, x in w:
        able = [(len(set(y)), j) for j, y in o if x and set(x) <= set(y)]
        if able and Counter(m for m, _ in able)[min(able)[0]] == 1:
            want.add((i, min(able)[1], min(able)[0]))
    schema = "long, tokens array<string>"
    got = joins.only_best_superset(spark.createDataFrame(w, f"w {schema}"), spark.createDataFrame(o, f"o {schema}"), "w", "o").collect()
    assert {tuple(r) for r in got} == want and want and len(got) == len(want)


def _world(rng, n, lat=(40.0, 40.01), lon=(-75.0, -74.99)):
    return [(k, rng.uniform(*lat), rng.uniform(*lon)) for k in range(n)]


def _tables(spark, a, b):
    return spark.createDataFrame(a, "p long, lat double, lon double"), spark.createDataFrame(b, "q long, lat double, lon double")


@pytest.mark.parametrize("lat, lon", [((40.0, 40.01), (-75.0, -74.99)), ((-0.005, 0.005), (179.995, 180.005)), ((89.99, 90.0), (-180.0, 180.0)), ((70.0, 70.01), (10.0, 10.03))])
@pytest.mark.parametrize("k, most, beyond", [(1, 101.0, None), (5, 600.0, 150.0)])
def test_nearest_against_all_pairs(spark, monkeypatch, lat, lon, k, most, beyond):
    rng = random.Random(k)
    a, b = _world(rng, 400, lat, lon), _world(rng, 40, lat, lon)
    wrap = lambda rows: [(i, y, x - 360 if x > 180 else x) for i, y, x in rows]
    a, b = wrap(a), wrap(b)
    points, assets = _tables(spark, a, b)
    monkeypatch.setattr(joins, "_density", lambda *_: 0.05)  # too much, so that it takes several rounds
    got = {(r.q, r.r): r.p for r in joins.nearest(points, assets, "q", k, most, [F.col("__mm"), F.col("p")], beyond).collect()}
    want = {}
    for q, v, u in b:
        far = sorted((int(m * 1000 + 0.5), p) for p, y, x in a if (m := metres(y, x, v, u)) <= most and m > (beyond or -1))
        want |= {(q, r + 1): p for r, (_, p) in enumerate(far[:k])}
    assert got == want and want


def test_nearest_meets_few_pairs_in_a_crowd(spark):
    rng = random.Random(2)
    points, assets = _tables(spark, _world(rng, 20_000), _world(rng, 5))
    cells = joins._ring_cells(assets.withColumnsRenamed({"lat": "a_lat", "lon": "a_lon"}), 10.0, 160.0, 150.0)
    of_points, _ = joins._grid(10.0, 1_000_000_000, "lat", "lon")
    assert of_points(points).join(cells, ["__y", "__x"]).count() < 10_000
    assert joins.nearest(points, assets, "q", 20, 600.0, [F.col("__mm"), F.col("p")], 150.0).count() == 100


@pytest.mark.parametrize("radius", [30.0, 200.0])
def test_reached_against_all_pairs(spark, radius):
    rng = random.Random(7)
    a, b = _world(rng, 300), _world(rng, 60)
    points, assets = _tables(spark, a, b)
    got = joins.reached(points.withColumn("g", F.col("p") % 4), assets, radius, "g", "q").collect()
    want = {(p % 4, q) for p, y, x in a for q, v, u in b if metres(y, x, v, u) <= radius}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_places_of_one_key_meet_the_best_of_their_cell_first(spark):
    rng = random.Random(5)
    rows = [(i, "k" if i % 3 else "m", y, x, rng.choice([None, 1, 2, 3]), f"p{i}" if i % 4 == 0 else None) for i, y, x in _world(rng, 300)]
    df = spark.createDataFrame(rows, "id long, key string, lat double, lon double, score int, phone string")
    got = {r.id: r.phone for r in merge.one_of_each_place(df, 200.0).collect()}
    want = {}
    for i, key, y, x, s, phone in rows:
        near = [r for r in rows if r[0] != i and r[1] == key and metres(y, x, r[2], r[3]) <= 200]
        if not any(s is not None and r[4] is not None and (r[4] > s or (r[4] == s and r[0] < i)) for r in near):
            want[i] = phone or min((r[5] for r in near if r[5]), default=None)
    assert got == want and len(want) < 200


class _Map:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {"getValue": self.held.get, "containsKey": self.held.__contains__, "updateValue": self.held.__setitem__, "removeKey": self.held.pop, "keys": lambda: list(self.held)}[name]


def test_waiting_rows_cost_calls_by_spans_and_one_timer():
    waiting = _Map()
    new = {ms: [(ms * 2, "a")] for ms in range(0, 3_000_000, 1000)}
    assert tracking.put_by(waiting, new) == 0 and tracking.put_by(waiting, {5: [(1, "b")]}) == 5
    got = list(tracking.taken_until(waiting, 1_499_000))
    assert got == [(ms, [(ms * 2, "a")]) if ms != 5 else (5, [(1, "b")]) for ms in sorted([5, *range(0, 1_500_000, 1000)])]
    assert tracking.first_waiting(waiting) == 1_500_000
    assert list(tracking.taken_until(waiting, 3_000_000)) == [(ms, [(ms * 2, "a")]) for ms in range(1_500_000, 3_000_000, 1000)]
    assert tracking.first_waiting(waiting) is None and waiting.calls < 60


def test_cumulative_distance_adds_whole_numbers(spark):
    plan = catalog.queries()["n11_cumulative_distance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "sum(__step" in plan and "bigint" in catalog.oracle_sql()["n11_cumulative_distance"].split("sum(")[1].split(" over")[0]
    steps = catalog.queries()["n11_cumulative_distance"](spark, "/root/testdata/sf0.001")
    assert dict(steps.dtypes)["total_dm"] == "bigint"


def test_hotlist_reads_only_texts_that_may_be_wanted(spark):
    reads = spark.range(3000).select(F.col("id").cast("string").alias("uid"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("plate"), F.lit(0.6).alias("sure"))
    wanted = spark.createDataFrame([("P1O", None), ("P77", None)], "wanted string, expires_ms long")
    assert {r.plate for r in plates.may_be(reads, wanted, "plate", "wanted").collect()} == {"P10", "P77"}
    got = {(r.uid, r.wanted, r.kind) for r in plates.hotlist(reads, wanted, spark.createDataFrame([("P5",)], "own string"), "uid", "plate", F.col("sure"), F.lit(1)).collect()}
    assert got == {("10", "P1O", "possible"), ("77", "P77", "exact")}


@pytest.mark.parametrize("size", [3, 10_000])
def test_short_parts_share_a_call_and_long_ones_stay_whole(spark, size):
    rng = random.Random(size)
    rows = [(k, f"u{i}", t, float(rng.randint(0, 9))) for k in (None, 1, 2, 3) for i, t in enumerate(sorted(rng.sample(range(0, 60_000_000, 60_000), 200)))]
    want, kept = [], set()
    for k in (None, 1, 2, 3):
        now = None
        for key, uid, t, far in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if now and t - now[2] <= 600_000:
                kept.discard((k, now[1]) if far < now[3] else None)
                now = [*((key, uid, t, far) if far < now[3] else now[:4]), now[4] + 1]
                want[-1] = now
            else:
                now = [key, uid, t, far, 1]
                want.append(now)
            kept.add((k, now[1]))
    df = spark.createDataFrame(rows, "camera_id int, uid string, t_ms long, distance_m double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        merged = folds.merged_passes(df, ["camera_id"])
        assert "FlatMapGroupsInArrow" not in merged._jdf.queryExecution().toString()
        assert sorted(map(str, map(list, merged.collect()))) == sorted(map(str, want))
        got = windows.fold(df, ["camera_id"], ["t_ms", "uid"], windows.kept_within(600_000, "distance_m"), restart=("t_ms", 600_000))
        assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().toString() and got.count() == len(rows)
        assert {(r.camera_id, r.uid) for r in got.where("kept").collect()} == kept
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_names_heard_next_hang_together_like_all_pairs(spark):
    rng = random.Random(4)
    rows = [(f"d{rng.randint(0, 2)}", rng.randint(0, 200_000) * 1000, f"n{rng.randint(0, 60)}") for _ in range(250)]
    got = windows.heard_next(spark.createDataFrame(rows, "device string, t_ms long, bssid string"), ["device"], "t_ms", "bssid", 900_000).collect()
    pairs = {tuple(sorted((x[2], y[2]))) for x in rows for y in rows if x[0] == y[0] and abs(x[1] - y[1]) <= 900_000 and x[2] != y[2]}

    def parts(links):
        low = {n: n for p in links for n in p}
        while True:
            after = {n: min([low[n], *(low[m] for p in links if n in p for m in p)]) for n in low}
            if after == low:
                return low
            low = after

    assert {tuple(r) for r in got} <= pairs and parts({tuple(r) for r in got}) == parts(pairs) and len(got) < len(pairs)
    crowd = spark.range(3000).select(F.lit("d").alias("device"), F.lit(5).cast("long").alias("t_ms"), F.concat(F.lit("n"), "id").alias("bssid"))
    assert windows.heard_next(crowd, ["device"], "t_ms", "bssid", 900_000).count() == 2999


def test_strings_are_dealt_out_whatever_the_file(spark):
    plan = catalog.queries()["k07_best_strings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_plate_tracks_share_a_call(spark):
    slots = F.array(F.array(F.struct(F.lit("A").alias("char"), F.lit(0.9).alias("p"))))
    reads = spark.range(600).select((F.col("id") % 200).alias("k"), "id", F.lit("A").alias("text"), slots.alias("slots"), F.lit(0.5).alias("q"), F.lit(0.9).alias("conf"))
    made = fusion.fused_tracks(reads, ["k"], ["id"])
    assert "FlatMapGroupsInArrow" not in made._jdf.queryExecution().toString()
    assert sorted((r.k, r.text, r.frames) for r in made.collect()) == [(k, "A", 3) for k in range(200)]
    rng = random.Random(6)
    for _ in range(5000):
        a, b = ("".join(rng.choices("AB01", k=rng.randint(0, 8))) for _ in range(2))
        assert fusion.alike(a, b) == (plates.similarity(a, b) >= fusion.ALIKE_FROM)


def test_runs_of_events_share_a_call(spark):
    schema = "uid string, camera_id long, t_ms long, source_rank int, confidence int, note string"
    old = spark.createDataFrame([(f"o{k}", k, 0, 1, 50, None) for k in range(300)], schema)
    new = spark.createDataFrame([(f"n{k}", k, 1000, 2, 60, "x") for k in range(300)], schema)
    events, aliases = merge.merge_events(old, new, spark.createDataFrame([], "uid string, target string"))
    assert sorted(events.collect()) == sorted((f"o{k}", k, 1000, 2, 60, "x") for k in range(300))
    assert sorted(map(tuple, aliases.collect())) == sorted((f"n{k}", f"o{k}") for k in range(300))


def test_metres_of_folds_are_plain_numbers(monkeypatch):
    rng = random.Random(9)
    for _ in range(200):
        a, b, c, d = rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-90, 90), rng.uniform(-180, 180)
        p, q = (np.array([np.cos(np.radians(y)) * np.cos(np.radians(x)), np.cos(np.radians(y)) * np.sin(np.radians(x)), np.sin(np.radians(y))]) for y, x in ((a, b), (c, d)))
        assert metres(a, b, c, d) == pytest.approx(2 * 6_371_000.0 * np.arcsin(min(1.0, np.linalg.norm(p - q) / 2)), abs=0.01)
    # a numpy function of one number costs some ten times as much
    monkeypatch.setattr(windows, "np", None)
    assert metres(40.0, -75.0, 40.0, -75.0) == 0.0


def test_latitudes_tell_only_what_is_too_far():
    rng = random.Random(10)
    for _ in range(3000):
        a, b = ({"lat": 40 + rng.uniform(-0.01, 0.01), "lon": rng.uniform(-0.01, 0.01)} for _ in range(2))
        limit = rng.choice([0.0, 80.0, 400.0, metres(a["lat"], a["lon"], b["lat"], b["lon"])])
        assert not (folds.farther(a, b, limit) and metres(a["lat"], a["lon"], b["lat"], b["lon"]) <= limit)
    assert folds.farther({"lat": 1.0}, {"lat": 1.01}, 1000.0)


def _joined(monkeypatch, module):
    """Radius, points and pairs of every grid join that ``module`` makes from now on."""
    seen, real = [], joins.grid_join

    def counted(points, assets, metres, **more):
        out = real(points, assets, metres, **more)
        seen.append((metres, points.count(), out.count()))
        return out

    monkeypatch.setattr(module, "grid_join", counted)
    return seen


def test_spots_near_poles_meet_no_views(spark, monkeypatch):
    rng = random.Random(4)
    poles = [(k, rng.uniform(40.0, 40.002), rng.uniform(-75.0, -74.998), [float(rng.randrange(360))], 12.5, 35.0) for k in range(600)]
    watchers = spark.createDataFrame(poles, "id long, lat double, lon double, dirs array<double>, half double, most_m double")
    spots = [(k % 600, rng.uniform(39.999, 40.003), rng.uniform(-75.001, -74.997)) for k in range(800)]
    seen = _joined(monkeypatch, vantage)
    got = {tuple(r) for r in vantage._unseen(spark.createDataFrame(spots, "id long, lat double, lon double"), watchers).collect()}

    def hidden(y, x):
        for _, v, u, dirs, half, most in poles:
            far = metres(y, x, v, u)
            if far <= vantage.POLE_M:
                return False
            if far <= min(most * vantage.FARTHER + vantage.FARTHER_M, vantage.FARTHEST_M):
                a, b, d = math.radians(v), math.radians(y), math.radians(x - u)
                off = math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d)))
                if any(abs((off - t + 180) % 360 - 180) <= half + vantage.WIDER_DEG for t in dirs):
                    return False
        return True

    want = {s for s in spots if hidden(*s[1:])}
    assert got == want and want
    assert sum(pairs for _, _, pairs in seen) < 12_000  # all views would be some 30,000 pairs


def test_anchors_meet_no_pairs_in_a_crowd(spark, monkeypatch):
    rng = random.Random(6)
    a = [(k, k * 7919 % 101, y, x) for k, y, x in _world(rng, 1500, (40.0, 40.003), (-75.0, -74.997))]
    seen = _joined(monkeypatch, stops)
    got = {r.id: r.kept for r in stops.reference_anchors(spark.createDataFrame([*a, (-1, None, 40.0, -75.0)], "id long, placed_ms long, lat double, lon double")).collect()}
    stay = []
    for k, _, y, x in sorted(a, key=lambda r: (-r[1], r[0])):
        if all(metres(y, x, v, u) > 100.0 for v, u in stay):
            stay.append((y, x))
            assert got[k]
        else:
            assert not got[k]
    assert got[-1] and len(got) == 1501
    assert sum(pairs for _, _, pairs in seen) < 60_000  # all pairs are some 440,000


def test_changed_in_place_numbers_as_changed_does(spark):
    old = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("v"), (-F.col("id")).alias("seq"))
    new = F.when(F.col("k") % 3 == 0, F.lit(2).cast("long")).otherwise(F.col("v"))
    want = merge.changed(old, old.select("k", new.alias("v")), "k", ["v"], "seq", 100)
    got = merge.changed_in_place(old, "k", {"v": new}, "seq", 100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()), key=tuple)
    assert "Join" not in got.where("seq < 100").select("k")._jdf.queryExecution().optimizedPlan().children().apply(0).toString()


@pytest.mark.parametrize("lat, lon", [((40.0, 40.003), (-75.0, -74.997)), ((-0.002, 0.002), (179.998, 180.002)), ((89.999, 90.0), (-180.0, 180.0))])
def test_folds_of_blocks_against_all_pairs(spark, monkeypatch, lat, lon):
    monkeypatch.setattr(blocks, "BLOCK", 37)  # several blocks a cell
    rng = random.Random(9)
    wrap = lambda rows: [(i, y, x - 360 if x > 180 else x) for i, y, x in rows]
    a, b = wrap(_world(rng, 400, lat, lon)), wrap(_world(rng, 50, lat, lon))
    points, assets = _tables(spark, a, b)
    far = {q: [(metres(y, x, v, u), p) for p, y, x in a] for q, v, u in b}
    got = {r.q: (r.n, r.closest) for r in blocks.counted(points, assets, 65.0, "p", "q").collect()}
    want = {q: (sum(m <= 65 for m, _ in f), min(f)[0]) for q, f in far.items() if min(f)[0] <= 65}
    assert got.keys() == want.keys() and want
    assert all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 1e-6 for q in want)
    best = {tuple(r) for r in blocks.best_near(points.withColumn("size", F.col("p") % 3), assets, 60.0, "size", "p", "q").collect()}
    want = set()
    for q, f in far.items():
        ranked = sorted((-(p % 3), int(m * 1000 + 0.5), p) for m, p in f if int(m * 1000 + 0.5) <= 60_000)
        want |= {(q, -s, mm, p) for s, mm, p in ranked[:1]}
    assert best == want
    pairs = {(r.p, r.q) for r in joins.grid_join(points, assets, 65.0).select("p", "q").collect()}
    assert pairs == {(p, q) for q, f in far.items() for m, p in f if m <= 65}


def test_passes_of_one_uid_are_flagged_once_each(spark):
    """At sf0.1 some passes share their uid: as in its SQL, each comes out once, and none is looked up by it."""
    d = "/root/testdata/sf0.1"
    assert catalog.queries()["t21_leaky_flags"](spark, d).count() == spark.read.parquet(f"{d}/lineitem.parquet").count()
