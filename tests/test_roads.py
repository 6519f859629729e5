"""Watched ways and matched passes, against plain Python over all paths and on known scenes."""

import itertools
import math
import random

import numpy as np
import pytest

from fieldtrace.operators import passes, roads

WAY = "way long, highway string, layer int, oneway int, nodes array<long>, points array<struct<lat: double, lon: double>>"
ASSET = "id long, lat double, lon double, dirs array<double>, layer int"
TRACK = "device string, n long, t_ms long, lat double, lon double, acc double"
ARC = 111_194.92664455873


def at(east, north):
    return 40.0 + north / ARC, -75.0 + east / (ARC * math.cos(math.radians(40.0)))


def road(way, x0, y0, x1, y1, first, layer=0, oneway=0, highway="secondary", parts=6):
    points = [at(x0 + k / parts * (x1 - x0), y0 + k / parts * (y1 - y0)) for k in range(parts + 1)]
    return way, highway, layer, oneway, [first + k for k in range(parts + 1)], points


def drive(device, x0, y0, x1, y1, acc=5.0):
    n = int(math.hypot(x1 - x0, y1 - y0) / 15)
    return [(device, k, 1_790_000_000_000 + k * 1000, *at(x0 + k / n * (x1 - x0), y0 + k / n * (y1 - y0)), acc) for k in range(n + 1)]


MAIN, BESIDE, BRIDGE = road(1001, -400, 0, 400, 0, 100), road(1002, -400, -22, 400, -22, 200), road(1003, 10, -400, 10, 400, 300, layer=1)


def watched(spark, assets, ways):
    a, w = spark.createDataFrame(assets, ASSET), spark.createDataFrame(ways, WAY)
    near = roads.asset_legs(a, w)
    return {r.id: r for r in roads.watched_ways(a, near).collect()}


def test_watched_ways(spark):
    """Along the direction first, the asset's layer next; legs of any length are found; a service way counts as ten metres farther."""
    lane = road(1004, -50, 14, 50, 14, 400, highway="service")
    long_way = road(1005, -9000, 5000, 9000, 5000, 500, parts=1)
    cams = [(1, *at(0, 6), [90.0], None), (2, *at(0, 6), [], None), (3, *at(4, 6), [0.0], None), (4, *at(4, 6), [0.0], 0), (5, *at(200, 200), [90.0], None), (6, *at(-100, 9), None, 0), (7, *at(10, 300), None, 0), (8, *at(4321, 5020), [45.0, 271.0], None)]
    got = watched(spark, cams, [MAIN, BESIDE, BRIDGE, lane, long_way])
    assert [(got[k].way, got[k].basis) for k in range(1, 9)] == [
        (1001, "direction"), (1001, "nearest"), (1003, "direction"), (1001, "nearest_no_direction_match"), (None, "none"), (1001, "nearest"), (None, "none"), (1005, "direction"),
    ]
    assert got[1].metres == pytest.approx(6, abs=0.1) and got[8].metres == pytest.approx(20, abs=0.3) and got[1].bearing == pytest.approx(90, abs=0.1)


def matched(spark, cam, ways, *tracks, dirs=(90.0,)):
    a, w = spark.createDataFrame([(1, *cam, list(dirs), None)], ASSET), spark.createDataFrame(ways, WAY)
    fixes = spark.createDataFrame([r for t in tracks for r in t], TRACK)
    found = passes.passes_of(passes.with_pass(passes.near_legs(passes.legs(fixes), a)))
    near = roads.asset_legs(a, w)
    return {r.device: r for r in roads.matched_passes(found, fixes, w, near, roads.watched_ways(a, near)).collect()}


def test_passes_on_known_scenes(spark):
    """The watched road, one beside it, a bridge over it, a lane within its axis, and a coarse track between two."""
    lane = road(1004, -400, 8, 400, 8, 400)
    got = matched(spark, at(0, -4), [MAIN, BESIDE, BRIDGE, lane], drive("on", -300, 0, 300, 0), drive("beside", -300, -22, 300, -22), drive("over", 10, -300, 10, 300), drive("lane", -300, 9, 300, 9), drive("coarse", -300, -11, 300, -11, acc=60.0))
    assert {k: r.status for k, r in got.items()} == dict.fromkeys(got, "ok") and len(got) == 5
    assert (got["on"].verdict, got["on"].matched, got["on"].layers) == ("on_watched_way", 1001, "same") and got["on"].factor > 0.95
    assert (got["beside"].verdict, got["beside"].matched) == ("parallel_road", 1002) and got["beside"].factor < 0.25 and got["beside"].offset_m == pytest.approx(22, abs=0.5)
    assert (got["over"].verdict, got["over"].layers) == ("different_layer", "different") and got["over"].factor < 0.3
    assert got["lane"].verdict == "near_axis" and got["lane"].factor > 0.9
    assert 0.2 < got["coarse"].p_watched < 0.8 and got["coarse"].verdict == "ambiguous"
    assert got["on"].n_samples == len([k for k in range(41) if abs(-300 + k * 15) <= 99.9]) and got["on"].n_candidates >= 3


def test_against_a_oneway(spark):
    """A dual carriageway: the other side's drivers go against the watched oneway."""
    east, west = road(1, -400, 0, 400, 0, 100, oneway=1), road(2, 400, 14, -400, 14, 200, oneway=1)
    got = matched(spark, at(0, -6), [east, west], drive("with", -300, 0, 300, 0), drive("other", 300, 14, -300, 14))
    assert got["with"].verdict == "on_watched_way" and not got["with"].opposite
    assert got["other"].verdict == "opposite_direction" and got["other"].opposite and got["other"].p_watched == 0.0 and got["other"].factor == pytest.approx(0.1)


def test_no_roads_and_nothing_watched(spark):
    far = road(7, -400, 60, 400, 60, 100)
    assert matched(spark, at(0, 0), [far], drive("a", -300, 0, 300, 0))["a"].status == "no_watched_way"
    none = matched(spark, at(0, 0), [road(8, 3000, 0, 4000, 0, 100)], drive("a", -300, 0, 300, 0))["a"]
    assert (none.status, none.factor, none.p_watched, none.verdict) == ("no_roads", 1.0, 1.0, None)


@pytest.mark.parametrize("seed", range(25))
def test_path_costs_against_all_paths(seed):
    rng = random.Random(seed)
    n, ways = rng.randint(1, 4), rng.randint(1, 4)
    of_layer, of_nodes = [rng.choice([0, 1]) for _ in range(ways)], [set(rng.sample(range(5), 2)) for _ in range(ways)]
    rows = []
    for k in range(n):
        for w in sorted(rng.sample(range(ways), rng.randint(1, ways))):
            rows.append((k, 10 * w, rng.uniform(0, 5), rng.random() < 0.5))
    closest, win = rng.randrange(n), [rng.random() < 0.5 for _ in range(n)]
    win[closest] = True
    sample, way, cost, fits = (np.array(x) for x in zip(*rows, strict=True))
    got = roads.path_costs(sample, way, cost, fits, np.array([of_layer[w // 10] for w in way]), [of_nodes[w // 10] for w in way], np.array([win[k] for k in sample]), closest)

    def change(a, b):
        return 0.0 if a == b else 0.3 if of_nodes[a // 10] & of_nodes[b // 10] else 5.0 if of_layer[a // 10] != of_layer[b // 10] else 2.0

    with_it = without = best = (math.inf, None)
    for path in itertools.product(*[[r for r in rows if r[0] == k] for k in range(n)]):
        total = sum(r[2] for r in path) + sum(change(a[1], b[1]) for a, b in itertools.pairwise(path))
        here = path[closest]
        best = min(best, (total, here[1]))
        if not here[3]:
            without = min(without, (total, here[1]))
        if all(r[3] for k, r in enumerate(path) if win[k]):
            with_it = min(with_it, (total, here[1]))
    assert got[0] == pytest.approx(with_it[0]) and got[1] == pytest.approx(without[0])
    assert way[got[2]] == best[1] and sample[got[2]] == closest
    assert (got[3] == -1) == (without[1] is None) and (got[3] == -1 or way[got[3]] == without[1])


def test_samples_by_ways_are_no_table(spark, monkeypatch):
    """Forty ways within reach of all samples of a pass: what is written are passes, samples and facts, never a row for a sample and a way."""
    written = []
    cut = roads.cut
    monkeypatch.setattr(roads, "cut", lambda df: (made := cut(df), written.append(made.count()))[0])
    ways = [road(1001 + k, -400, 0.25 * k, 400, 0.25 * k, 100 * (k + 1), parts=2) for k in range(40)]
    got = matched(spark, at(0, -4), ways, drive("on", -300, 0, 300, 0))["on"]
    assert got.status == "ok" and got.n_candidates == 40 and got.n_samples > 10
    assert max(written) < 40 * got.n_samples
