"""Stops, sightings and segments of a device's fixes: folds that compare a fix with what was kept before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .folds import _far, _grouped, farther, streamed
from .graph import cut
from .joins import _grid, grid_join
from .windows import metres

#: A coarse fix doesn't replace a precise one so soon.
COARSE_WAIT_MS = 12 * 3_600_000


def stop_log(fixes: DataFrame, key: str = "device", moved_m: float = 75.0) -> DataFrame:
    """(key, arrived_ms, departed_ms, lat, lon, source, n): where a device stopped. ``departed_ms`` is its last confirmation before the next stop, null for the last stop.

    A fix (n, t_ms, lat, lon, source) is ignored if it is coarse (source ``ip``) within half a day of a precise one. It begins a stop if it is farther than ``moved_m`` from the current one or of another source, else it
    confirms the current stop. A stop is given when the next one begins, so nothing that was given is changed.
    """

    def begin():
        now: list[dict] = []

        def step(f: dict) -> list[dict]:
            if now and f["source"] == "ip" and now[0]["source"] != "ip" and f["t_ms"] - now[0]["last"] < COARSE_WAIT_MS:
                return []
            if now and f["source"] == now[0]["source"] and _far(now[0], f) <= moved_m:
                now[0]["last"], now[0]["n"] = f["t_ms"], now[0]["n"] + 1
                return []
            gone = [{**now[0], "departed_ms": now[0]["last"]}] if now else []
            now[:] = [{key: f[key], "arrived_ms": f["t_ms"], "lat": f["lat"], "lon": f["lon"], "source": f["source"], "n": 1, "last": f["t_ms"]}]
            return gone

        return step, lambda: [{**s, "departed_ms": None} for s in now]

    return streamed(fixes.select(key, "n", "t_ms", "lat", "lon", "source"), [key], ["t_ms", "n"], begin, f"{key} {dict(fixes.dtypes)[key]}, arrived_ms long, departed_ms long, lat double, lon double, source string, n long")


def place_sightings(seen: DataFrame, key: str = "bssid", keep: int = 24) -> DataFrame:
    """(key, place, lat, lon, acc, t_ms): the newest ``keep`` places where a transmitter was seen, oldest first.

    A sighting (event_id, t_ms, lat, lon, acc) within the larger accuracy of a place, the first such, refreshes it, and moves it if it is more accurate; else it is a new place. An unknown accuracy counts as 50 km.
    """

    def begin():
        places: list[dict] = []

        def step(o: dict) -> list[dict]:
            acc = o["acc"] if o["acc"] and o["acc"] > 0 else 50_000.0
            there = next((p for p in places if not farther(p, o, limit := max(p["acc"], acc)) and _far(p, o) <= limit), None)
            if there is None:
                places.append({key: o[key], "lat": o["lat"], "lon": o["lon"], "acc": acc, "t_ms": o["t_ms"]})
                del places[:-keep]
            else:
                there |= {"t_ms": o["t_ms"]} | ({"lat": o["lat"], "lon": o["lon"], "acc": acc} if acc < there["acc"] else {})
            return []

        return step, lambda: [{**p, "place": k} for k, p in enumerate(places)]

    return streamed(seen.select(key, "event_id", "t_ms", "lat", "lon", "acc"), [key], ["t_ms", "event_id"], begin, f"{key} {dict(seen.dtypes)[key]}, place int, lat double, lon double, acc double, t_ms long")


def reference_anchors(anchors: DataFrame, metres_apart: float = 100.0) -> DataFrame:
    """(id, kept): which reference anchors (id, placed_ms, lat, lon) stay: the newest of those within ``metres_apart`` of each other, then the next that is clear of all that stay.

    In each round the newest open anchor of each cell is looked at; it stays if no newer open one is near it, and then all near it go. So the anchors that are looked at are few where many
    stand, no pairs of all anchors are made, and the newest open anchor of all is always decided. Anchors without a time or place stay and count for no other.
    """
    every = anchors.select("id", "placed_ms", "lat", "lon")
    known = F.col("id").isNotNull() & F.col("placed_ms").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    open_ = cut(every.where(known))
    of_points, _ = _grid(metres_apart, 1_000_000, "lat", "lon")
    order = F.struct((-F.col("placed_ms")).alias("ms"), "id")
    decided = every.where(~known).select("id", F.lit(True).alias("kept"))
    while not open_.isEmpty():
        tops = of_points(open_).groupBy("__y", "__x").agg(F.min_by(F.struct("id", "placed_ms", "lat", "lon"), order).alias("t"))
        tops = cut(tops.select(F.col("t.id").alias("t_id"), F.col("t.placed_ms").alias("t_ms"), "t.lat", "t.lon"))
        newer = (F.col("placed_ms") > F.col("t_ms")) | ((F.col("placed_ms") == F.col("t_ms")) & (F.col("id") < F.col("t_id")))
        waits = grid_join(open_, tops, metres_apart, per_degree=1_000_000).where(newer).select("t_id").distinct()
        stay = cut(tops.join(waits, "t_id", "left_anti").select("t_id", "lat", "lon"))
        near = grid_join(open_, stay, metres_apart, per_degree=1_000_000).select("id", F.lit(False).alias("kept"))
        gone = cut(near.union(stay.select("t_id", F.lit(True))).groupBy("id").agg(F.max("kept").alias("kept")))
        decided = decided.union(gone)
        open_ = cut(open_.join(gone, "id", "left_anti"))
    return decided


def still_fixes(fixes: DataFrame, key: str = "device", around_m: float = 32.0) -> DataFrame:
    """(key, n, lat, lon, state): fixes of a device at rest held at its anchor: ``free``, ``held`` or ``rejected``.

    ``fixes`` have n, t_ms, lat, lon, acc (null if unknown), still (at rest) and stirred (speed, steps or shaking tell that it moves). At rest the first fix is the anchor; a fix within ``around_m`` is held at it, and moves
    it by 6 % if more accurate than 15 m. A farther one becomes the anchor if the device is stirred, or if it is the third in a row within 20 m of the first of them and better than 25 m; else it is rejected.
    """

    def begin():
        at: dict = {}

        def step(f: dict) -> list[dict]:
            out = {key: f[key], "n": f["n"], "lat": f["lat"], "lon": f["lon"], "state": "free"}
            if not f["still"]:
                at.clear()
                return [out]
            anchor, tried = at.get("anchor"), at.get("tried")
            if anchor is not None and _far(anchor, f) <= around_m:
                if f["acc"] is not None and f["acc"] < 15:
                    anchor |= {c: 0.94 * anchor[c] + 0.06 * f[c] for c in ("lat", "lon")}
                at.pop("tried", None)
                return [out | {"lat": anchor["lat"], "lon": anchor["lon"], "state": "held"}]
            if anchor is not None and not f["stirred"]:
                again = tried is not None and _far(tried, f) < 20 and f["acc"] is not None and f["acc"] < 25
                at["tried"] = tried = {**tried, "times": tried["times"] + 1} if again else {"lat": f["lat"], "lon": f["lon"], "times": 1}
                if tried["times"] < 3:
                    return [out | {"state": "rejected"}]
            at.clear()
            at["anchor"] = {"lat": f["lat"], "lon": f["lon"]}
            return [out]

        return step, list

    kinds = dict(fixes.dtypes)
    return streamed(fixes.select(key, "n", "t_ms", "lat", "lon", "acc", "still", "stirred"), [key], ["t_ms", "n"], begin, f"{key} {kinds[key]}, n {kinds['n']}, lat double, lon double, state string")


#: Modes of a segment, and how long a rest may be in it: a red light doesn't end a drive.
STILL, FOOT, VEHICLE = 0, 1, 2
MODES, HOLDS_MS = ("still", "foot", "vehicle"), {VEHICLE: 180_000, FOOT: 120_000}
VEHICLE_KMH, FOOT_KMH = 14.0, 0.8


def _spikes(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Which points go out by more than 30 m and come back to within 18 m."""
    out = np.zeros(len(lat), bool)
    if len(lat) > 2:
        step = _steps(lat[:-1], lon[:-1], lat[1:], lon[1:])
        out[1:-1] = (step[:-1] > 30) & (step[1:] > 30) & (_steps(lat[:-2], lon[:-2], lat[2:], lon[2:]) < 18)
    return out


def _steps(a, b, c, d) -> np.ndarray:
    s = np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * geo.EARTH * np.arcsin(np.minimum(1.0, np.sqrt(s)))


def segment_modes(ms: np.ndarray, lat: np.ndarray, lon: np.ndarray, told: np.ndarray) -> tuple[list[int], list[int]]:
    """(first row, mode) of each segment of a run without a gap; a segment but the first begins with the last row of the one before it. ``told`` is -1 where the source names no mode.

    What a row would be is known beforehand from its speed; only the automaton with its holds is a walk.
    """
    step = np.concatenate([[0.0], _steps(lat[:-1], lon[:-1], lat[1:], lon[1:])])
    dt = np.diff(ms, prepend=ms[:1])
    kmh = np.where(dt > 500, step / np.maximum(dt, 1) * 3600, 0.0)
    own = np.where(told >= 0, told, np.where(kmh >= VEHICLE_KMH, VEHICLE, np.where(kmh >= FOOT_KMH, FOOT, STILL)))
    keeps = (told < 0) & _spikes(lat, lon)
    starts, modes, size = [0], [int(told[0]) if told[0] >= 0 else STILL], 1
    for k in range(1, len(ms)):
        mode = modes[-1]
        new = mode if keeps[k] or (own[k] == STILL and dt[k] < HOLDS_MS.get(mode, 0)) else int(own[k])
        if size >= 2 and new != mode:
            starts.append(k - 1)
            modes.append(new)
            size = 2
        else:
            modes[-1] = new
            size += 1
    return starts, modes


def drawn_segment(mode: int, lat: np.ndarray, lon: np.ndarray, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lat, lon) that a segment is drawn by: the weighted centroid of a rest, a walk without coarse fixes, spikes and small steps, or a drive smoothed along its way."""
    every = np.arange(len(lat))
    if mode == STILL:
        w = 1 / np.maximum(acc, 1.0) ** 2
        return every[:1], np.array([(w @ lat) / w.sum()]), np.array([(w @ lon) / w.sum()])
    if mode == FOOT:
        keep = every[acc <= 35] if (acc <= 35).sum() >= 2 and len(lat) > 2 else every
        keep = keep[~_spikes(lat[keep], lon[keep])]
        out: list[int] = []
        for k in keep.tolist():
            if not out or k == keep[-1] or metres(lat[out[-1]], lon[out[-1]], lat[k], lon[k]) >= 2.5:
                out.append(k)
        return np.array(out, int), lat[out], lon[out]
    rows, y, x = [0], [lat[0]], [lon[0]]
    for k in range(1, len(lat)):
        if metres(y[-1], x[-1], lat[k], lon[k]) > 250 and acc[k] > 30:
            continue
        rows.append(k)
        y.append(0.65 * lat[k] + 0.35 * y[-1])
        x.append(0.65 * lon[k] + 0.35 * x[-1])
    return np.array(rows), np.array(y), np.array(x)


def mode_segments(fixes: DataFrame, key: str = "device", gap_ms: int = 600_000) -> DataFrame:
    """(key, start_ms, end_ms, mode, k, t_ms, lat, lon): the points by which each segment of a device's fixes (n, t_ms, lat, lon, acc, source) is drawn.

    A gap or a change of mode begins a segment. The source tells the mode if it names one, else the speed does; rests shorter than the mode's hold belong to it. Segments of walks with fewer than two points are left out.
    Keys are split at gaps, as nothing is carried over one.
    """

    def over(t: pa.Table) -> pa.Table:
        ms, lat, lon, acc, told = (t[c].to_numpy() for c in ("t_ms", "lat", "lon", "acc", "told"))
        starts, modes = segment_modes(ms, lat, lon, told)
        ends = [s + 1 for s in starts[1:]] + [len(ms)]
        made: list[dict] = []
        for a, b, mode in zip(starts, ends, modes, strict=True):
            rows, y, x = drawn_segment(mode, lat[a:b], lon[a:b], acc[a:b])
            if mode == FOOT and len(rows) < 2:
                continue
            made += [{key: t[key][0].as_py(), "start_ms": int(ms[a]), "end_ms": int(ms[b - 1]), "mode": MODES[mode], "k": k, "t_ms": int(ms[a + r]), "lat": float(p), "lon": float(q)} for k, (r, p, q) in enumerate(zip(rows.tolist(), y, x, strict=True))]
        schema = pa.schema([t.schema.field(key), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mode", pa.string()), ("k", pa.int32()), ("t_ms", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64())])
        return pa.Table.from_pylist(made, schema)

    s = F.lower("source")
    told = F.when(s.contains("vehicle"), VEHICLE).when(s.contains("foot"), FOOT).when(s.contains("stationary"), STILL).otherwise(-1)
    rows = fixes.select(key, "n", "t_ms", "lat", "lon", F.col("acc").cast("double").alias("acc"), F.coalesce(told, F.lit(-1)).alias("told")).where("not (lat = 0 and lon = 0)")
    return _grouped(rows, [key], ["t_ms", "n"], ("t_ms", gap_ms), over, f"`{key}` {dict(fixes.dtypes)[key]}, start_ms long, end_ms long, mode string, k int, t_ms long, lat double, lon double")
