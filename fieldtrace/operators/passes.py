"""Passes of a device by an asset: runs of legs within reach, the closest approach, dwell, bearings, and the chance to have been in view."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .joins import grid_join
from .windows import merged_intervals

#: Points and weights of the Gauss-Hermite quadrature of seven points.
NODES, WEIGHTS = np.polynomial.hermite.hermgauss(7)
#: Share of passes that a device in view captures, times that of captures it reads.
CAPTURE_AND_READ = 0.97 * 0.93
#: The view of an asset of unknown make: half of its angle, the nearest and the farthest metres; and degrees that any view is taken wider.
UNKNOWN_VIEW, MARGIN = (12.5, 5.0, 35.0), 3.0
_DAY = 86_400_000


def with_neighbours(fixes: DataFrame, key: str, gap_ms: int, columns: list[str]) -> DataFrame:
    """Every fix with structs ``before`` and ``after`` of its key's fixes next to it in time, if they are no more than ``gap_ms`` away.

    A key is cut into days; a fix near midnight is copied into the other day too, so no key is ever sorted as a whole.
    """
    day = lambda c: F.floor(c / _DAY)
    spread = fixes.withColumn("__day", F.explode(F.array_distinct(F.array(*(day(F.col("t_ms") + d) for d in (0, -gap_ms, gap_ms))))))
    w = Window.partitionBy(key, "__day").orderBy("t_ms", "n")
    one = F.struct("n", "t_ms", *columns)
    both = spread.withColumns({"before": F.lag(one).over(w), "after": F.lead(one).over(w)}).where(F.col("__day") == day(F.col("t_ms"))).drop("__day")
    near = lambda c: F.when(F.abs(F.col(f"{c}.t_ms") - F.col("t_ms")) <= gap_ms, F.col(c))
    return both.withColumns({c: near(c) for c in ("before", "after")})


def legs(fixes: DataFrame, key: str = "device", gap_ms: int = 300_000, most_m: float = 1500.0) -> DataFrame:
    """Consecutive fixes of a key as legs (n, last, t0, t1, lat, lon, lat2, lon2, acc, acc2, speed, speed2); not those that are too long in time or space.

    ``fixes`` have key, n (their number in order), t_ms, lat, lon, acc and perhaps speed in m/s. A fix that no leg begins or ends at is a leg of its
    own, with ``last`` = n and both ends alike.
    """
    rows = fixes if "speed" in fixes.columns else fixes.withColumn("speed", F.lit(None).cast("double"))
    payload = ["lat", "lon", "acc", "speed"]
    both = with_neighbours(rows.select(key, "n", "t_ms", *payload), key, gap_ms, payload)
    linked = lambda c: F.coalesce(geo.haversine(F.col("lat"), F.col("lon"), F.col(f"{c}.lat"), F.col(f"{c}.lon")) <= most_m, F.lit(False))
    marked = both.withColumn("__goes_on", linked("after")).where(F.col("__goes_on") | ~linked("before"))
    end = lambda c: F.when(F.col("__goes_on"), F.col(f"after.{c}")).otherwise(F.col(c))
    return marked.select(key, "n", end("n").alias("last"), F.col("t_ms").alias("t0"), end("t_ms").alias("t1"), *payload, *(end(c).alias(f"{c}2") for c in payload))


def near_legs(leg_rows: DataFrame, assets: DataFrame, radius: float = 65.0, key: str = "device") -> DataFrame:
    """(key, id, dirs, view, n, last, leg, ...) of legs that come within ``radius`` metres of an asset, with their ends x0, y0, x1, y1 in its frame.

    ``assets`` have id, lat, lon, dirs (any number of directions, or null) and perhaps half, least_m, most_m, their view. ``share`` is where on the leg the
    closest approach is and ``metres`` how far; ``inside_ms`` is the time within the radius, as if at constant speed. Legs are looked for by points at
    most ``radius`` apart on them.
    """
    length = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    points = leg_rows.withColumn("__many", F.ceil(length / radius) + 1).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__many"))))
    share = F.col("__k") / F.col("__many")
    points = points.withColumns({"p_lat": F.col("lat") + (F.col("lat2") - F.col("lat")) * share, "p_lon": F.col("lon") + (F.col("lon2") - F.col("lon")) * share}).withColumnsRenamed({"lat": "lat1", "lon": "lon1", "acc": "acc1", "speed": "speed1"})
    view = F.struct(*(F.col(c).cast("double").alias(c) if c in assets.columns else F.lit(v).alias(c) for c, v in zip(("half", "least_m", "most_m"), UNKNOWN_VIEW, strict=True)))
    dirs = F.coalesce(F.col("dirs").cast("array<double>"), F.array().cast("array<double>")).alias("dirs")
    met = grid_join(points, assets.select("id", dirs, view.alias("view"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), 1.6 * radius, lat="p_lat", lon="p_lon")
    met = met.dropDuplicates([key, "n", "id"])
    x0, y0 = geo.frame_xy(F.col("lat1"), F.col("lon1"), F.col("a_lat"), F.col("a_lon"))
    x1, y1 = geo.frame_xy(F.col("lat2"), F.col("lon2"), F.col("a_lat"), F.col("a_lon"))
    leg = F.struct("lat1", "lon1", "lat2", "lon2", "acc1", "acc2", "speed1", "speed2")
    framed = met.select(key, "id", "dirs", "view", "a_lat", "a_lon", "n", "last", "t0", "t1", leg.alias("leg"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    a, b = dx * dx + dy * dy, F.col("x0") * dx + F.col("y0") * dy
    at = F.when(a > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -b / a))).otherwise(0.0)
    px, py = F.col("x0") + F.col("share") * dx, F.col("y0") + F.col("share") * dy
    near = framed.withColumn("share", at).withColumn("metres", F.sqrt(px * px + py * py)).where(F.col("metres") <= radius)
    root = F.sqrt(F.greatest(F.lit(0.0), b * b - a * (F.col("x0") * F.col("x0") + F.col("y0") * F.col("y0") - radius * radius)))
    inside = F.when(a > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-b + root) / a) - F.greatest(F.lit(0.0), (-b - root) / a))).otherwise(1.0)
    return near.withColumn("inside_ms", inside * (F.col("t1") - F.col("t0")))


def with_pass(near: DataFrame, key: str = "device") -> DataFrame:
    """Adds the number of the pass of each leg (``pass``): legs that share a fix are one. Also ``best``, the pass's leg of the closest approach.

    Of legs as near, to a millionth of a metre, the earlier one is the best.
    """
    w = Window.partitionBy(key, "id").orderBy("n")
    new = F.coalesce(F.lag("last").over(w) != F.col("n"), F.lit(False)).cast("int")
    numbered = near.withColumn("__new", new).withColumn("pass", F.sum("__new").over(w)).drop("__new")
    one = F.struct(F.floor(F.col("metres") * 1e6 + 0.5).alias("um"), "n", "last", "share", "t0", "t1", "x0", "y0", "x1", "y1", "leg")
    return numbered.withColumn("best", F.min(one).over(Window.partitionBy(key, "id", "pass")))


def _closest() -> dict[str, Column]:
    """Time, place, accuracy, speed and course of a pass at its closest approach."""
    b, leg = F.col("best"), F.col("best.leg")
    u, seconds = b["share"], (b["t1"] - b["t0"]) / 1000.0
    along = lambda p, q: p + u * (q - p)
    length = geo.haversine(leg["lat1"], leg["lon1"], leg["lat2"], leg["lon2"])
    own = F.when(u == 0, leg["speed1"]).when(u == 1, leg["speed2"])
    x, y = along(b["x0"], b["x1"]), along(b["y0"], b["y1"])
    known = (leg["acc1"] >= 0) & (leg["acc2"] >= 0)
    return {
        "c_ms": b["t0"] + F.floor(u * (b["t1"] - b["t0"]) + 0.5).cast("long"),
        "c_lat": along(leg["lat1"], leg["lat2"]),
        "c_lon": along(leg["lon1"], leg["lon2"]),
        "c_acc": F.when(known, along(leg["acc1"], leg["acc2"])).when(leg["acc1"] >= 0, leg["acc1"]).otherwise(leg["acc2"]),
        "speed_kmh": F.coalesce(F.when(own >= 0, own * 3.6), F.when(seconds > 0, length / seconds * 3.6)),
        "heading": F.when(length >= 3.0, geo.bearing(leg["lat1"], leg["lon1"], leg["lat2"], leg["lon2"])),
        "approach": F.coalesce(geo.plane_bearing(x, y), F.lit(0.0)),
        "c_x": x,
        "c_y": y,
        "v_x": F.when(seconds > 0, (b["x1"] - b["x0"]) / seconds).otherwise(0.0),
        "v_y": F.when(seconds > 0, (b["y1"] - b["y0"]) / seconds).otherwise(0.0),
    }


def passes_of(near: DataFrame, radius: float = 65.0, key: str = "device") -> DataFrame:
    """One row for each pass of legs ``with_pass``: times and dwell, fixes inside, distances at entry and exit, and the closest approach.

    Columns: key, id, pass, start_ms, end_ms, metres, dwell_ms, n_fixes, enter_m, exit_m; c_ms, c_lat, c_lon, c_acc, speed_kmh, heading (null below three
    metres), approach (the bearing from the asset), and c_x, c_y, v_x, v_y in the asset's frame, which ``with_bearings`` takes.
    """
    d0, d1 = F.sqrt(F.col("x0") * F.col("x0") + F.col("y0") * F.col("y0")), F.sqrt(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1"))
    ends = (F.col("__d1") <= radius) & (F.col("last") > F.col("n"))
    found = near.withColumns({"__d0": d0, "__d1": d1}).groupBy(key, "id", "pass").agg(
        F.min("t0").alias("start_ms"), F.max("t1").alias("end_ms"), F.min("metres").alias("metres"), F.sum("inside_ms").alias("dwell_ms"),
        (F.count_if(F.col("__d0") <= radius) + F.max_by(ends.cast("long"), "n")).alias("n_fixes"), F.min_by("__d0", "n").alias("enter_m"), F.max_by("__d1", "n").alias("exit_m"),
        F.first("best").alias("best"), F.first("a_lat").alias("a_lat"), F.first("a_lon").alias("a_lon"),
    )
    return found.withColumns(_closest()).drop("best")


def with_bearings(found: DataFrame, leg_rows: DataFrame, key: str = "device", off_ms: int = 10_000, gap_ms: int = 300_000) -> DataFrame:
    """Adds ``front`` and ``rear``, the bearings from the asset to the device ``off_ms`` before and after the closest approach of ``passes_of``.

    Where the device was is taken from the leg of that time (the first, of two), else from its velocity at the closest approach; nearer than half a
    metre, both are the bearing of the closest approach. Legs meet the times in buckets as long as a leg may last.
    """
    ask = found.select(key, "id", "pass", "a_lat", "a_lon", F.explode(F.array(F.struct(F.lit("front").alias("side"), (F.col("c_ms") - off_ms).alias("ms")), F.struct(F.lit("rear").alias("side"), (F.col("c_ms") + off_ms).alias("ms")))).alias("q")).select(key, "id", "pass", "a_lat", "a_lon", "q.*")
    bucket = lambda c: F.floor(c / gap_ms)
    moving = leg_rows.where("last > n").select(key, F.col("n").alias("__n"), "t0", "t1", "lat", "lon", "lat2", "lon2", F.explode(F.sequence(bucket(F.col("t0")), bucket(F.col("t1")))).alias("__bucket"))
    met = ask.withColumn("__bucket", bucket(F.col("ms"))).join(moving, [key, "__bucket"]).where("t0 <= ms and t1 >= ms")
    u = F.when(F.col("t1") > F.col("t0"), (F.col("ms") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    x, y = geo.frame_xy(F.col("lat") + u * (F.col("lat2") - F.col("lat")), F.col("lon") + u * (F.col("lon2") - F.col("lon")), F.col("a_lat"), F.col("a_lon"))
    first = lambda side: F.min(F.when(F.col("side") == side, F.struct("__n", x.alias("x"), y.alias("y")))).alias(f"__{side}")
    at = met.groupBy(key, "id", "pass").agg(first("front"), first("rear"))

    def bearing(side: str, sign: int) -> Column:
        there = F.col(f"__{side}")
        s = sign * off_ms / 1000.0
        px, py = F.coalesce(there["x"], F.col("c_x") + F.col("v_x") * s), F.coalesce(there["y"], F.col("c_y") + F.col("v_y") * s)
        return F.coalesce(geo.plane_bearing(px, py), F.col("approach"))

    both = found.join(at, [key, "id", "pass"], "left")
    return both.withColumns({"front": bearing("front", -1), "rear": bearing("rear", 1)}).drop("__front", "__rear")


def sampled_views(leg: dict[str, np.ndarray], dirs: np.ndarray, radius: float, most: int = 20_000) -> dict[str, np.ndarray]:
    """What each leg shows of itself to its asset, sampled every fifth of a second and every metre.

    ``leg``: x0, y0, x1, y1, seconds, before (the share of the leg before the closest approach), sigma (of the fixes), half, least_m, most_m, lone;
    ``dirs``: a row for each leg, filled up with NaN. Bit 7 i + j of ``bits`` says whether some sample is in view if all fixes were off by the i-th and
    j-th point of the quadrature; ``seen`` has a bit for each direction that sees a sample; seconds in view before and after the closest
    approach, within the range, and within the radius. Legs are worked on together as far as they have ``most`` samples.
    """
    legs_n = len(leg["x0"])
    many = np.maximum(np.ceil(np.maximum(leg["seconds"] / 0.2, np.hypot(leg["x1"] - leg["x0"], leg["y1"] - leg["y0"]))), 1).astype(np.int64)
    out = {c: np.zeros(legs_n, np.int64) for c in ("bits", "seen")} | {c: np.zeros(legs_n) for c in ("before_s", "after_s", "range_s", "inside_s")}
    total = np.cumsum(many)
    a = 0
    while a < legs_n:
        b = max(a + 1, int(np.searchsorted(total, total[a] - many[a] + most, "right")))
        n, own = many[a:b], np.repeat(np.arange(a, b), many[a:b])
        starts = np.cumsum(n) - n
        u = (np.arange(len(own)) - np.repeat(starts, n) + 0.5) / np.repeat(n, n)
        u = np.where(leg["lone"][own], 0.0, u)
        x, y = (leg[f"{c}0"][own] + u * (leg[f"{c}1"][own] - leg[f"{c}0"][own]) for c in "xy")
        step, early = (leg["seconds"] / many)[own], leg["lone"][own] | (u < leg["before"][own])
        low, high = np.maximum(leg["least_m"], 0.5)[own], leg["most_m"][own]
        facing = [(np.sin(np.radians(d)), np.cos(np.radians(d)), np.cos(np.radians(leg["half"][own]))) for d in (dirs[own, j] for j in range(dirs.shape[1]))]

        def views(px: np.ndarray, py: np.ndarray, low=low, high=high, facing=facing) -> list[np.ndarray]:
            far = np.hypot(px, py)
            ranged = (far >= low) & (far <= high)
            return [ranged & (px * east + py * north >= far * edge - 1e-9) for east, north, edge in facing]  # NaN is never in view

        any_of = lambda parts: reduce(np.logical_or, parts, np.zeros(len(own), bool))  # noqa: B023, E731
        seen = views(x, y)
        for j, s in enumerate(seen):
            out["seen"][a:b] |= np.logical_or.reduceat(s, starts).astype(np.int64) << j
        far, view = np.hypot(x, y), any_of(seen)
        for c, where in (("before_s", view & early), ("after_s", view & ~early), ("range_s", (far >= low) & (far <= high) & (far <= radius)), ("inside_s", far <= radius)):
            out[c][a:b] = np.add.reduceat(step * where, starts)
        out["seen"][a:b] |= (np.logical_or.reduceat(view & early, starts).astype(np.int64) << 61) | (np.logical_or.reduceat(view & ~early, starts).astype(np.int64) << 62)
        for i, p in enumerate(NODES):
            for j, q in enumerate(NODES):
                off = np.sqrt(2.0) * leg["sigma"][own]
                out["bits"][a:b] |= np.logical_or.reduceat(any_of(views(x + off * p, y + off * q)), starts).astype(np.int64) << (7 * i + j)
        a = b
    return out


_VIEW = pa.struct([("bits", pa.int64()), ("seen", pa.int64()), ("before_s", pa.float64()), ("after_s", pa.float64()), ("range_s", pa.float64()), ("inside_s", pa.float64())])
_NUMBERS = ("x0", "y0", "x1", "y1", "seconds", "before", "sigma", "half", "least_m", "most_m")


def views(near: DataFrame, radius: float = 65.0, key: str = "device") -> DataFrame:
    """(key, id, pass, in_view_s, front, rear, facing, camera_dir, p_view, p_read) of legs ``with_pass``: the chance to have been in the asset's view.

    The whole track of a pass is shifted by the error of its closest fix, as errors are alike over a pass; the chance is the weight of the shifts that
    bring it into the view of any direction. A leg's shifts are 49 bits, and those of a pass are the bits of its legs together. ``camera_dir`` is the first
    direction that sees the pass, else the first; ``facing`` is 1, 0, or -1 for an asset without a direction, whose chance is half
    the share of the time within the radius that is within its range. A lone fix in view shows both sides.
    """

    def over(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            leg = {c: columns[k].to_numpy(zero_copy_only=False).astype(np.float64) for k, c in enumerate(_NUMBERS)}
            leg["lone"] = columns[len(_NUMBERS)].to_numpy(zero_copy_only=False).astype(bool)
            lists = columns[len(_NUMBERS) + 1].to_pylist()
            dirs = np.full((len(lists), max(map(len, lists), default=0)), np.nan)
            for k, d in enumerate(lists):
                dirs[k, : len(d)] = d
            made = sampled_views(leg, dirs, radius)
            yield pa.StructArray.from_arrays([pa.array(made[f.name], f.type) for f in _VIEW], fields=list(_VIEW))

    over.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    legs_of = near.withColumns({c: v for c, v in _closest().items() if c in ("c_ms", "c_acc")})
    seconds = (F.col("t1") - F.col("t0")) / 1000.0
    before = F.when(F.col("t1") > F.col("t0"), (F.col("c_ms") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    sigma = F.greatest(F.lit(1.0), F.when(F.col("c_acc") > 0, F.col("c_acc")).otherwise(8.0) / 1.515)
    inputs = [F.col(c) for c in ("x0", "y0", "x1", "y1")] + [seconds, before, sigma, F.col("view.half") + MARGIN, F.col("view.least_m"), F.col("view.most_m")]
    seen = legs_of.withColumn("v", F.arrow_udf(over, "bits long, seen long, before_s double, after_s double, range_s double, inside_s double")(*(c.cast("double") for c in inputs), F.col("last") == F.col("n"), "dirs"))
    enter = F.sqrt(F.col("x0") * F.col("x0") + F.col("y0") * F.col("y0"))
    total = seen.groupBy(key, "id", "pass").agg(
        F.bit_or("v.bits").alias("bits"), F.bit_or("v.seen").alias("seen"), F.sum("v.before_s").alias("b"), F.sum("v.after_s").alias("a"), F.sum("v.range_s").alias("r"), F.sum("v.inside_s").alias("s"),
        F.first("dirs").alias("dirs"), F.bool_or(F.col("last") == F.col("n")).alias("lone"), F.min_by(((enter >= F.col("view.least_m")) & (enter <= F.col("view.most_m"))).cast("double"), "n").alias("begins"),
    )
    some = F.size("dirs") > 0
    early, late = F.getbit("seen", F.lit(61)) == 1, F.getbit("seen", F.lit(62)) == 1
    share = F.when(F.col("s") > 0, F.col("r") / F.col("s")).otherwise(F.col("begins"))
    p = F.when(some, F.least(F.lit(1.0), chance(F.col("bits")))).otherwise(share * 0.5)
    shown = F.filter(F.sequence(F.lit(0), F.greatest(F.size("dirs") - 1, F.lit(0))), lambda j: F.getbit("seen", j) == 1)
    at = F.when(F.size(shown) > 0, F.try_element_at(shown, F.lit(1))).otherwise(0)
    return total.select(
        key, "id", "pass", F.when(some, F.col("a") + F.col("b")).otherwise(F.col("r")).alias("in_view_s"), (some & early).alias("front"), (some & (late | (F.col("lone") & early))).alias("rear"),
        F.when(some, (early | late).cast("int")).otherwise(-1).alias("facing"), F.try_element_at("dirs", at + 1).alias("camera_dir"), p.alias("p_view"), (p * CAPTURE_AND_READ).alias("p_read"),
    )


def chance(bits: Column) -> Column:
    """The weight of the shifts whose bits are set."""
    weight = F.array(*(F.lit(float(a * b / np.pi)) for a in WEIGHTS for b in WEIGHTS))
    return F.aggregate(F.sequence(F.lit(0), F.lit(48)), F.lit(0.0), lambda s, i: s + F.when(F.getbit(bits, i) == 1, F.element_at(weight, i + 1)).otherwise(0.0))


def changed_ranges(changed: DataFrame, key: str = "device", around_ms: int = 1_800_000) -> DataFrame:
    """(key, low, high): the times of changed fixes (key, t_ms) with ``around_ms`` on either side, merged where they meet.

    Times are brought together by quarters of ``around_ms`` before they are sorted, so a key's bulk of new fixes isn't one window.
    """
    part = F.floor(F.col("t_ms") / (around_ms // 4))
    spans = changed.groupBy(key, part.alias("__part")).agg((F.min("t_ms") - around_ms).alias("low"), (F.max("t_ms") + around_ms).alias("high"))
    return merged_intervals(spans, [key], "low", "high").select(key, "low", "high")


def backfilled(old: DataFrame, fixes: DataFrame, changed: DataFrame, assets: DataFrame, key: str = "device", around_ms: int = 1_800_000, radius: float = 65.0) -> DataFrame:
    """Passes after some fixes have come late: those of ``old`` (key, id, start_ms, end_ms, c_ms, metres, dwell_ms) outside the changed times, and those inside detected again.

    ``fixes`` are all there are now, ``changed`` (key, t_ms) those that ``old`` doesn't know. A changed range owns the passes whose closest approach is in it, from its low end up to, but
    not with, its high one; fixes are read as far again on either side. Only what was read is detected: days that nothing changed in are left alone. With passes shorter than
    ``around_ms`` the result is that of a whole detection.
    """
    day = lambda c: F.floor(c / _DAY)
    ranges = changed_ranges(changed, key, around_ms)

    def within(rows: DataFrame, at: str, more: int, how: str) -> DataFrame:
        low, high = F.col("low") - more, F.col("high") + more
        days = ranges.select(F.col(key).alias("__key"), low.alias("__low"), high.alias("__high"), F.explode(F.sequence(day(low), day(high))).alias("__day"))
        return rows.join(days, (F.col(key) == F.col("__key")) & (day(F.col(at)) == F.col("__day")) & (F.col(at) >= F.col("__low")) & (F.col(at) < F.col("__high")), how)

    columns = [key, "id", "start_ms", "end_ms", "c_ms", "metres", "dwell_ms"]
    again = passes_of(with_pass(near_legs(legs(within(fixes, "t_ms", around_ms, "left_semi"), key), assets, radius, key), key), radius, key)
    return within(old.select(columns), "c_ms", 0, "left_anti").union(within(again.select(columns), "c_ms", 0, "left_semi"))
