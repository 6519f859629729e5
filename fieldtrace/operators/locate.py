"""Positions of transmitters and receivers from levels and ranges, as plans of grouped sums and windows over one partitioning."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import local_xy

DEGREE = 111_320.0


#: Level at one metre (mean, deviation), exponent of the path loss, and the antenna's height above the receiver.
LEVEL_PRIOR, EXPONENT_PRIOR, HEIGHT_M = (-40.0, 8.0), (2.4, 0.5), 3.0
#: Deviation of a sample in dB; shares of its variance that neighbours may have in common, and how far that reaches; factors of the variance that are weighed.
SIGMA_DB, SHARED, DECAY_M, SCALES, DOUBT = 6.0, (0.75, 0.85), 8.0, (0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6), 6.0
#: A transmitter is seldom far beyond the nearest place where it was heard.
BEYOND_M = 9.0
#: A receiver hears nothing below this level, and by chance nothing above it.
SENSITIVITY_DBM, DEAF = -92.0, 0.2


def _squares(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """The cell of a place: squares of five metres up to a hundred, then sectors of rings that grow by a quarter. There are some 2,600 of them, however far samples are."""
    far = F.sqrt(x * x + y * y)
    near = far < 100
    ring = F.floor(F.log(F.greatest(far, F.lit(100.0)) / 100) / F.log(F.lit(1.25)))
    turn = F.floor((F.degrees(F.atan2(y, x)) + 180) / 14.4)
    return near, F.when(near, F.floor(x / 5)).otherwise(ring), F.when(near, F.floor(y / 5)).otherwise(turn)


def level_fit(samples: DataFrame, key: str, misses: DataFrame | None = None, ranges: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(key, n, places, lat, lon, cxx, cxy, cyy, r95, p0, exponent, scale): where a transmitter is, from levels ``dbm`` heard at lat, lon with accuracy acc.

    ``misses`` (key, lat, lon, times) are places that were scanned in vain, ``ranges`` (key, lat, lon, metres, sd) measured distances; both are optional, and those of a
    transmitter without samples don't count. ``samples`` may have t_ms and device; the fixes of one device on one day are taken to have an error in common.

    Samples are summed up by places first, so a busy transmitter is a table of places and not of samples. Then each transmitter has a
    posterior on grids of places around the loudest samples: see ``posterior_fit``.
    """
    s = samples.where("acc > 0 and acc <= 300")
    w = 1 / (1 + F.col("acc") * F.col("acc") / 400)
    strong = F.pow(F.lit(10.0), F.col("dbm") / 40) * w
    session = F.struct(*(c for c in (F.col("device") if "device" in samples.columns else None, F.floor(F.col("t_ms") / 86_400_000).alias("day") if "t_ms" in samples.columns else None) if c is not None), F.lit(0).alias("one"))
    home = s.groupBy(key).agg(
        F.count("*").alias("n"), (F.sum(strong * F.col("lat")) / F.sum(strong)).alias("lat0"), (F.sum(strong * F.col("lon")) / F.sum(strong)).alias("lon0"),
        (F.sum(w * F.col("acc") * F.col("acc")) / F.sum(w) / (1.515 * 1.515) / F.count_distinct(session)).alias("fix_var"),
    ).where(F.col("n") >= least)

    def placed(rows: DataFrame, kind: int, weight: Column, value: Column) -> DataFrame:
        x, y = local_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
        at = rows.select(key, "lat", "lon", weight.alias("w"), value.cast("double").alias("v")).join(home, key).withColumns({"x": x, "y": y})
        near, i, j = _squares(F.col("x"), F.col("y"))
        cells = at.groupBy(key, "n", "lat0", "lon0", "fix_var", near.alias("near"), i.alias("i"), j.alias("j"))
        mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
        return cells.agg(F.lit(kind).alias("kind"), F.sum("w").alias("w"), mean("x"), mean("y"), mean("v")).drop("near", "i", "j")

    rows = placed(s, 0, w, F.col("dbm"))
    if misses is not None:
        rows = rows.unionByName(placed(misses, 1, F.least(F.col("times").cast("double"), F.lit(3.0)), F.lit(0.0)))
    if ranges is not None:
        rows = rows.unionByName(placed(ranges, 2, 1 / F.greatest(F.col("sd") * F.col("sd"), F.lit(0.25)), F.col("metres")))
    type_of = dict(samples.dtypes)[key]

    def over(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        x, y, wt, v = (table[c].to_numpy() for c in ("x", "y", "w", "v"))
        n, lat0, lon0, fix_var = (table[c][0].as_py() for c in ("n", "lat0", "lon0", "fix_var"))
        part = lambda k: (x[kind == k], y[kind == k], v[kind == k], wt[kind == k])
        fit = posterior_fit(*part(0), misses=part(1), ranges=part(2))
        extra = fit["step"] ** 2 / 12 + fix_var
        row = {"n": n, "places": int((kind == 0).sum()), "lat": lat0 + fit["y"] / DEGREE, "lon": lon0 + fit["x"] / (DEGREE * np.cos(np.radians(lat0))), "cxx": fit["xx"] + extra, "cxy": fit["xy"], "cyy": fit["yy"] + extra, "r95": float(np.hypot(fit["r95"], 2.448 * np.sqrt(extra))), **{c: fit[c] for c in ("p0", "exponent", "scale")}}
        return pa.table({key: table[key].slice(0, 1), **{c: [x] for c, x in row.items()}})

    return rows.groupBy(key).applyInArrow(over, f"`{key}` {type_of}, n long, places long, lat double, lon double, cxx double, cxy double, cyy double, r95 double, p0 double, exponent double, scale double")


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(z) / np.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z / 2)
    return np.where(z < 0, tail / 2, 1 - tail / 2)


def posterior_fit(x: np.ndarray, y: np.ndarray, dbm: np.ndarray, m: np.ndarray, misses: tuple | None = None, ranges: tuple | None = None, cells: int = 32, rounds: int = 3) -> dict:
    """The posterior of one transmitter's place from the mean levels of places x, y, each of the weight of ``m`` samples.

    Level at one metre and exponent are normal a priori and integrated out at every point of the grid. The noise of a place has a share that falls off with the distance between
    places and a share of its own; which share it is, and how large the noise is, are weighed by the data, so that few or tight places don't pretend to know
    more than they do, and levels along a line leave both sides of it. Places that are far off the first fit count for less in the second. The
    last grid gives mean, covariance and the radius that holds 95 %.
    """
    apart = np.hypot(x[:, None] - x, y[:, None] - y)
    half = float(np.clip(max(np.ptp(x), np.ptp(y), 1.0) + 100, 120, 600))
    start = (float(x.min() + x.max()) / 2, float(y.min() + y.max()) / 2) if np.hypot(x, y).max() < 600 else (0.0, 0.0)
    noise = [(SIGMA_DB**2 * share * np.exp(-apart / DECAY_M), SIGMA_DB**2 * (1 - share) / m) for share in SHARED]
    doubtful = np.ones(len(x))
    out: dict = {}
    for _ in range(2):
        solved = []
        for common, own in noise:
            cov = common + np.diag(own * doubtful + (doubtful - 1) * np.diag(common))
            solved.append((np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])))
        out = _grids(x, y, dbm, solved, misses, ranges, start, half, cells, rounds)
        loss = -5 * np.log10((out["x"] - x) ** 2 + (out["y"] - y) ** 2 + HEIGHT_M**2)
        z = (dbm - out["p0"] - out["exponent"] * loss) / np.sqrt(out["scale"] * SIGMA_DB**2 * (0.6 + 0.4 / m))
        if (np.abs(z) <= 2.5).all():
            break
        doubtful = np.maximum(1.0, (z / 2.5) ** 2)
    return out


def _grids(x, y, dbm, solved, misses, ranges, start, half, cells, rounds) -> dict:
    (gx0, gy0), step = start, 2 * half / cells
    scales = np.array(SCALES)
    prior = -(DOUBT / 2) * np.log(scales) - (DOUBT - 2) / (2 * scales)
    for k in range(rounds):
        axis = (np.arange(cells) - (cells - 1) / 2) * step
        gx, gy = np.repeat(gx0 + axis, cells), np.tile(gy0 + axis, cells)
        square = (gx[:, None] - x) ** 2 + (gy[:, None] - y) ** 2
        loss = -5 * np.log10(square + HEIGHT_M**2)
        score, levels, exponents = [], [], []
        for a, logdet in solved:
            la, ad = loss @ a, a @ dbm
            one, oo, ll = la.sum(1), float(a.sum()), (la * loss).sum(1)
            od, ld, dd = float(ad.sum()), loss @ ad, float(dbm @ ad)
            for s, p in zip(scales, prior, strict=True):
                n00, n01, n11 = oo / s + LEVEL_PRIOR[1] ** -2, one / s, ll / s + EXPONENT_PRIOR[1] ** -2
                u, v = od / s + LEVEL_PRIOR[0] / LEVEL_PRIOR[1] ** 2, ld / s + EXPONENT_PRIOR[0] / EXPONENT_PRIOR[1] ** 2
                det = n00 * n11 - n01 * n01
                levels.append((n11 * u - n01 * v) / det)
                exponents.append((n00 * v - n01 * u) / det)
                gained = levels[-1] * u + exponents[-1] * v
                score.append(p - (dd / s - gained) / 2 - np.log(det) / 2 - len(x) / 2 * np.log(s) - logdet / 2)
        score, levels, exponents = np.array(score), np.array(levels), np.array(exponents)
        score -= np.sqrt(square.min(1)) / BEYOND_M
        if ranges is not None and len(ranges[0]):
            rx, ry, metres, precision = ranges
            far = np.sqrt((gx[:, None] - rx) ** 2 + (gy[:, None] - ry) ** 2 + HEIGHT_M**2)
            score -= ((metres - far) ** 2 * precision).sum(1) / 2
        weight = np.exp(score - score.max())
        if misses is not None and len(misses[0]):
            qx, qy, _, times = misses
            own = weight.sum(0) + 1e-300
            level, exponent = (weight * levels).sum(0) / own, (weight * exponents).sum(0) / own
            there = level[:, None] - 5 * exponent[:, None] * np.log10((gx[:, None] - qx) ** 2 + (gy[:, None] - qy) ** 2 + HEIGHT_M**2)
            silent = np.log(np.maximum(1e-12, 1 - (1 - DEAF) * _normal((there - SENSITIVITY_DBM) / SIGMA_DB)))
            score = score + (np.minimum(times, 3.0) * silent).sum(1)
            weight = np.exp(score - score.max())
        weight /= weight.sum()
        p = weight.sum(0)
        mx, my = float(p @ gx), float(p @ gy)
        xx, xy, yy = float(p @ (gx - mx) ** 2), float(p @ ((gx - mx) * (gy - my))), float(p @ (gy - my) ** 2)
        if k + 1 < rounds:
            gx0, gy0, step = mx, my, max(8 * np.sqrt(max(xx, yy)), 10.0) / cells
    far = np.hypot(gx - mx, gy - my)
    order = np.argsort(far)
    r95 = far[order][min(int(np.searchsorted(np.cumsum(p[order]), 0.95)), len(far) - 1)]
    scale = float(weight.sum(1).reshape(len(solved), -1).sum(0) @ scales)
    return {"x": mx, "y": my, "xx": xx, "xy": xy, "yy": yy, "step": step, "r95": float(r95), "p0": float((weight * levels).sum()), "exponent": float((weight * exponents).sum()), "scale": scale}


def range_fix(heard: DataFrame, keys: list[str], rounds: int = 6, huber: float = 2.0, least: int = 3, floor_acc: float = 15.0) -> DataFrame:
    """(keys, n, lat, lon, acc): a receiver's place from anchors lat, lon with ``metres`` to each and the error ``sd`` of that.

    Gauss-Newton with Huber weights from the weighted centroid. All rounds are window sums over the same partitioning: one shuffle.
    """
    own = Window.partitionBy(*keys)
    total = lambda c: F.sum(c).over(own)
    w0 = 1 / (F.col("metres") * F.col("metres") + 1)
    h = heard.withColumns({"lat0": total(w0 * F.col("lat")) / total(w0), "lon0": total(w0 * F.col("lon")) / total(w0), "n": F.count("*").over(own)}).where(F.col("n") >= least)
    x, y = local_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    h = h.withColumns({"x": x, "y": y, "px": F.lit(0.0), "py": F.lit(0.0)})
    for _ in range(rounds):
        dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
        d = F.sqrt(dx * dx + dy * dy + 1.0)
        r = (F.col("metres") - d) / F.col("sd")
        h = h.withColumns({"ux": dx / d, "uy": dy / d, "r": F.col("metres") - d, "w": F.when(F.abs(r) <= huber, 1.0).otherwise(huber / F.abs(r)) / (F.col("sd") * F.col("sd"))})
        w, ux, uy = F.col("w"), F.col("ux"), F.col("uy")
        h = h.withColumns({"a": total(w * ux * ux) + 1e-6, "b": total(w * ux * uy), "c": total(w * uy * uy) + 1e-6, "gx": total(w * ux * F.col("r")), "gy": total(w * uy * F.col("r"))})
        det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
        step_x, step_y = (F.col("c") * F.col("gx") - F.col("b") * F.col("gy")) / det, (F.col("a") * F.col("gy") - F.col("b") * F.col("gx")) / det
        scale = F.least(F.lit(1.0), 200 / F.greatest(F.sqrt(step_x * step_x + step_y * step_y), F.lit(1e-9)))
        h = h.withColumns({"px": F.col("px") + step_x * scale, "py": F.col("py") + step_y * scale})
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    acc = F.greatest(F.lit(floor_acc), F.sqrt((F.col("a") + F.col("c")) / det))
    lat, lon = F.col("lat0") + F.col("py") / DEGREE, F.col("lon0") + F.col("px") / (DEGREE * F.cos(F.radians("lat0")))
    return h.groupBy(*keys, "n").agg(F.first(lat).alias("lat"), F.first(lon).alias("lon"), F.first(acc).alias("acc"))


def trilaterated(heard: DataFrame, prior: DataFrame, keys: list[str], rounds: int = 8) -> DataFrame:
    """(keys, n, lat, lon, acc): least squares of ranges ``metres`` (error ``sd``) to anchors lat, lon, drawn to a prior p_lat, p_lon (error p_sd).

    Gauss-Newton from the prior; all rounds are window sums over one partitioning. ``acc`` is the root of the covariance's trace.
    """
    own = Window.partitionBy(*keys)
    total = lambda c: F.sum(c).over(own)
    x, y = local_xy(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    h = heard.join(prior, keys).withColumns({"x": x, "y": y, "px": F.lit(0.0), "py": F.lit(0.0), "n": F.count("*").over(own), "w": 1 / (F.col("sd") * F.col("sd")), "w0": 1 / (F.col("p_sd") * F.col("p_sd"))})
    w, w0 = F.col("w"), F.col("w0")
    for _ in range(rounds):
        dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
        d = F.sqrt(dx * dx + dy * dy + 1e-6)
        h = h.withColumns({"ux": dx / d, "uy": dy / d, "r": F.col("metres") - d})
        ux, uy, r = F.col("ux"), F.col("uy"), F.col("r")
        h = h.withColumns({"a": total(w * ux * ux) + w0, "b": total(w * ux * uy), "c": total(w * uy * uy) + w0, "gx": total(w * ux * r) - w0 * F.col("px"), "gy": total(w * uy * r) - w0 * F.col("py")})
        det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
        h = h.withColumns({"px": F.col("px") + (F.col("c") * F.col("gx") - F.col("b") * F.col("gy")) / det, "py": F.col("py") + (F.col("a") * F.col("gy") - F.col("b") * F.col("gx")) / det})
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    lat, lon = F.col("p_lat") + F.col("py") / DEGREE, F.col("p_lon") + F.col("px") / (DEGREE * F.cos(F.radians("p_lat")))
    return h.groupBy(*keys, "n").agg(F.first(lat).alias("lat"), F.first(lon).alias("lon"), F.first(F.sqrt((F.col("a") + F.col("c")) / det)).alias("acc"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
