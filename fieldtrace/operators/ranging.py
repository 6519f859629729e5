"""Where one device is relative to another, from differences of levels and from ranges; and how honest fits are, by anchors that are surveyed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Deviations in dB of a device's gain and of shadowing, and metres over which two places stop sharing it.
GAIN_DB, SHADOW_DB, APART_M = 2.0, 4.0, 8.0
#: Transmitters nearer than this tell no direction; so many are needed, seen over so many degrees.
NEAREST_M, LEAST, SPREAD_DEG = 1.0, 3, 60.0


def offset_fit(east: np.ndarray, north: np.ndarray, delta: np.ndarray, exponent: np.ndarray, sigma: np.ndarray, sigma_pos: np.ndarray) -> dict | None:
    """Offset and gain of a second device from the level differences to a first one at the origin, of transmitters at east, north; None if they don't tell.

    A transmitter at a metres from the first and b from the second differs by gain - 10 n log10(b / a). Gauss-Newton with a little damping; a pair's variance grows
    with the distance of the devices, as their shadowing is shared the less, and with the error of the transmitter's place.
    """
    near = np.hypot(east, north)
    keep = near >= NEAREST_M
    east, north, delta, exponent, sigma, sigma_pos, near = (v[keep] for v in (east, north, delta, exponent, sigma, sigma_pos, near))
    bearing = np.sort(np.degrees(np.arctan2(east, north)) % 360)
    spread = 360 - np.diff(bearing, append=bearing[:1] + 360).max() if len(bearing) > 1 else 0.0
    if len(east) < LEAST or spread < SPREAD_DEG:
        return None

    def normal(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        dx, dy = at[0] - east, at[1] - north
        far = np.maximum(0.5, np.hypot(dx, dy))
        slope = 10 * exponent / np.log(10)
        rest = delta - (at[2] - 10 * exponent * np.log10(far / near))
        jac = np.stack([-slope * dx / far**2, -slope * dy / far**2, np.ones(len(far))], axis=1)
        w = 1 / (sigma**2 + GAIN_DB**2 + 2 * SHADOW_DB**2 * (1 - np.exp(-np.hypot(at[0], at[1]) / APART_M)) + (slope / far * sigma_pos) ** 2)
        return (jac * w[:, None]).T @ jac, jac.T @ (w * rest), float(w @ rest**2)

    at = np.array([0.0, 0.0, np.median(delta)])
    for _ in range(20):
        n, g, _chi = normal(at)
        step = np.linalg.lstsq(n + 1e-3 * np.diag(np.diag(n)), g, rcond=None)[0]
        at = at + step
        if np.abs(step).max() < 1e-6:
            break
    n, _, chi = normal(at)
    if np.linalg.cond(n) > 1e12:
        return None
    cov = np.linalg.inv(n) * (max(1.0, chi / (len(east) - 3)) if len(east) > 3 else 1.0)
    return {"east": float(at[0]), "north": float(at[1]), "gain": float(at[2]), "cee": float(cov[0, 0]), "cen": float(cov[0, 1]), "cnn": float(cov[1, 1]), "used": len(east), "spread": float(spread), "chi2": chi}


def relative_posterior(log_range: tuple[float, float] | None, gauss: list[tuple[float, float, float, float, float]], rings: int = 64, turns: int = 180) -> dict | None:
    """Distance (16, 50 and 84 %) and bearing of a device, over a grid of log-distances and bearings; None without evidence.

    ``log_range`` is the mean and variance of the decimal logarithm of the distance; ``gauss`` are places (east, north, cee, cen, cnn). The bearing is given if the
    directions agree: if the length of their mean is a half or more.
    """
    gauss = [g for g in gauss if g[2] * g[4] - g[3] ** 2 > 0]
    if log_range is None and not gauss:
        return None
    if log_range:
        low, high = log_range[0] - 4 * log_range[1] ** 0.5, log_range[0] + 4 * log_range[1] ** 0.5
    else:
        low, high = np.log10(0.05), np.log10(max([200.0, *(np.hypot(e, n) + 4 * max(a, c) ** 0.5 for e, n, a, _, c in gauss)]))
    low, high = max(low, -2.0), min(high, np.log10(20_000.0))
    turn = np.arange(turns) * 2 * np.pi / turns
    for _ in range(2):  # again over the distances that have any weight, so that a sharp place is not between two rings
        u = np.linspace(low, max(high, low + 1e-3), rings)
        r = 10**u
        score = np.repeat((-((u - log_range[0]) ** 2) / (2 * log_range[1]) if log_range else 2 * np.log(r))[:, None], turns, axis=1)
        e, n = r[:, None] * np.sin(turn), r[:, None] * np.cos(turn)
        for me, mn, a, b, c in gauss:
            score -= (c * (e - me) ** 2 - 2 * b * (e - me) * (n - mn) + a * (n - mn) ** 2) / (2 * (a * c - b * b))
        w = np.exp(score - score.max())
        w /= w.sum()
        ring = w.sum(1)
        some = np.flatnonzero(ring > 1e-6)
        low, high = u[max(some[0] - 1, 0)], u[min(some[-1] + 1, rings - 1)]
    edge, step = np.concatenate([[0.0], np.cumsum(ring)]), u[1] - u[0]
    at = {q: 10 ** float(np.interp(q, edge, np.concatenate([[u[0] - step / 2], u + step / 2]))) for q in (0.16, 0.5, 0.84)}
    east, north = float((w * np.sin(turn)).sum()), float((w * np.cos(turn)).sum())
    length = float(np.hypot(east, north))
    bearing = float(np.degrees(np.arctan2(east, north)) % 360) if length >= 0.5 else None
    name = "adjacent" if at[0.84] <= 2 else "room" if at[0.84] <= 6 else "far" if at[0.16] > 30 else "near" if at[0.84] <= 30 else "unknown"
    return {"distance": at[0.5], "low": at[0.16], "high": at[0.84], "length": length, "bearing": bearing, "bearing_sd": float(np.degrees(np.sqrt(-2 * np.log(min(length, 1.0))))) if bearing is not None else None, "kind": name}


_RELATIVE = "east double, north double, gain double, used long, distance double, low double, high double, length double, bearing double, bearing_sd double, kind string"


def relative_places(pairs: DataFrame, keys: list[str], ranges: DataFrame | None = None) -> DataFrame:
    """(keys, offset and gain, distance and bearing) of device pairs.

    ``pairs`` have keys, east, north (of a transmitter from the first device), delta (level at the second less that at the first), exponent, sigma, sigma_pos; ``ranges`` have keys, log_m and var of a measured
    distance. A pair of devices is one group of at most as many rows as there are transmitters in earshot.
    """
    columns = ["east", "north", "delta", "exponent", "sigma", "sigma_pos"]
    rows = pairs.select(*keys, *columns, F.lit(None).cast("double").alias("log_m"), F.lit(None).cast("double").alias("var"))
    if ranges is not None:
        rows = rows.unionByName(ranges.select(*keys, "log_m", "var"), allowMissingColumns=True)
    kinds = dict(pairs.dtypes)
    names = [c.split()[0] for c in _RELATIVE.split(", ")]

    def over(table: pa.Table) -> pa.Table:
        a = {c: table[c].to_numpy() for c in (*columns, "log_m", "var")}
        own, ranged = ~np.isnan(a["delta"]), ~np.isnan(a["log_m"])
        fit = offset_fit(*(a[c][own] for c in columns))
        w = 1 / a["var"][ranged]
        measured = (float(w @ a["log_m"][ranged] / w.sum()), float(1 / w.sum())) if ranged.any() else None
        place = relative_posterior(measured, [(fit["east"], fit["north"], fit["cee"], fit["cen"], fit["cnn"])] if fit else [])
        found = {**(fit or {}), **(place or {})}
        types = {"used": pa.int64(), "kind": pa.string()}
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, **{c: pa.array([found.get(c)], types.get(c, pa.float64())) for c in names}})

    return rows.groupBy(*keys).applyInArrow(over, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _RELATIVE)


def anchor_calibration(fits: DataFrame, pins: DataFrame, key: str, least: int = 3) -> DataFrame:
    """One row (n, inside, coverage, mean_nees, kappa): how far the fits of surveyed transmitters, made without their pins, are off against what they claim.

    ``kappa`` multiplies deviations: the root of half the mean normalised squared error, kept within 0.5 to 5, or 1 below ``least`` anchors. All are sums over one join.
    """
    x, y = geo.frame_xy(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    both = fits.join(pins.select(key, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), key).withColumns({"x": x, "y": y})
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    nees = (F.col("cyy") * F.col("x") * F.col("x") - 2 * F.col("cxy") * F.col("x") * F.col("y") + F.col("cxx") * F.col("y") * F.col("y")) / det
    inside = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) <= F.col("r95")
    total = both.where(det > 0).agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.avg(nees).alias("mean_nees"))
    kappa = F.when(F.col("n") >= least, F.sqrt(F.greatest(F.lit(0.25), F.least(F.lit(25.0), F.col("mean_nees") / 2)))).otherwise(1.0)
    return total.select("n", "inside", (F.col("inside") / F.when(F.col("n") > 0, F.col("n"))).alias("coverage"), "mean_nees", kappa.alias("kappa"))
