"""Where a receiver is from what one scan hears, with a check of the transmitters' places; the radius of a probability; and the pace of measurements."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Metres of a degree, shadowing in dB, the exponent of the loss, levels at a metre from 5,925 MHz, from 4,900 MHz and below, and the farthest range.
DEGREE, SIGMA_DB, EXPONENT, LEVELS, FARTHEST_M = 111_320.0, 6.0, 2.4, (-48.0, -46.0, -40.0), 1500.0
#: Residuals beyond so many deviations count linearly; a place is far at so many metres or so many times the median from the start; the least accuracy; the normal quantile of 99 %.
HUBER, FAR_M, FAR_TIMES, LEAST_ACC, Z99 = 2.0, 300.0, 5.0, 15.0, 2.3263478740408408


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Of the standard normal distribution, to about 1e-15, by the error function of the standard library on the distinct values."""
    values, back = np.unique(np.asarray(z, float), return_inverse=True)
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in values.tolist()])[back].reshape(np.shape(z))


def _ratio_radius(ratio: np.ndarray, p: float) -> np.ndarray:
    """The radius for a major deviation of 1 and a minor one of ``ratio``, by bisection."""
    angle = (np.arange(256) + 0.5) * (2 * np.pi / 256)
    # inside r at an angle, with the density of that direction: 1 - exp(-r^2 q / 2), averaged with weights 1 / q
    q = np.cos(angle) ** 2 + (np.sin(angle) / ratio[:, None]) ** 2
    share = 1 / q
    share /= share.sum(1, keepdims=True)
    low, high = np.zeros(len(ratio)), np.full(len(ratio), 5.0)
    for _ in range(50):
        mid = (low + high) / 2
        less = (share * -np.expm1(-0.5 * mid[:, None] ** 2 * q)).sum(1) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def radius_for(s1: np.ndarray, s2: np.ndarray, p: float = 0.95) -> np.ndarray:
    """The radius around the mean that holds ``p`` of a normal distribution with deviations s1 and s2 of its axes: at most five of the larger.

    In polar form the distance in each direction has a closed distribution, so one mean over 256 directions is the probability; minor axes below a fiftieth of the major
    one count as that. Equal ratios are solved once.
    """
    major, minor = np.maximum(s1, s2), np.minimum(s1, s2)
    ratio = np.clip(minor / np.maximum(major, 1e-12), 0.02, 1.0)
    ratios, back = np.unique(ratio, return_inverse=True)
    return major * _ratio_radius(ratios, p)[back]


def with_radius(rows: DataFrame, s1: str, s2: str, p: float = 0.95, into: str = "radius") -> DataFrame:
    """Adds ``radius_for`` of two columns; null where one of them is null or negative."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (s1, s2))
            ok = (x >= 0) & (y >= 0)
            r = radius_for(np.where(ok, x, 1.0), np.where(ok, y, 1.0), p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, mask=~ok)], schema=out)

    kind = rows.withColumn(into, F.lit(0.0).cast("double")).schema
    kind[into].nullable = True
    out = to_arrow_schema(kind)
    return rows.mapInArrow(over, kind)


def _chi2_99(k: np.ndarray) -> np.ndarray:
    c = 2 / (9 * np.maximum(k, 1))
    return np.maximum(k, 1) * (1 - c + Z99 * np.sqrt(c)) ** 3


class _Scans:
    """Scans of at most K transmitters as arrays of S x K, all solved at once; ``on`` says which take part."""

    def __init__(self, x, y, metres, acc, weight, on) -> None:
        self.x, self.y, self.d, self.w, self.on = x, y, metres, weight, on
        slope = metres * math.log(10) * SIGMA_DB / (10 * EXPONENT)
        self.var = slope * slope + acc * acc

    def residuals(self, px, py):
        dx, dy = px[:, None] - self.x, py[:, None] - self.y
        r = np.maximum(1.0, np.hypot(dx, dy))
        return dx / r, dy / r, r - self.d

    def normal(self, px, py):
        """The loss, the matrix (a, b, c) and the gradient of the weighted rows, and the residuals and their weights."""
        jx, jy, res = self.residuals(px, py)
        z = np.abs(res) / np.sqrt(self.var)
        h = np.where(z <= HUBER, 1.0, HUBER / np.maximum(z, HUBER))
        w = np.where(self.on, self.w * h / self.var, 0.0)
        loss = np.where(self.on, self.w * np.where(z <= HUBER, z * z, 2 * HUBER * z - HUBER * HUBER), 0.0).sum(1)
        return loss, (w * jx * jx).sum(1), (w * jx * jy).sum(1), (w * jy * jy).sum(1), (w * jx * res).sum(1), (w * jy * res).sum(1), res, w, h

    def solve(self, px, py, todo, rounds: int = 40):
        """Damped Gauss-Newton from (px, py) of the scans ``todo``: a scan's damping goes down when a step helps and up when it doesn't."""
        damp, busy = np.full(len(px), 1e-2), todo.copy()
        loss, a, b, c, gx, gy, *_ = self.normal(px, py)
        for _ in range(rounds):
            if not busy.any():
                break
            det = a * c * (1 + damp) ** 2 - b * b
            busy &= np.abs(det) >= 1e-18
            safe = np.where(np.abs(det) < 1e-18, 1.0, det)
            sx, sy = (b * gy - c * (1 + damp) * gx) / safe, (b * gx - a * (1 + damp) * gy) / safe
            tx, ty = np.where(busy, px + sx, px), np.where(busy, py + sy, py)
            tried = self.normal(tx, ty)
            good = busy & (tried[0] <= loss)
            px, py = np.where(good, tx, px), np.where(good, ty, py)
            loss, a, b, c, gx, gy = (np.where(good, n, o) for n, o in zip(tried[:6], (loss, a, b, c, gx, gy), strict=True))
            damp = np.where(good, np.maximum(1e-6, damp / 3), damp * 8)
            busy &= np.where(good, np.hypot(sx, sy) >= 0.2, damp <= 1e6)
        return px, py


def solve_scans(lat, lon, acc, dbm, mhz, weight, held) -> dict[str, np.ndarray]:
    """The places of S scans from arrays of S x K (``held``: which cells are filled); the columns of ``self_locations`` as arrays, ``on`` with them."""
    n = held.sum(1)
    lat0, lon0 = lat[:, :1], lon[:, :1]
    east = DEGREE * np.cos(np.radians(lat0))
    x, y = np.where(held, (lon - lon0) * east, 0.0), np.where(held, (lat - lat0) * DEGREE, 0.0)
    level = np.select([mhz >= 5925, mhz >= 4900], LEVELS[:2], LEVELS[2])
    metres = np.clip(10 ** ((level - dbm) / (10 * EXPONENT)), 1.0, FARTHEST_M)
    s = _Scans(x, y, metres, np.maximum(1.0, acc), np.maximum(0.05, weight), held.copy())

    many = n >= 4
    loud = np.where(held, 10 ** (dbm / 20) / np.maximum(10.0, acc), 0.0)
    with np.errstate(invalid="ignore"):
        mean = [(loud * v).sum(1) / np.maximum(loud.sum(1), 1e-300) for v in (x, y)]
        mid = [np.nanmedian(np.where(held, v, np.nan), axis=1) for v in (x, y)]
    x0, y0 = (np.where(many, m, c) for m, c in zip(mid, mean, strict=True))
    away = np.where(held, np.hypot(x - x0[:, None], y - y0[:, None]), np.inf)
    spread = np.sort(away, axis=1)[np.arange(len(n)), np.minimum(n // 2, np.maximum(n - 1, 0))]
    far = held & many[:, None] & (away > np.maximum(FAR_M, FAR_TIMES * spread)[:, None] + np.maximum(1.0, acc))
    s.on &= ~(far & (np.cumsum(far, axis=1) <= (n - 3)[:, None]))

    px, py = s.solve(x0, y0, s.on.sum(1) >= 3)
    state = np.where(many, np.where(s.on.sum(1) < n, "repaired", "ok"), "unverified").astype("U10")
    left = many.copy()
    for k in range(3):
        z = np.where(s.on, np.abs(s.residuals(px, py)[2]) / np.sqrt(s.var), 0.0)
        active = s.on.sum(1)
        bad = left & (active >= 4) & ((z * z).sum(1) > _chi2_99(active - 2))
        if k:
            state[left & ~bad] = np.where(active[left & ~bad] >= 4, "repaired", "unverified")
        left = bad
        if k == 2:
            state[bad] = "failed"
            break
        s.on[np.flatnonzero(bad), z.argmax(1)[bad]] = False
        rx, ry = s.solve(x0, y0, bad)
        px, py = np.where(bad, rx, px), np.where(bad, ry, py)

    _, a, b, c, _, _, res, w, h = s.normal(px, py)
    used = s.on.sum(1)
    square = (w * res * res).sum(1)
    rms, scale, det = np.sqrt(square / np.maximum(1e-12, w.sum(1))), np.maximum(1.0, square / np.maximum(1, used - 2)), a * c - b * b
    fits = (used >= 3) & (np.abs(det) >= 1e-12)
    safe = np.where(fits, det, 1.0)
    xx, yy, xy = c / safe * scale, a / safe * scale, -b / safe * scale
    half = np.sqrt(np.maximum(0.0, ((xx - yy) / 2) ** 2 + xy * xy))
    big, small = np.sqrt(np.maximum(0.0, (xx + yy) / 2 + half)), np.sqrt(np.maximum(0.0, (xx + yy) / 2 - half))
    big, small = np.where(fits, big, 1.0), np.where(fits, small, 1.0)
    single = np.sqrt(np.where(s.on, s.var, 0.0).max(1))
    wide = np.where(fits, big, single)
    out_acc = np.maximum(LEAST_ACC, np.maximum(wide, rms * 0.7))
    r95 = np.maximum(out_acc * 2.45, np.where(fits, radius_for(big, small), 2.45 * single))
    rejected = (s.on & (h < 0.5)).sum(1)
    return {"lat": lat0[:, 0] + py / DEGREE, "lon": lon0[:, 0] + px / east[:, 0], "acc": out_acc, "r95": r95, "rms": rms, "used": used - rejected, "rejected": rejected + n - used, "integrity": state, "on": s.on}


def self_locations(heard: DataFrame, key: str) -> DataFrame:
    """(key, lat, lon, acc, r95, rms, used, rejected, integrity, excluded) of each scan with two transmitters or more whose places are known.

    ``heard``: key, id, lat, lon, acc (of the transmitter's place), dbm, mhz, weight. Levels give ranges by the band's model; the start is the median place of four or more, else the mean
    weighted by level; places far beyond the others are left out first, and then up to two that disagree most while the residuals fail a chi-squared test of 99 % (``integrity``: ok,
    repaired, failed, or unverified with fewer than four). ``excluded`` holds the ids that were left out, in order. Rows without a place or a level don't count; a scan is what one receiver hears at once, some tens or
    hundreds of rows, and all scans of a batch are solved together, by classes of their sizes.
    """
    numbers = ["lat", "lon", "acc", "dbm", "mhz", "weight"]
    known = heard.where("lat is not null and lon is not null and dbm is not null").select(
        key, "id", *(F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in zip(numbers, (0.0, 0.0, 1.0, 0.0, 0.0, 1.0), strict=True))
    )
    scans = known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", *numbers))).alias("rows")).where(F.size("rows") >= 2)
    kind, ids = dict(heard.dtypes)[key], dict(heard.dtypes)["id"]
    out = f"{key} {kind}, lat double, lon double, acc double, r95 double, rms double, used long, rejected long, integrity string, excluded array<{ids}>"
    arrow = to_arrow_schema(heard.sparkSession.createDataFrame([], out).schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("rows")
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
            ends = np.cumsum(sizes)
            values, names = [flat.field(c).to_numpy(zero_copy_only=False) for c in numbers], flat.field("id").to_pylist()
            classes = np.ceil(np.log2(sizes))
            for size in np.unique(classes):
                own = np.flatnonzero(classes == size)
                width = int(sizes[own].max())
                cell = (ends - sizes)[own, None] + np.arange(width)
                held = np.arange(width) < sizes[own, None]
                r = solve_scans(*(v[np.where(held, cell, cell[:, :1])] for v in values), held)
                gone = [[names[c] for c in row[h & ~on]] for row, h, on in zip(cell, held, r["on"], strict=True)]
                columns = [b.column(key).take(pa.array(own)), *(pa.array(r[c]) for c in ("lat", "lon", "acc", "r95", "rms", "used", "rejected")), pa.array(r["integrity"].tolist()), pa.array(gone, arrow.field("excluded").type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return scans.mapInArrow(over, out)


#: When bursts slow down and how far apart they are then; how far the distance may go from its reference; the change of level that counts, over how long and of how many samples.
STEADY_MS, SLOW_MS, HOLD_M, HOLD_SHARE, JUMP_DB, LEVEL_MS, LEVEL_LEAST = 120_000, 30_000, 0.5, 0.2, 6.0, 10_000, 5


def paced(ticks: DataFrame, key: str) -> DataFrame:
    """(key, t_ms, burst, slow, reason) of each tick: whether a range is measured now, whether the pace is slow, and what began the steady time anew, if anything did.

    ``ticks``: key, t_ms, metres (null: no estimate), moving, peer_moving, dbm (array of levels heard in the tick, or null). While the distance holds within half a metre or a fifth, nothing moves and the
    median level of the last ten seconds stays within 6 dB, for two minutes, a burst is due each half a minute, else at each tick. A key's ticks pass through one
    task in order, with ten seconds of levels as state, kept in order so that their median needs no sort; ticks of one time go by their distance, then by the other columns.
    """

    kind = dict(ticks.dtypes)[key]
    schema = ticks.sparkSession.createDataFrame([], f"{key} {kind}, t_ms long, burst boolean, slow boolean, reason string").schema
    arrow = to_arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, begun = None, False
        since = distance = level = burst = None
        heard: deque[tuple[int, list]] = deque()
        held: list[int] = []  # the levels of ``heard`` in order
        for b in batches:
            keys, times, ranges, moves, peers, levels = (b.column(c).to_pylist() for c in columns)
            bursts, paces, reasons = [], [], []
            for k, now, metres, moving, peer, new in zip(keys, times, ranges, moves, peers, levels, strict=True):
                if k != session or not begun:
                    session, begun = k, True
                    since = distance = level = burst = None
                    heard.clear()
                    held.clear()
                if new:
                    heard.append((now, new))
                    for v in new:
                        insort(held, v)
                while heard and now - heard[0][0] > LEVEL_MS:
                    for v in heard.popleft()[1]:
                        del held[bisect_left(held, v)]
                n = len(held)
                own = (held[n // 2] + held[(n - 1) // 2]) / 2 if n >= LEVEL_LEAST else None
                if moving:
                    reason = "moving"
                elif peer:
                    reason = "peer moving"
                elif metres is None:
                    reason = "no estimate"
                elif distance is not None and abs(metres - distance) > max(HOLD_M, HOLD_SHARE * distance):
                    reason = "distance"
                elif level is not None and own is not None and abs(own - level) > JUMP_DB:
                    reason = "level"
                else:
                    reason = None
                if reason:
                    since, distance, level = (None if metres is None else now), metres, own
                else:
                    if since is None:
                        since, distance = now, metres
                    if level is None:
                        level = own
                slow = since is not None and now - since >= STEADY_MS
                due = not slow or burst is None or now - burst >= SLOW_MS
                if due:
                    burst = now
                bursts.append(due)
                paces.append(slow)
                reasons.append(reason)
            out = [b.column(key), b.column("t_ms"), pa.array(bursts, pa.bool_()), pa.array(paces, pa.bool_()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    columns = [key, "t_ms", "metres", "moving", "peer_moving", "dbm"]
    return ticks.select(columns).repartition(key).sortWithinPartitions(*columns).mapInArrow(over, schema)
