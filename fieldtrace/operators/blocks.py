"""Folds over all points near an asset, by blocks: what each asset needs of its points is worked out without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import _EARTH, _grid, _half_chord2

#: Rows of a block, and pairs that are worked on at once.
BLOCK, PAIRS = 2048, 1 << 19

#: ``fold(points, assets, chords, limit)``: columns of some points and assets, and the haversines of their arcs with an asset a row.
Fold = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray, float], dict[str, np.ndarray]]


def _dealt(rows: DataFrame, ident: str, into: str) -> DataFrame:
    """``rows`` with the number of their block in their cell, so that a block has about ``BLOCK`` rows whatever the cell has."""
    parts = rows.groupBy("__y", "__x").agg(F.ceil(F.count("*") / BLOCK).alias("__parts"))
    return rows.join(parts, ["__y", "__x"]).withColumn(into, F.pmod(F.xxhash64(ident), F.col("__parts")))


def _chords(lat: np.ndarray, lon: np.ndarray, a_lat: np.ndarray, a_lon: np.ndarray) -> np.ndarray:
    """Haversines of the arcs from each asset (a row) to each point. Where all are within a thousandth of half a turn, the sines are taken as their angles: off by less than 4e-7 of them."""
    y = (lat[None, :] - a_lat[:, None]) * 0.5
    x = (lon[None, :] - a_lon[:, None]) * 0.5
    if max(np.abs(y).max(), np.abs(x).max()) > 1e-3:
        y, x = np.sin(y), np.sin(x)
    np.multiply(y, y, out=y)
    np.multiply(x, x, out=x)
    x *= np.cos(a_lat)[:, None]
    x *= np.cos(lat)[None, :]
    return np.add(y, x, out=y)


def exact_metres(lat: np.ndarray, lon: np.ndarray, a_lat: np.ndarray, a_lon: np.ndarray) -> np.ndarray:
    """``geo.haversine`` of pairs, in radians."""
    s, t = np.sin((a_lat - lat) / 2), np.sin((a_lon - lon) / 2)
    return 2 * _EARTH * np.arcsin(np.minimum(1.0, np.sqrt(s * s + np.cos(lat) * np.cos(a_lat) * t * t)))


def folded(points: DataFrame, assets: DataFrame, metres: float, fold: Fold, schema: str, point_id: str, asset_id: str) -> DataFrame:
    """What ``fold`` gives of each block of points and each block of assets that may be within ``metres`` of each other.

    ``points`` and ``assets`` have numbers only, among them lat and lon (degrees). Rows meet as blocks of their cells, so that pairs are no rows, memory follows the block and
    a busy cell is dealt out. An asset's rows of several blocks are left to the caller to sum up. ``fold`` gets lat and lon in radians.
    """
    of_points, of_assets = _grid(metres, 1_000_000_000, "lat", "lon")
    limit, kinds = _half_chord2(metres), dict(points.dtypes) | dict(assets.dtypes)
    known = lambda df: df.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    p_names, a_names = points.columns, assets.columns
    p, a = _dealt(of_points(known(points)), point_id, "__p"), _dealt(of_assets(known(assets)), asset_id, "__a")
    p = p.groupBy("__y", "__x", "__p").agg(F.collect_list(F.struct(*p_names)).alias("p"))
    a_struct = [F.col(f"a_{c}").alias(c) if c in ("lat", "lon") else F.col(c) for c in a_names]
    a = a.groupBy("__y", "__x", "__a").agg(F.collect_list(F.struct(*a_struct)).alias("a"))
    many = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = p.join(a.hint("shuffle_hash"), ["__y", "__x"]).select("p", "a").repartition(many)

    def columns(lists: pa.ListScalar, names: list[str]) -> dict[str, np.ndarray]:
        rows = lists.values
        out = {c: rows.field(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
        return out | {c: np.radians(out[c]) for c in ("lat", "lon")}

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                these, those = columns(batch["p"][i], p_names), columns(batch["a"][i], a_names)
                # longitudes go round: all are taken from that of the first asset
                turn = lambda x, at=those["lon"][0]: at + (x - at + np.pi) % (2 * np.pi) - np.pi
                if np.abs(these["lon"] - those["lon"][0]).max() > 1 or np.abs(those["lon"] - those["lon"][0]).max() > 1:
                    these["lon"], those["lon"] = turn(these["lon"]), turn(those["lon"])
                step = max(1, PAIRS // len(these["lat"]))
                for k in range(0, len(those["lat"]), step):
                    some = {c: v[k : k + step] for c, v in those.items()}
                    made = fold(these, some, _chords(these["lat"], these["lon"], some["lat"], some["lon"]), limit)
                    if len(next(iter(made.values()))):
                        yield pa.RecordBatch.from_pydict(made)

    assert kinds["lat"] == kinds["lon"] == "double"
    return met.mapInArrow(over, schema)


def counted(points: DataFrame, assets: DataFrame, metres: float, point_id: str, asset_id: str) -> DataFrame:
    """(asset_id, n, closest): how many points are within ``metres`` of each asset, and the distance of the nearest; assets without any are left out."""

    def fold(p, a, h, limit):
        near = h <= limit * (1 - 1e-6)
        n = np.count_nonzero(near, axis=1)
        # what is within 1e-6 of the edge is worked out exactly
        i, j = np.nonzero((h <= limit * (1 + 1e-6)) & ~near)
        sure = exact_metres(p["lat"][j], p["lon"][j], a["lat"][i], a["lon"][i]) <= metres
        n += np.bincount(i[sure], minlength=len(n))
        first = h.argmin(axis=1)
        far = exact_metres(p["lat"][first], p["lon"][first], a["lat"], a["lon"])
        some = n > 0
        return {asset_id: a[asset_id][some], "n": n[some], "closest": far[some]}

    kind = dict(assets.dtypes)[asset_id]
    parts = folded(points.select(point_id, "lat", "lon"), assets.select(asset_id, "lat", "lon"), metres, fold, f"{asset_id} {kind}, n long, closest double", point_id, asset_id)
    return parts.groupBy(asset_id).agg(F.sum("n").alias("n"), F.min("closest").alias("closest"))


def best_near(points: DataFrame, assets: DataFrame, metres: float, rank: str, point_id: str, asset_id: str) -> DataFrame:
    """(asset_id, rank, __mm, point_id): the point of the highest ``rank`` of those no farther than ``metres``, as rounded to a millimetre; then the nearest so rounded, then the least id."""
    edge = _half_chord2(metres + 0.0005)

    def rounded(p, a, i, j):
        return np.floor(exact_metres(p["lat"][j], p["lon"][j], a["lat"][i], a["lon"][i]) * 1000.0 + 0.5).astype(np.int64)

    def fold(p, a, h, _):
        # what is surely near, and what is at the edge by its own millimetres; then those of the best rank that can have the least distance when rounded
        value = np.where(h <= edge * (1 - 1e-6), p[rank][None, :].astype(np.float64), -np.inf)
        i, j = np.nonzero((h > edge * (1 - 1e-6)) & (h <= edge * (1 + 1e-6)))
        sure = rounded(p, a, i, j) <= round(metres * 1000)
        value[i[sure], j[sure]] = p[rank][j[sure]]
        top = value.max(axis=1)
        held = np.where((value == top[:, None]) & (top > -np.inf)[:, None], h, np.inf)
        least = 2 * _EARTH * np.sqrt(held.min(axis=1, initial=np.inf))
        as_near = ((least * (1 + 1e-6) + 0.002) / (2 * _EARTH)) ** 2
        i, j = np.nonzero((held <= as_near[:, None]) & np.isfinite(held))
        return {asset_id: a[asset_id][i], rank: p[rank][j], "__mm": rounded(p, a, i, j), point_id: p[point_id][j]}

    kinds = dict(assets.dtypes) | dict(points.dtypes)
    schema = f"{asset_id} {kinds[asset_id]}, {rank} {kinds[rank]}, __mm long, {point_id} {kinds[point_id]}"
    parts = folded(points.where(F.col(rank).isNotNull()).select(point_id, rank, "lat", "lon"), assets.select(asset_id, "lat", "lon"), metres + 0.001, fold, schema, point_id, asset_id)
    return parts.groupBy(asset_id).agg(F.max_by(F.struct(rank, "__mm", point_id), F.struct(rank, -F.col("__mm"), -F.col(point_id))).alias("__b")).select(asset_id, "__b.*")
