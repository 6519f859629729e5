"""Roads and assets: the watched way, and the way that a pass was driven on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import passes as P
from ..operators import roads as R
from ..operators.graph import cut
from ..sources.views import cams, sql, tracks, ways
from .catalog import query
from .common import at, at_sql


def _assets(spark, d):
    """Every fourth asset has no direction, every fourth has two; every third one's layer isn't known."""
    dirs = F.when(F.col("id") % 4 == 0, F.array().cast("array<double>")).when(F.col("id") % 4 == 1, F.array(F.col("dir"), (F.col("dir") + 130) % 360).cast("array<double>")).otherwise(F.array("dir").cast("array<double>"))
    return cams(spark, d).select("id", "lat", "lon", dirs.alias("dirs"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3 - 1).cast("int")).alias("layer"))


def _frame(lat: str, lon: str) -> tuple[str, str]:
    return f"({lon} - a.lon) * cast({geo.ARC!r} as double) * cos(radians(a.lat))", f"({lat} - a.lat) * cast({geo.ARC!r} as double)"


_AX, _AY = _frame("l.lat", "l.lon")
_BX, _BY = _frame("l.lat2", "l.lon2")
_OFF = "(case when {d} > 180 then 360 - {d} else {d} end)".replace("{d}", "fmod(abs(bearing - x), 360)")
_AXIAL = f"(case when {_OFF} > 90 then 180 - {_OFF} else {_OFF} end)"


@query(
    sql(
        "tracks legs cams",
        f""", a as (select id, lat, lon, case when id % 4 = 0 then []::double[] when id % 4 = 1 then [cast(dir as double), cast((dir + 130) % 360 as double)] else [cast(dir as double)] end as dirs, case when id % 3 > 0 then id % 3 - 1 end as own from cams),
        f as (select a.id, a.dirs, a.own, way, highway, layer, oneway, k, {_AX} as ax, {_AY} as ay, {_BX} as bx, {_BY} as by_ from a, legs l),
        u as (select *, greatest(cast(0 as double), least(cast(1 as double), -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) as u from f),
        m as (select *, sqrt((ax + u * (bx - ax)) * (ax + u * (bx - ax)) + (ay + u * (by_ - ay)) * (ay + u * (by_ - ay))) as metres, fmod(degrees(atan2(bx - ax, by_ - ay)) + cast(360 as double), cast(360 as double)) as bearing from u),
        w as (select * from (select *, row_number() over (partition by id, way order by metres, k) as r from m where metres <= 40) where r = 1),
        c as (select *, len(list_filter(dirs, lambda x: {_AXIAL} <= 35)) > 0 as along, metres + case when highway = 'service' then 10 else 0 end as cost from w),
        k as (select *, case when along and layer = coalesce(own, 0) then 0 when along and own is null then 1 when layer = coalesce(own, 0) then 2 when own is null then 3 end as rank from c),
        b as (select *, row_number() over (partition by id order by rank, cost, way) as best from k where rank is not null)
        select a.id, way, {at_sql('metres')} as mm, {at_sql('bearing', 2)} as bearing2, layer, oneway, case when way is null then 'none' when len(a.dirs) = 0 then 'nearest' when rank < 2 then 'direction' else 'nearest_no_direction_match' end as basis from a left join b on b.id = a.id and best = 1""",
    )
)
def t07_watched_way(spark, d):
    """The way that each asset watches, and why: along its direction and on its layer first."""
    assets = _assets(spark, d)
    w = R.watched_ways(assets, R.asset_legs(assets, ways(spark, d)))
    return w.select("id", "way", at(F.col("metres")).alias("mm"), at(F.col("bearing"), 2).alias("bearing2"), "layer", "oneway", "basis")


@query()
def t08_matched_passes(spark, d):
    """What road each pass was on, by least-cost paths over the ways near it, and by how much that lowers the chance of a read."""
    assets, fixes, roads = _assets(spark, d), tracks(spark, d), ways(spark, d)
    found = P.passes_of(P.with_pass(P.near_legs(P.legs(fixes), assets)))
    near = cut(R.asset_legs(assets, roads))
    m = R.matched_passes(found, fixes, roads, near, R.watched_ways(assets, near))
    return m.select("device", "id", "pass", "status", "verdict", at(F.col("p_watched"), 6).alias("p6"), at(F.col("factor"), 6).alias("factor6"), "watched", "matched", at(F.col("offset_m")).alias("off_mm"), at(F.col("track_offset_m")).alias("track_mm"), "layers", "opposite", "n_samples", "n_candidates")
