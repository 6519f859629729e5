"""Where to stand to look at an asset: spots along ways or on rings around it that no asset has in view."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .graph import cut
from .joins import _grid, grid_join
from .roads import asset_legs

#: Ways that a walker may use beside roads, and those that count as made for walking; ways that no car takes.
WALKED = ("footway", "sidewalk", "path", "pedestrian", "steps", "cycleway", "track")
EASY = ("sidewalk", "footway", "path", "pedestrian", "parking")
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "road")
#: Metres between spots along a way, the preferred distances, metres between the spots that are given, and how many those are.
STEP_M, LEAST_M, MOST_M, PREFERRED_M, APART_M, SPOTS = 5.0, 20.0, 60.0, (25.0, 45.0), 10.0, 3
#: Rings that are tried where no way has a spot, and degrees between the spots of a ring.
RINGS_M, RING_DEG = (30.0, 40.0, 50.0), 15
#: An asset is taken to see so many degrees and metres more than its view says, and all of its pole's surroundings; nothing is seen from farther than the last number.
WIDER_DEG, FARTHER, FARTHER_M, POLE_M, FARTHEST_M = 15.0, 1.5, 10.0, 15.0, 125.0


def _accepted(highway: Column, walking: bool) -> Column:
    road = F.regexp_replace(highway, "_link$", "").isin(*ROADS)
    return highway.isNull() | road | (highway.isin(*WALKED) if walking else highway == "parking")


def side_score(bearing: Column, dirs: Column) -> Column:
    """(score, side) of the best side of an asset that a spot at ``bearing`` from it is on: behind, beside or in front of one of its directions."""

    def one(d: Column) -> Column:
        back, front = geo.angle_between(bearing, F.pmod(d + 180, F.lit(360.0))), geo.angle_between(bearing, d)
        score = F.when(back <= 90, back * 0.01).when(front > 90, 10 + (180 - front) * 0.01).otherwise(25 + front * 0.01)
        return F.struct(score.alias("score"), F.when(back <= 90, "behind").when(front > 90, "beside").otherwise("front").alias("side"))

    return F.coalesce(F.array_min(F.transform(dirs, one)), F.struct(F.lit(0.0).alias("score"), F.lit("any").alias("side")))


def _unseen(spots: DataFrame, watchers: DataFrame) -> DataFrame:
    """Spots that are in nobody's view: that of ``watchers`` with dirs, half and most_m, taken wider, and the surroundings of their poles.

    Where many assets stand, most spots are near a pole: one pole of each small cell settles those in the cell, then all poles near what is left, and only what is near none of them meets the views.
    """
    w = watchers.select(F.col("id").alias("w_id"), F.col("dirs").alias("w_dirs"), F.col("half").alias("w_half"), F.least(F.col("most_m") * FARTHER + FARTHER_M, F.lit(FARTHEST_M)).alias("w_m"), "lat", "lon")
    keys = ["id", "lat", "lon"]
    poles = w.select("w_id", "lat", "lon")
    fine, _ = _grid(POLE_M * 0.6, 1_000_000_000, "lat", "lon")
    one = fine(poles).groupBy("__y", "__x").agg(F.min(F.struct("lat", "lon")).alias("__pole"))
    far = F.coalesce(geo.haversine(F.col("lat"), F.col("lon"), F.col("__pole.lat"), F.col("__pole.lon")) > POLE_M, F.lit(True))
    left = cut(fine(spots).join(one, ["__y", "__x"], "left").where(far).select(spots.columns))
    left = cut(left.join(grid_join(left.select(keys), poles, POLE_M, per_degree=1_000_000).select(keys).distinct(), keys, "left_anti"))
    reach = w.agg(F.max("w_m")).first()[0] or POLE_M
    met = grid_join(left.select(keys), w, reach, per_degree=1_000_000).withColumn("__off", geo.bearing(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon")))
    seen = (F.col("metres") <= F.col("w_m")) & F.exists("w_dirs", lambda d: geo.angle_between(F.col("__off"), d) <= F.col("w_half") + WIDER_DEG)
    return left.join(met.where(seen).select(keys).distinct(), keys, "left_anti")


def _judged(spots: DataFrame, assets: DataFrame) -> DataFrame:
    a = assets.select("id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.col("dirs").alias("t_dirs"))
    far = geo.haversine(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("lon"))
    near = spots.join(a, "id").withColumn("far", far).where((F.col("far") >= LEAST_M) & (F.col("far") <= MOST_M))
    side = side_score(geo.bearing(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("lon")), F.col("t_dirs"))
    outside = F.greatest(F.lit(0.0), PREFERRED_M[0] - F.col("far"), F.col("far") - PREFERRED_M[1])
    way = F.when(F.col("highway") == "service", 10.0).when(F.col("highway").isin(*EASY), -5.0).otherwise(0.0)
    scored = near.withColumn("__side", side).withColumn("score", outside + F.col("__side.score") + way)
    return scored.select("id", "lat", "lon", "highway", "far", F.col("__side.side").alias("side"), "score", geo.bearing(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")).alias("look"))


def vantage_spots(assets: DataFrame, ways: DataFrame, walking: bool = True) -> DataFrame:
    """(id, spot, lat, lon, far, look, side, highway, score): the best spots to look at each asset, three at most and ten metres apart.

    ``assets`` have id, lat, lon, dirs, half and most_m; none of them may see a spot. Spots are every five metres along ways that the profile may use, or, for an asset without any, on rings
    around it. The least score is the best: metres outside the preferred distances, the side of the asset, and the kind of way; then the nearest, to a
    thousandth of a metre, then the southern and the western one. An asset's spots are those within sixty metres, so their list is bounded by the ways there.
    """
    legs = asset_legs(assets, ways, near_m=MOST_M, kept_m=MOST_M).where(_accepted(F.col("highway"), walking))
    many = F.greatest(F.lit(1), F.ceil(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / STEP_M)).cast("int")
    # only the part of a leg that is near enough is cut into spots: in the asset's frame a leg is straight, but for the poles
    own = legs.join(assets.select("id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), "id").withColumn("__many", many)
    (ax, ay), (bx, by) = (geo.frame_xy(F.col(y), F.col(x), F.col("t_lat"), F.col("t_lon")) for y, x in (("lat", "lon"), ("lat2", "lon2")))
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    own = own.withColumns({"__u": -(ax * dx + ay * dy) / (length * length), "__r": (MOST_M + 1) / length})
    part = lambda u: F.greatest(F.lit(0), F.least(F.col("__many"), u)).cast("int")
    low, high = part(F.floor((F.col("__u") - F.col("__r")) * F.col("__many"))), part(F.ceil((F.col("__u") + F.col("__r")) * F.col("__many")))
    whole_leg = (F.abs(F.col("t_lat")) > 89.0) | F.col("__u").isNull()
    along = own.withColumn("__k", F.explode(F.sequence(F.when(whole_leg, 0).otherwise(low), F.when(whole_leg, F.col("__many")).otherwise(high))))
    share = F.col("__k") / F.col("__many")
    spots = along.select("id", (F.col("lat") + share * (F.col("lat2") - F.col("lat"))).alias("lat"), (F.col("lon") + share * (F.col("lon2") - F.col("lon"))).alias("lon"), "highway")
    on_ways = cut(_judged(_unseen(spots, assets), assets))
    ring = F.explode(F.array(*(F.struct(F.lit(r * math.cos(math.radians(t)) / geo.ARC).alias("n"), F.lit(r * math.sin(math.radians(t)) / geo.ARC).alias("e")) for r in RINGS_M for t in range(0, 360, RING_DEG))))
    bare = assets.join(on_ways.select("id").distinct(), "id", "left_anti").withColumn("__r", ring)
    around = bare.select("id", (F.col("lat") + F.col("__r.n")).alias("lat"), (F.col("lon") + F.col("__r.e") / F.cos(F.radians("lat"))).alias("lon"), F.lit("ground").alias("highway"))
    every = on_ways.unionByName(_judged(_unseen(around, assets), assets))
    whole = lambda c: F.floor(c * 1000 + 0.5)
    one = F.struct(whole(F.col("score")).alias("rank"), whole(F.col("far")).alias("mm"), "lat", "lon", "highway", "far", "side", "score", "look")
    ranked = every.groupBy("id").agg(F.array_sort(F.collect_set(one)).alias("all"))
    apart = lambda s: lambda p: geo.haversine(p["lat"], p["lon"], s["lat"], s["lon"]) >= APART_M
    picked = F.aggregate("all", F.slice("all", 1, 0), lambda got, s: F.when((F.size(got) < SPOTS) & F.forall(got, apart(s)), F.concat(got, F.array(s))).otherwise(got))
    return ranked.select("id", F.posexplode(picked).alias("spot", "s")).select("id", (F.col("spot") + 1).alias("spot"), *(F.col(f"s.{c}").alias(c) for c in ("lat", "lon", "far", "look", "side", "highway", "score")))
