"""Vantage spots, stops, sightings, segments of tracks, relative places, calibration by anchors, and the lock on a site."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locate, ranging, stops, vantage
from ..sources.views import _place, cams, observations, tracks, ways
from ..streaming import live, site
from .catalog import query
from .common import at
from .roads import _assets
from .streams import _events


@query()
def t27_vantage_spots(spark, d):
    """The best spots to look at each asset: along ways, out of everybody's view, ten metres apart."""
    assets = _assets(spark, d).withColumns({"half": F.lit(12.5), "most_m": F.lit(35.0)})
    s = vantage.vantage_spots(assets, ways(spark, d))
    return s.select("id", "spot", at(F.col("lat"), 7).alias("lat7"), at(F.col("lon"), 7).alias("lon7"), at(F.col("far")).alias("mm"), at(F.col("look"), 2).alias("look2"), "side", "highway", at(F.col("score")).alias("score3"))


def _sourced(spark, d):
    source = F.when(F.col("n") % 11 == 0, "ip").when(F.col("n") % 17 == 0, "gps-vehicle").when(F.col("n") % 23 < 4, "wifi").otherwise("gps")
    return tracks(spark, d).withColumn("source", source)


@query()
def t44_stop_log(spark, d):
    """Stops of each device: coarse fixes wait, a moved fix or another source begins a stop, and the one before it gets its departure."""
    s = stops.stop_log(_sourced(spark, d))
    return s.select("device", "arrived_ms", "departed_ms", at(F.col("lat"), 6).alias("lat6"), at(F.col("lon"), 6).alias("lon6"), "source", "n")


@query()
def t46_place_sightings(spark, d):
    """Where each transmitter was seen: refreshed, moved by better fixes, or new places, the newest 24."""
    s = stops.place_sightings(observations(spark, d))
    return s.select("bssid", "place", at(F.col("lat"), 6).alias("lat6"), at(F.col("lon"), 6).alias("lon6"), "acc", "t_ms")


@query()
def t37_reference_anchors(spark, d):
    """Which anchors stay references: the newest within 100 m, then the next that is clear of those."""
    return stops.reference_anchors(cams(spark, d).select("id", (F.col("id") * 7919 % 1009).alias("placed_ms"), "lat", "lon"))


@query()
def t41_track_segments(spark, d):
    """Tracks in segments of rest, walk and drive, each drawn in its way."""
    s = stops.mode_segments(_sourced(spark, d))
    return s.select("device", "start_ms", "end_ms", "mode", "k", "t_ms", at(F.col("lat"), 7).alias("lat7"), at(F.col("lon"), 7).alias("lon7"))


@query()
def x16_still_fixes(spark, d):
    """Fixes at rest held at their anchor, or rejected."""
    t = tracks(spark, d).withColumns({"still": F.col("n") % 40 > 3, "stirred": F.col("n") % 9 == 0})
    s = stops.still_fixes(t)
    return s.select("device", "n", at(F.col("lat"), 7).alias("lat7"), at(F.col("lon"), 7).alias("lon7"), "state")


@query()
def t32_relative_places(spark, d):
    """Where each device is relative to the first one, day by day, from the levels at which both hear the same transmitters."""
    day = F.floor(F.col("t_ms") / 86_400_000)
    o = observations(spark, d).groupBy("device", day.alias("day"), "bssid").agg(F.avg("dbm").alias("dbm"), F.count("*").alias("n"))
    k = F.substring("bssid", 3, 9).cast("long")
    place = {"east": ((k * 37) % 81 - 40).cast("double"), "north": ((k * 53) % 81 - 40).cast("double")}
    first = o.where("device = 'dev0'").select("day", "bssid", F.col("dbm").alias("dbm0"))
    p = o.where("device <> 'dev0'").join(first, ["day", "bssid"]).withColumns(place)
    p = p.select("device", "day", "east", "north", (F.col("dbm") - F.col("dbm0")).alias("delta"), F.lit(2.6).alias("exponent"), F.lit(3.0).alias("sigma"), F.lit(2.0).alias("sigma_pos"))
    ranges = o.where("device <> 'dev0' and n % 2 = 0").groupBy("device", "day").agg((F.avg("n") / 10 + 0.7).alias("log_m"), F.lit(0.04).alias("var"))
    r = ranging.relative_places(p, ["device", "day"], ranges.join(p.select("device", "day").distinct(), ["device", "day"]))
    return r.select("device", "day", "used", *(at(F.col(c), 3).alias(f"{c}3") for c in ("east", "north", "gain", "distance", "low", "high", "length", "bearing")), "kind")


@query()
def t14_anchor_calibration(spark, d):
    """How far the fits of surveyed transmitters are off against what they claim."""
    k = F.substring("bssid", 3, 9).cast("long")
    fits = locate.level_fit(observations(spark, d), "bssid")
    pins = fits.select("bssid", _place(40.0, k, 7919, 10007).alias("lat"), _place(-75.0, k, 104729, 10009).alias("lon"))
    c = ranging.anchor_calibration(fits, pins, "bssid")
    return c.select("n", "inside", at(F.col("coverage"), 6).alias("coverage6"), at(F.col("mean_nees"), 3).alias("nees3"), at(F.col("kappa"), 6).alias("kappa6"))


@query()
def st05_site_lock(spark, d):
    """Whether each device is at its site, scan by scan, from the neighbourhood that it has learned there."""
    e = _events(spark, d)
    scan = F.floor(F.unix_micros("ts") / 1000 / 3_600_000) * 3_600_000
    heard = F.array(*(F.struct(F.concat(F.lit("N"), ((F.col("user_id") + k) % 6).cast("string")).alias("bssid"), (-50 - k * 3 - F.col("event_id") % 7).cast("double").alias("dbm")) for k in range(4)))
    s = e.select((F.col("user_id") % 16).alias("site"), scan.cast("long").alias("scan_ms"), F.timestamp_millis(scan.cast("long")).alias("ts"), (F.col("event_id") % 3 == 0).alias("placed"), F.explode(heard).alias("h")).select("ts", "site", "scan_ms", "h.bssid", "h.dbm", "placed")
    j = live.drained(site.site_lock(s))
    return j.select("site", "scan_ms", "on", "changed", "expected", "common", at(F.col("rms"), 3).alias("rms3"), "scans")
