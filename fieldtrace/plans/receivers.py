"""Queries of a receiver's own place, of radii of a probability, and of the pace of measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import receiver
from ..sources.views import _place, observations, read
from .catalog import query
from .common import at


@query()
def x13_scan_location(spark, d):
    """Where each device is day by day, from the transmitters that it hears and their places, one in nine of which is wrong by far."""
    o = observations(spark, d).groupBy("device", F.floor(F.col("t_ms") / 86_400_000).alias("day"), "bssid").agg(F.max("dbm").alias("dbm"))
    k = F.substring("bssid", 3, 9).cast("long")
    place = {"lat": _place(40.0, k, 7919, 10007) + F.when(k % 9 == 0, 0.05).otherwise(0.0), "lon": _place(-75.0, k, 104729, 10009), "acc": (5 + k % 30).cast("double"), "mhz": F.when(k % 3 == 0, 5180).when(k % 7 == 0, 6105).otherwise(2437), "weight": (1 + k % 4) / 4}
    h = o.select(F.concat_ws(":", "device", "day").alias("scan"), F.col("bssid").alias("id"), "dbm", *(v.alias(c) for c, v in place.items()))
    r = receiver.self_locations(h, "scan")
    return r.select("scan", at(F.col("lat"), 6).alias("lat6"), at(F.col("lon"), 6).alias("lon6"), *(at(F.col(c), 2).alias(f"{c}2") for c in ("acc", "r95", "rms")), "used", "rejected", "integrity", F.array_join("excluded", ",").alias("excluded"))


@query()
def x17_burst_pace(spark, d):
    """Which ticks of a session measure a range: each while something changes, one in half a minute once nothing has for two minutes."""
    e = read(spark, d, "events")
    # a session of a user's day, a tick every ten seconds; most of a session holds still
    ticks = e.select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session"), (F.unix_millis(F.col("ts").cast("timestamp"))).alias("t0"), F.col("event_id").alias("k"), "value").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29))))
    near = F.when((F.col("k") + F.col("i")) % 97 == 0, None).otherwise(2.0 + F.col("value") % 3 + F.when((F.col("k") + F.col("i")) % 41 == 0, 4.0).otherwise(0.0))
    t = ticks.select("session", (F.col("t0") + F.col("i") * 10_000).alias("t_ms"), near.cast("double").alias("metres"), ((F.col("k") * 31 + F.col("i")) % 53 == 0).alias("moving"), ((F.col("k") * 17 + F.col("i")) % 83 == 0).alias("peer_moving"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: (-60 - (F.col("k") + j) % 5).cast("int")).alias("dbm"))
    return receiver.paced(t, "session")


@query()
def s37b_radius95(spark, d):
    """The radius that holds 95 % of a normal distribution with two deviations."""
    o = observations(spark, d).select("event_id", "acc", (F.col("acc") * (20 + F.col("event_id") % 80) / 100).alias("minor"))
    return receiver.with_radius(o, "acc", "minor", 0.95, "r95").select("event_id", at(F.col("r95"), 4).alias("r95_4"))
