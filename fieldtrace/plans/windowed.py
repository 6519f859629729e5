"""Queries of window-style operators (N-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..operators import windows as N
from ..sources.views import fixes, observations, passes, read, sql, tracks
from .catalog import query
from .common import at, at_sql, hav_sql


@query(sql("tracks", f"select device, n, {at_sql(hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon'), 2)} as leg_cm from tracks window w as (partition by device order by n)"))
def n01_leg_lengths(spark, d):
    w = Window.partitionBy("device").orderBy("n")
    return tracks(spark, d).select("device", "n", at(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), 2).alias("leg_cm"))


@query(
    sql(
        "tracks",
        f""", p as (select *, case when acc <= 15 then lat end as plat, case when acc <= 15 then lon end as plon from tracks)
        select device, n, {at_sql(hav_sql("last_value(plat ignore nulls) over w", "last_value(plon ignore nulls) over w", "lat", "lon"), 2)} as leg_cm from p window w as (partition by device order by n rows between unbounded preceding and 1 preceding)""",
    )
)
def n02_leg_from_last_precise(spark, d):
    """The distance from the last precise fix, whatever lies between."""
    w = Window.partitionBy("device").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col("acc") <= 15, F.col(c)), ignorenulls=True).over(w)
    return tracks(spark, d).select("device", "n", at(geo.haversine(last("lat"), last("lon"), F.col("lat"), F.col("lon")), 2).alias("leg_cm"))


@query(
    sql(
        "fixes",
        """, g as (select *, case when t_ms - lag(t_ms) over (partition by device order by t_ms, event_id) > 3600000 then 1 else 0 end as new from fixes),
        r as (select *, sum(new) over (partition by device order by t_ms, event_id) as run from g) select device, run, min(t_ms) as from_ms, max(t_ms) as to_ms, count(*) as n from r group by device, run""",
    )
)
def n03_gap_sessions(spark, d):
    runs = N.gap_runs(fixes(spark, d), ["device"], "t_ms", 3_600_000, tie="event_id")
    return runs.groupBy("device", "run").agg(F.min("t_ms").alias("from_ms"), F.max("t_ms").alias("to_ms"), F.count("*").alias("n"))


@query(
    sql(
        "tracks",
        f""", g as (select *, case when t_ms - lag(t_ms) over w > 300000 or {hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} > 1500 then 1 else 0 end as new from tracks window w as (partition by device order by n)),
        r as (select *, sum(new) over (partition by device order by n) as run from g) select device, run, count(*) as n from r group by device, run""",
    )
)
def n04_runs_by_time_and_distance(spark, d):
    w = Window.partitionBy("device").orderBy("n")
    far = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) > 1500
    late = F.col("t_ms") - F.lag("t_ms").over(w) > 300_000
    return N.with_runs(tracks(spark, d), ["device"], ["n"], far | late).groupBy("device", "run").agg(F.count("*").alias("n"))


@query()
def n05_stay_points(spark, d):
    """Stays within 150 m of a running centroid, for two minutes here."""
    s = N.stay_points(tracks(spark, d).select("device", "t_ms", "lat", "lon"), ["device"], least_ms=60_000)
    return s.select("device", "from_ms", "to_ms", "n", at(F.col("lat"), 6).alias("lat6"))


@query(
    sql(
        "observations",
        """, s as (select distinct device, t_ms // 86400000 as scan, bssid, first_value(dbm) over (partition by device, t_ms // 86400000, bssid order by t_ms desc, event_id desc) as dbm from observations),
        l as (select *, lag(scan) over w as before, lag(dbm) over w as was, lead(scan) over w as next from s window w as (partition by device, bssid order by scan))
        select device, bssid, scan, case when before is null then 'new' when scan - before > 2 then 'back' when dbm - was >= 8 then 'up' when was - dbm >= 8 then 'down' else 'same' end as event, coalesce(next - scan > 2, true) as lost from l""",
    )
)
def n06_scan_difference(spark, d):
    """What each scan brings: new, back, stronger or weaker transmitters, and those that two scans will miss."""
    scan = F.floor(F.col("t_ms") / 86_400_000)
    s = observations(spark, d).groupBy("device", scan.alias("scan"), "bssid").agg(F.max_by("dbm", F.struct("t_ms", "event_id")).alias("dbm"))
    w = Window.partitionBy("device", "bssid").orderBy("scan")
    s = s.withColumns({"before": F.lag("scan").over(w), "was": F.lag("dbm").over(w), "next": F.lead("scan").over(w)})
    event = F.when(F.col("before").isNull(), "new").when(F.col("scan") - F.col("before") > 2, "back").when(F.col("dbm") - F.col("was") >= 8, "up").when(F.col("was") - F.col("dbm") >= 8, "down").otherwise("same")
    return s.select("device", "bssid", "scan", event.alias("event"), F.coalesce(F.col("next") - F.col("scan") > 2, F.lit(True)).alias("lost"))


@query(sql("passes", "select uid from (select uid, row_number() over (partition by camera_id order by t_ms desc, uid desc) as r from passes) where r <= 20"))
def n07_last_n_per_key(spark, d):
    r = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("t_ms"), F.desc("uid")))
    return passes(spark, d).withColumn("r", r).where("r <= 20").select("uid")


@query(sql("passes", "select uid, rank() over (partition by camera_id order by distance_m) + (count(*) over (partition by camera_id, distance_m) - 1) / cast(2 as double) as rank from passes"))
def n08_average_rank(spark, d):
    r = F.rank().over(Window.partitionBy("camera_id").orderBy("distance_m")) + (F.count("*").over(Window.partitionBy("camera_id", "distance_m")) - 1) / 2
    return passes(spark, d).select("uid", r.cast("double").alias("rank"))


@query(sql("tracks", "select device, n, sum(case when acc > 15 then 1 else 0 end) over (partition by device order by n rows between 2 preceding and 2 following) >= 3 as rough from tracks"))
def n09_majority_of_five(spark, d):
    w = Window.partitionBy("device").orderBy("n").rowsBetween(-2, 2)
    return tracks(spark, d).select("device", "n", (F.sum((F.col("acc") > 15).cast("int")).over(w) >= 3).alias("rough"))


@query(sql("tracks", "select device, n, count(*) over (partition by device order by t_ms range between 30000 preceding and 30000 following) as around from tracks"))
def n10_time_range_frame(spark, d):
    return tracks(spark, d).select("device", "n", F.count("*").over(Window.partitionBy("device").orderBy("t_ms").rangeBetween(-30_000, 30_000)).alias("around"))


@query(sql("tracks", f", l as (select device, n, coalesce({hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')}, 0) as m from tracks window w as (partition by device order by n)) select device, n, cast((sum({at_sql('m', 9)}) over (partition by device order by n) + 50000000) // 100000000 as bigint) as total_dm from l"))
def n11_cumulative_distance(spark, d):
    """The way of a device so far. Its steps are whole nanometres, so that the sum doesn't depend on the order in which an engine adds."""
    w = Window.partitionBy("device").orderBy("n")
    legs = tracks(spark, d).withColumn("m", F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0)))
    return legs.withColumn("__step", at(F.col("m"), 9)).withColumn("__nm", F.sum("__step").over(w)).select("device", "n", F.expr("(__nm + 50000000) div 100000000").alias("total_dm"))


@query(sql("tracks", ", f as (select device, n, acc > 12 as inside from tracks), r as (select device, n, inside, n - row_number() over (partition by device, inside order by n) as run from f) select device, min(n) as first_n, max(n) as last_n from r where inside group by device, run"))
def n12_exposure_intervals(spark, d):
    """Unbroken stretches of a route that are inside."""
    f = tracks(spark, d).where("acc > 12")
    run = F.col("n") - F.row_number().over(Window.partitionBy("device").orderBy("n"))
    return f.withColumn("run", run).groupBy("device", "run").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n")).drop("run")


@query(
    sql(
        "fixes",
        """, i as (select device, t_ms - acc * 20000 as low, t_ms + acc * 20000 as high from fixes), g as (select *, case when low > max(high) over (partition by device order by low, high rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from i),
        r as (select *, sum(new) over (partition by device order by low, high) as run from g) select device, cast(min(low) as bigint) as low, cast(max(high) as bigint) as high, count(*) as n from r group by device, run""",
    )
)
def n14_merged_intervals(spark, d):
    i = fixes(spark, d).select("device", (F.col("t_ms") - F.col("acc").cast("long") * 20_000).alias("low"), (F.col("t_ms") + F.col("acc").cast("long") * 20_000).alias("high"))
    return N.merged_intervals(i, ["device"], "low", "high")


@query(
    sql(
        "passes",
        """, recursive p as (select camera_id, uid, t_ms, distance_m, row_number() over (partition by camera_id order by t_ms, uid) as k from passes),
        r as (select camera_id, k, t_ms as kt, distance_m as kd, uid as ku, 1 as g from p where k = 1
        union all select p.camera_id, p.k, case when p.t_ms - r.kt > 600000 or p.distance_m < r.kd then p.t_ms else r.kt end, case when p.t_ms - r.kt > 600000 or p.distance_m < r.kd then p.distance_m else r.kd end, case when p.t_ms - r.kt > 600000 or p.distance_m < r.kd then p.uid else r.ku end, r.g + case when p.t_ms - r.kt > 600000 then 1 else 0 end
        from r join p on p.camera_id = r.camera_id and p.k = r.k + 1)
        select camera_id, arg_max(ku, k) as uid from r group by camera_id, g""",
    ).replace("with passes", "with recursive passes", 1).replace(", recursive p as", ", p as")
)
def n15_events_within_ten_minutes(spark, d):
    """Events of an asset within ten minutes of the one kept are one event: the closest."""
    p = passes(spark, d).select("camera_id", "uid", "t_ms", "distance_m")
    kept = N.fold(p, ["camera_id"], ["t_ms", "uid"], N.kept_within(600_000, "distance_m"), restart=("t_ms", 600_000))
    return kept.where("kept").select("camera_id", "uid")


@query(
    sql(
        "passes",
        """, recursive p as (select camera_id, uid, t_ms, row_number() over (partition by camera_id order by t_ms, uid) as k from passes),
        r as (select camera_id, k, t_ms as kt, uid, true as kept from p where k = 1 union all select p.camera_id, p.k, case when p.t_ms - r.kt >= 86400000 then p.t_ms else r.kt end, p.uid, p.t_ms - r.kt >= 86400000 from r join p on p.camera_id = r.camera_id and p.k = r.k + 1)
        select camera_id, uid from r where kept""",
    ).replace("with passes", "with recursive passes", 1).replace(", recursive p as", ", p as")
)
def n16_once_a_day(spark, d):
    """An event is reported only a day after the last one that was."""
    p = passes(spark, d).select("camera_id", "uid", "t_ms")
    return N.fold(p, ["camera_id"], ["t_ms", "uid"], N.throttled(86_400_000), restart=("t_ms", 86_400_000)).where("kept").select("camera_id", "uid")


@query(
    sql(
        "tracks",
        """, m as (select device, n, t_ms, acc, case when acc <= 8 then 'foot' when acc <= 18 then 'vehicle' else 'still' end as mode from tracks),
        g as (select *, case when mode <> lag(mode) over w or t_ms - lag(t_ms) over w > 600000 then 1 else 0 end as new from m window w as (partition by device order by n)),
        r as (select *, sum(new) over (partition by device order by n) as run from g) select device, run, min(mode) as mode, count(*) as n from r group by device, run""",
    )
)
def n17_mode_segments(spark, d):
    mode = F.when(F.col("acc") <= 8, "foot").when(F.col("acc") <= 18, "vehicle").otherwise("still")
    t = tracks(spark, d).withColumn("mode", mode)
    w = Window.partitionBy("device").orderBy("n")
    breaks = (F.col("mode") != F.lag("mode").over(w)) | (F.col("t_ms") - F.lag("t_ms").over(w) > 600_000)
    return N.with_runs(t, ["device"], ["n"], breaks).groupBy("device", "run").agg(F.min("mode").alias("mode"), F.count("*").alias("n"))
