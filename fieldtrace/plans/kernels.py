"""Queries of fits, folds and plate functions, most without SQL of equal rows; the tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fusion, hours, plates, radio
from ..functions.text import trailing_state
from ..operators import folds, graph, locate
from ..operators import windows as N
from ..sources.views import cams, observations, passes, pois, read, sql, tracks
from .catalog import query
from .common import at, at_sql


@query()
def t01_transmitter_fit(spark, d):
    """Where each transmitter is, with covariance, radius of 95 % and grade."""
    fit = locate.level_fit(observations(spark, d), "bssid")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("r95") / 4))
    return fit.select("bssid", "n", "lat", "lon", "r95", radio.letter(score).alias("grade"))


@query()
def t03_self_location(spark, d):
    """Where a receiver is, from the transmitters that it hears."""
    heard = observations(spark, d).withColumn("scan", F.floor(F.col("event_id") / 5)).join(cams(spark, d).select(F.col("id").alias("k"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), F.col("event_id") % 100 == F.col("k"))
    h = heard.select("scan", F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), radio.metres_of_level(F.col("dbm"), F.lit(-36.0)).alias("metres")).withColumn("sd", F.col("metres") * 0.4 + 5)
    return locate.range_fix(h, ["scan"]).select("scan", "n", at(F.col("lat"), 5).alias("lat5"), at(F.col("acc"), 1).alias("acc1"))


@query()
def t09_track_smoothing(spark, d):
    s = folds.smoothed_track(tracks(spark, d))
    return s.select("device", "t_ms", at(F.col("lat"), 6).alias("lat6"), at(F.col("lon"), 6).alias("lon6"), at(F.col("sd"), 2).alias("sd2"), "outlier")


@query(
    sql(
        "passes",
        """, p as (select camera_id, uid, t_ms, distance_m, row_number() over (partition by camera_id order by t_ms, uid) as k from passes),
        r as (select camera_id, k, t_ms as kt, distance_m as kd, uid as ku, 1 as g from p where k = 1
        union all select p.camera_id, p.k, case when p.t_ms - r.kt > 600000 or p.distance_m < r.kd then p.t_ms else r.kt end, case when p.t_ms - r.kt > 600000 or p.distance_m < r.kd then p.distance_m else r.kd end, case when p.t_ms - r.kt > 600000 or p.distance_m < r.kd then p.uid else r.ku end, r.g + case when p.t_ms - r.kt > 600000 then 1 else 0 end
        from r join p on p.camera_id = r.camera_id and p.k = r.k + 1)
        select camera_id, arg_max(ku, k) as uid, count(*) as n from r group by camera_id, g""",
    ).replace("with passes", "with recursive passes", 1)
)
def t05_merged_passes(spark, d):
    """Passes within ten minutes of the closest one so far, as that one, with their number."""
    return folds.merged_passes(passes(spark, d), ["camera_id"]).select("camera_id", "uid", "n")


@query(sql("observations", ", e as (select distinct a.bssid as a, b.bssid as b from observations a join observations b on a.device = b.device and abs(a.t_ms - b.t_ms) <= 900000 and a.bssid < b.bssid), u as (select a, b from e union select b, a from e), recursive_r as (select a as node, a as seen from u union select r.node, u.b from recursive_r r join u on r.seen = u.a) select node, min(seen) as component from recursive_r group by node").replace("with observations", "with recursive observations", 1))
def t15_transmitter_groups(spark, d):
    """Transmitters that are heard together, as connected components."""
    # what is heard next is all that a row must be linked to: whatever two rows have between them hangs together too
    links = N.heard_next(observations(spark, d).select("device", "t_ms", "bssid"), ["device"], "t_ms", "bssid", 900_000)
    return graph.components(links, "a", "b")


@query()
def t22_plate_fusion(spark, d):
    """One plate of the reads of a track: the group that weighs most, its vote by slot, and the choice by formats."""
    p = passes(spark, d)
    n = F.col("t_ms").cast("long") + F.col("confidence")
    clean = F.concat(F.lit("ABC"), F.lpad((F.crc32("plate") % 10_000).cast("string"), 4, "0"))
    seen = F.when(n % 11 == 0, F.lit("XYZ9876")).when(F.col("confidence") < 20, F.translate(clean, "10", "IO")).otherwise(clean)
    conf = F.greatest(F.lit(0.3), F.col("confidence") / 100)
    r = p.select("camera_id", F.floor(F.col("t_ms") / 86_400_000 / 30).alias("month"), "uid", seen.alias("text"), plates.alike_lattice(seen, conf).alias("slots"), (F.col("distance_m") / 65).alias("q"), conf.alias("conf"))
    return fusion.fused_tracks(r, ["camera_id", "month"], ["uid"]).select("camera_id", "month", "text", "fit", at(F.col("conf"), 3).alias("conf3"), "frames", "exact", "accepted")


@query(sql("observations", f", r as (select bssid, dbm, row_number() over (partition by bssid order by event_id) as k, count(*) over (partition by bssid) as n from observations) select bssid, {at_sql('sum(dbm * (case when k <= 30 then pow(cast(29 as double) / 30, greatest(n - 30, 0)) / least(n, 30) else pow(cast(29 as double) / 30, n - k) / 30 end))', 6)} as mean6 from r group by bssid"))
def a18_capped_mean(spark, d):
    """A running mean whose newest value counts for a thirtieth at least."""
    return folds.averaged(observations(spark, d), "bssid", "event_id", "dbm").select("bssid", at(F.col("mean"), 6).alias("mean6"))


@query()
def s27_plate_variants(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.array_join(plates.plate_variants(F.concat(F.lit("O"), F.col("c_custkey").cast("string"))), ",").alias("variants"))


@query()
def s32_jaro_winkler(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", at(plates.jaro_winkler("p_name", "p_type"), 9).alias("s9"), at(plates.jaro_winkler(F.upper("p_name"), "p_type"), 9).alias("u9"))


@query()
def s44_opening_hours(spark, d):
    texts = F.array(*map(F.lit, ("Mo-Fr 08:00-17:00", "24/7", "Fr-Mo 18:00-02:00; We off", "Sa 10:00+", "by appointment", "Mo,We 09:00-12:00, 13:00-18:00")))
    p = pois(spark, d).select("id", F.element_at(texts, (F.col("id") % 6 + 1).cast("int")).alias("hours"))
    return p.select("id", hours.is_open("hours", (F.col("id") * 37) % 10080).alias("open"))


@query("select c_custkey, case when c_nationkey % 3 = 0 then 'PA' when c_nationkey % 3 = 1 then 'NJ' end as state from customer")
def s56_state_codes(spark, d):
    """Names of states as codes, by a map."""
    names = F.create_map(F.lit("PENNSYLVANIA"), F.lit("PA"), F.lit("NEW JERSEY"), F.lit("NJ"))
    n = F.col("c_nationkey") % 3
    return read(spark, d, "customer").select("c_custkey", F.try_element_at(names, F.upper(F.when(n == 0, "Pennsylvania").when(n == 1, "New Jersey").otherwise("Elsewhere"))).alias("state"))


@query(sql("tracks", ", r as (select device, n, row_number() over (partition by device order by n) as k, acc > 20 as miss from tracks) select a.device, a.n from r a join r b on b.device = a.device and b.k = a.k - 1 where a.miss and b.miss"))
def x09_two_strikes(spark, d):
    """The second of two misses in a row."""
    w = Window.partitionBy("device").orderBy("n")
    t = tracks(spark, d).withColumn("miss", F.col("acc") > 20)
    return t.withColumn("before", F.lag("miss").over(w)).where("miss and before").select("device", "n")


@query()
def t48_insecure_once_a_day(spark, d):
    """Insecure networks, each reported a day after its last report."""
    o = observations(spark, d).select("bssid", "t_ms", "event_id")
    return N.fold(o, ["bssid"], ["t_ms", "event_id"], N.throttled(86_400_000), restart=("t_ms", 86_400_000)).where("kept").select("bssid", "event_id")


@query("select c_custkey, case when c_custkey % 2 = 0 then 'PA' end as state from customer")
def s31b_state_of_agency(spark, d):
    made = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, " PA").otherwise(" pa"))
    return read(spark, d, "customer").select("c_custkey", trailing_state(made, ("PA",)).alias("state"))
