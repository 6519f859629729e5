"""Queries of the composite operators (T-*, X-*) that are plain plans of joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, radio
from ..operators import aggregates as A
from ..operators import blocks as B
from ..operators import composites as C
from ..operators import joins as J
from ..sources.views import cams, fixes, observations, passes, pois, read, sql, tracks
from .catalog import query
from .common import at, at_sql, hav_sql


@query(sql("passes", f", g as (select camera_id, exp((2 * ln(greatest(avg(confidence), 1)) + ln(greatest(least(count(*), 100), 1)) + ln(1 + avg(distance_m))) / 4) as score from passes group by camera_id) select camera_id, {at_sql('score', 4)} as score4, case when score >= 85 then 'A' when score >= 70 then 'B' when score >= 55 then 'C' when score >= 40 then 'D' when score >= 20 then 'E' else 'F' end as letter from g"))
def t02_grade(spark, d):
    """A weighted geometric mean of metrics, and its letter."""
    m = passes(spark, d).groupBy("camera_id").agg(F.greatest(F.avg("confidence"), F.lit(1.0)).alias("a"), F.least(F.count("*"), F.lit(100)).alias("b"), (1 + F.avg("distance_m")).alias("c"))
    score = F.exp((2 * F.log("a") + F.log("b") + F.log("c")) / 4)
    return m.select("camera_id", at(score, 4).alias("score4"), radio.letter(score).alias("letter"))


@query(sql("passes", "select uid, cast(case when camera_id % 4 <> 0 then floor(100 * (confidence / cast(100 as double)) * (case when confidence < 30 then cast(0.7 as double) else 1 end) * (case when distance_m > 50 then cast(0.85 as double) else 1 end) + 0.5) else least(40, floor(100 * (confidence / cast(100 as double)) * (case when confidence < 30 then cast(0.7 as double) else 1 end) * (case when distance_m > 50 then cast(0.85 as double) else 1 end) + 0.5)) end as integer) as conf from passes"))
def t06_pass_scores(spark, d):
    p = passes(spark, d)
    return p.select("uid", radio.pass_confidence(F.col("confidence") / 100.0, F.col("confidence") < 30, F.col("distance_m") > 50, F.col("camera_id") % 4 != 0).alias("conf"))


@query(
    sql(
        "observations",
        f""", s as (select device, t_ms // 432000000 as k, bssid, max(dbm) as dbm, avg(lat) as lat, avg(lon) as lon from observations group by 1, 2, 3), h as (select * from s where device = 'dev1'), e as (select * from s where device <> 'dev1'),
        hs as (select k, count(*) as n from h group by k),
        m as (select h.k as scan, e.device, e.k, count(*) as n, sum((h.dbm - e.dbm) * (h.dbm - e.dbm)) as ss, avg(e.lat) as lat, avg(e.lon) as lon from h join e on h.bssid = e.bssid group by 1, 2, 3 having count(*) >= 3),
        sc as (select m.*, -0.5 * ss / (36 * m.n) - 2 * (hs.n - m.n) / cast(hs.n as double) + 0.5 * ln(m.n) as score from m join hs on hs.k = m.scan),
        r as (select *, row_number() over (partition by scan order by floor(score * 1e9) desc, device, k) as x from sc)
        select scan, {at_sql('sum(exp(score) * lat) / sum(exp(score))', 6)} as lat6, {at_sql('sum(exp(score) * lon) / sum(exp(score))', 6)} as lon6, count(*) as n from r where x <= 7 group by scan""",
    )
)
def t11_fingerprint_locate(spark, d):
    """A place from the seven most similar earlier scans, weighted by the exponential of their score."""
    k = F.floor(F.col("t_ms") / 432_000_000).alias("k")
    s = observations(spark, d).groupBy("device", k, "bssid").agg(F.max("dbm").alias("dbm"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return C.fingerprint_locate(s.where("device = 'dev1'").select(F.col("k").alias("scan"), "bssid", "dbm"), s.where("device <> 'dev1'"), ["device", "k"], sigma=6.0, penalty=2.0).select("scan", at(F.col("lat"), 6).alias("lat6"), at(F.col("lon"), 6).alias("lon6"), "n")


@query(sql("observations", f", m as (select bssid, device, median(dbm) as mid from observations group by 1, 2), h as (select * from m where device = 'dev0') select m.device, count(*) as n, {at_sql('median(m.mid - h.mid)', 6)} as offset6 from m join h on m.bssid = h.bssid where m.device <> 'dev0' group by m.device having count(*) >= 3"))
def t13_device_offsets(spark, d):
    """The median difference of a device to the host over the transmitters that both hear."""
    return C.device_offsets(observations(spark, d), "dev0").select("device", "n", at(F.col("offset"), 6).alias("offset6"))


@query(sql("observations", "select bssid, count(distinct cast(floor(lat * 20 + 0.5) as bigint) * 100000 + cast(floor(lon * 200 + 0.5) as bigint)) >= 3 or bssid in ('AP0003') as travelling from observations group by bssid"))
def t16_travelling(spark, d):
    """Transmitters heard in several cells; names on a list are decided first."""
    cell = F.floor(F.col("lat") * 20 + 0.5) * 100000 + F.floor(F.col("lon") * 200 + 0.5)
    return observations(spark, d).groupBy("bssid").agg((F.countDistinct(cell) >= 3).alias("far")).select("bssid", (F.col("far") | F.col("bssid").isin("AP0003")).alias("travelling"))


@query(sql("cams", f"select id, {at_sql('1 / (1 + exp(-(case when id % 3 = 0 then cast(2.2 as double) when id % 3 = 1 then cast(1.0 as double) else cast(-0.5 as double) end - cast(0.25 as double) * (dir / cast(60 as double)) + case when dir > 200 then cast(1.5 as double) else 0 end)))', 9)} as trust9 from cams"))
def t17_camera_trust(spark, d):
    """Log-odds of a prior, age and evidence, as a probability."""
    odds = F.when(F.col("id") % 3 == 0, 2.2).when(F.col("id") % 3 == 1, 1.0).otherwise(-0.5) - 0.25 * (F.col("dir") / 60.0) + F.when(F.col("dir") > 200, 1.5).otherwise(0)
    return cams(spark, d).select("id", at(radio.sigmoid(odds), 9).alias("trust9"))


@query(
    """with rules as (select distinct substr(c_name, 1, 16) as prefix, c_nationkey % 4 as tier from customer where c_custkey % 50 = 0), r2 as (select prefix, max(tier) as tier from rules group by prefix),
    hits as (select c_custkey, tier, 'prefix' as rule from customer join r2 on substr(c_name, 1, 16) = prefix union all select c_custkey, 2, 'name' from customer where regexp_matches(c_name, '7[0-3]$') union all select c_custkey, 3, 'segment' from customer where c_mktsegment = 'BUILDING' and c_acctbal < 0)
    select c_custkey, max(tier) as tier, count(*) as n_rules from hits group by c_custkey"""
)
def t18_signatures(spark, d):
    """The best tier of all rules that a row meets: prefixes by a join, patterns and combinations by expressions."""
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    prefixes = c.where("c_custkey % 50 = 0").groupBy(F.substring("c_name", 1, 16).alias("prefix")).agg(F.max(F.col("c_nationkey") % 4).alias("tier"))
    patterns = [("name", 2, F.col("c_name").rlike("7[0-3]$")), ("segment", 3, (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0))]
    return C.signatures(c, "c_custkey", F.substring("c_name", 1, 16), prefixes, patterns).select("c_custkey", "tier", "n_rules")


@query(sql("passes", "select p.uid, case when exists (select 1 from supplier s where sha256(lower(p.plate)) = sha256(lower('p' || (s_suppkey * 7)))) then 'verified' else 'unverified' end as verdict from passes p"))
def t20_hash_verification(spark, d):
    """Whether the full hash of a plate is that of a wanted one."""
    from ..functions.text import hashed

    wanted = read(spark, d, "supplier").select(hashed(F.concat(F.lit("P"), (F.col("s_suppkey") * 7).cast("string"))).alias("h")).distinct().withColumn("hit", F.lit(True))
    p = passes(spark, d).select("uid", hashed(F.col("plate")).alias("h"))
    return p.join(wanted, "h", "left").select("uid", F.when(F.col("hit"), "verified").otherwise("unverified").alias("verdict"))


@query(sql("passes", "select camera_id, plate, count(*) filter (confidence >= 70) >= 3 or count(*) filter (confidence >= 75 and distance_m < 30) >= 2 or count(*) filter (confidence >= 90 and distance_m < 10) >= 1 as accepted from passes group by camera_id, plate having count(*) > 1"))
def t23_acceptance(spark, d):
    """Several fair reads, two good ones, or one that is very good."""
    c = F.col
    n = lambda x: F.count_if(x)
    ok = (n(c("confidence") >= 70) >= 3) | (n((c("confidence") >= 75) & (c("distance_m") < 30)) >= 2) | (n((c("confidence") >= 90) & (c("distance_m") < 10)) >= 1)
    return passes(spark, d).groupBy("camera_id", "plate").agg(ok.alias("accepted"), F.count("*").alias("n")).where("n > 1").drop("n")


@query(
    sql(
        "observations",
        f""", x as (select bssid, cast(dbm as double) as y, log10(greatest(acc, cast(1 as double))) as x from observations), s as (select bssid, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from x group by bssid)
        select bssid, {at_sql('(sy + 4 * cast(-40 as double) - b * sx) / (n + 4)', 5)} as p05, {at_sql('-b / 10', 6)} as n6 from (select *, (sxy - sx * (sy + 4 * cast(-40 as double)) / (n + 4) + 4 * cast(-27 as double)) / (sxx - sx * sx / (n + 4) + 4) as b from s)""",
    )
)
def t29_path_loss_fit(spark, d):
    """Level against log range by least squares with a prior, from sums alone."""
    return C.path_loss_fit(observations(spark, d).select("bssid", F.col("dbm").cast("double").alias("y"), F.log10(F.greatest("acc", F.lit(1.0))).alias("x")), ["bssid"], p0=-40.0, exponent=2.7, weight=4.0).select("bssid", at(F.col("p0"), 5).alias("p05"), at(F.col("exponent"), 6).alias("n6"))


@query(sql("passes", "select uid, case when distance_m <= 2 then 'adjacent' when distance_m <= 6 then 'room' when distance_m <= 30 then 'near' else 'far' end as class from passes"))
def t33_range_class(spark, d):
    return passes(spark, d).select("uid", radio.range_class(F.col("distance_m")).alias("class"))


@query(sql("observations", f", m as (select device, bssid, median(dbm) as mid from observations group by 1, 2), p as (select a.device as a, b.device as b, a.mid - b.mid as gain from m a join m b on a.bssid = b.bssid and a.device < b.device), g as (select a, b, median(gain) as gain, count(*) as shared from p group by 1, 2) select p.a, p.b, shared, {at_sql('g.gain', 6)} as gain6, {at_sql('median(abs(p.gain - g.gain))', 6)} as rest6 from p join g on p.a = g.a and p.b = g.b group by p.a, p.b, shared, g.gain"))
def t34_proximity(spark, d):
    """Shared transmitters of two devices, their median difference, and what is left of it."""
    return C.proximity(observations(spark, d)).select("a", "b", "shared", at(F.col("gain"), 6).alias("gain6"), at(F.col("rest"), 6).alias("rest6"))


@query(
    sql(
        "passes",
        f""", c as (select camera_id, distance_m, count(*) over (partition by camera_id order by distance_m range between current row and 5 following) as n from passes), b as (select camera_id, distance_m as low, row_number() over (partition by camera_id order by n desc, distance_m) as r from c)
        select b.camera_id, low, count(*) as n, {at_sql('median(p.distance_m)', 3)} as center3 from b join passes p on p.camera_id = b.camera_id and p.distance_m between low and low + 5 where r = 1 group by b.camera_id, low""",
    )
)
def t35_densest_window(spark, d):
    """The window of 5 m with most ranges, the lowest of equals, and its median."""
    return C.densest_window(passes(spark, d), ["camera_id"], "distance_m", 5.0).select("camera_id", "low", "n", at(F.col("center"), 3).alias("center3"))


@query(sql("tracks", f", p as (select device, n, cast(floor((lon / 360 + 0.5) * 4194304) as bigint) as px, cast(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 4194304) as bigint) as py from tracks) select px // 256 as tx, py // 256 as ty, px % 256 as x, py % 256 as y, least(count(*), 255) as heat from p group by all"))
def t38_heat_tiles(spark, d):
    """How often each pixel of each map tile was visited, up to 255."""
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    p = tracks(spark, d).select(F.floor(x * 4194304).alias("px"), F.floor(y * 4194304).alias("py"))
    key = [F.floor(F.col("px") / 256).alias("tx"), F.floor(F.col("py") / 256).alias("ty"), (F.col("px") % 256).alias("x"), (F.col("py") % 256).alias("y")]
    return p.groupBy(*key).agg(F.least(F.count("*"), F.lit(255)).alias("heat"))


@query(sql("tracks", f", g as (select *, lead(t_ms) over (partition by device order by n) - t_ms as dwell, lead(lat) over (partition by device order by n) as lat2, lead(lon) over (partition by device order by n) as lon2 from tracks) select device, n, dwell, {at_sql(hav_sql('lat', 'lon', 'lat2', 'lon2'), 2)} as leg_cm from g where dwell > 300000"))
def t39_stops(spark, d):
    """Where a device stayed, for how long, and how far it went next."""
    w = Window.partitionBy("device").orderBy("n")
    g = tracks(spark, d).withColumns({"dwell": F.lead("t_ms").over(w) - F.col("t_ms"), "lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)})
    return g.where("dwell > 300000").select("device", "n", "dwell", at(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 2).alias("leg_cm"))


@query(sql("observations", ", b as (select bssid, device, acc, event_id, row_number() over (partition by bssid order by case when device = 'dev0' then 0 else 1 end, acc, event_id) as r from observations) select bssid, device, acc from b where r = 1"))
def t47_peer_positions(spark, d):
    """The tightest position of all devices, but our own where there is one."""
    best = F.min(F.struct((F.col("device") != "dev0").alias("other"), "acc", "event_id", "device"))
    return observations(spark, d).groupBy("bssid").agg(best.alias("b")).select("bssid", "b.device", "b.acc")


@query("select event_id, case event_type when 'click' then 3 when 'view' then 2 when 'signup' then 1 else 0 end as rank from events")
def x01_source_rank(spark, d):
    t = F.col("event_type")
    return read(spark, d, "events").select("event_id", F.when(t == "click", 3).when(t == "view", 2).when(t == "signup", 1).otherwise(0).alias("rank"))


@query(sql("pois cams", f", near as (select c.id, p.id as poi, p.size, {at_sql(hav_sql('c.lat', 'c.lon', 'p.lat', 'p.lon'))} as mm from cams c join pois p on abs(c.lat - p.lat) < 0.001 and abs(c.lon - p.lon) < 0.001) select id, poi, size, mm from (select *, row_number() over (partition by id order by size desc, mm, poi) as r from near where mm <= 60000) where r = 1"))
def x02_best_evidence(spark, d):
    """The evidence of the highest tier within 60 m, the nearest of equals."""
    best = B.best_near(pois(spark, d).select(F.col("id").alias("poi"), "size", "lat", "lon"), cams(spark, d), 60.0, "size", "poi", "id")
    return best.select("id", "poi", "size", F.col("__mm").alias("mm"))


@query(sql("cams", f", k as (select id, dir % 3 as land, {at_sql(hav_sql('lat', 'lon', 'cast(40.01 as double)', 'cast(-74.99 as double)'))} as mm from cams) select l as land, coalesce((select id from k where land = l order by mm, id limit 1), (select id from k order by mm, id limit 1)) as id from (select unnest([0, 1, 2, 7]) as l)"))
def x04_nearest_zone(spark, d):
    """The nearest zone of a country, or of all where it has none."""
    k = cams(spark, d).select("id", (F.col("dir") % 3).alias("land"), at(geo.haversine(F.col("lat"), F.col("lon"), F.lit(40.01), F.lit(-74.99))).alias("mm"))
    best = F.min(F.struct("mm", "id")).alias("b")
    wanted = spark.createDataFrame([(n,) for n in (0, 1, 2, 7)], "land int")
    return wanted.join(k.groupBy("land").agg(best), "land", "left").crossJoin(F.broadcast(k.agg(best.alias("any")))).select("land", F.coalesce("b.id", "any.id").alias("id"))


@query(sql("pois", f", p as (select cat, size, id, cast(floor((lon / 360 + 0.5) * 1048576 / 56) as bigint) as x, cast(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 1048576 / 56) as bigint) as y, lat from pois) select x, y, count(*) as n, {at_sql('avg(lat)', 6)} as lat6, max(size) as top from p group by x, y"))
def x05_marker_clusters(spark, d):
    """Markers of one screen cell as a cluster with their mean position."""
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    cell = [F.floor(x * 1048576 / 56).alias("x"), F.floor(y * 1048576 / 56).alias("y")]
    return pois(spark, d).groupBy(*cell).agg(F.count("*").alias("n"), at(F.avg("lat"), 6).alias("lat6"), F.max("size").alias("top"))


@query("select event_id, cast((event_id * 7) % 256 * 256 + (event_id * 11) % 256 as double) + cast((event_id * 13) % 256 as double) / 256 - 32768 as metres from events")
def x06_terrain_decode(spark, d):
    e = F.col("event_id")
    return read(spark, d, "events").select("event_id", (((e * 7) % 256 * 256 + (e * 11) % 256).cast("double") + ((e * 13) % 256).cast("double") / 256 - 32768).alias("metres"))


@query(sql("observations", "select bssid, event_id from (select bssid, event_id, row_number() over (partition by bssid order by case when event_id % 3 = 0 then 0 when event_id % 3 = 1 then 1 else 2 end, event_id desc) as r from observations) where r = 1"))
def x07_cache_precedence(spark, d):
    """By the rank of its kind, then the newest."""
    best = F.min(F.struct((F.col("event_id") % 3).alias("kind"), (-F.col("event_id")).alias("e")))
    return observations(spark, d).groupBy("bssid").agg(best.alias("b")).select("bssid", (-F.col("b.e")).alias("event_id"))


@query("select event_id, case event_type when 'view' then true when 'click' then date_diff('day', ts, timestamp '2024-02-01') < 365 else date_diff('day', ts, timestamp '2024-02-01') < 15 end as fresh from events")
def x08_cache_expiry(spark, d):
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts"))
    return read(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "click", age < 365).otherwise(age < 15).alias("fresh"))


@query(sql("observations", "select device, bssid, dbm from (select device, bssid, max(dbm) as dbm, row_number() over (partition by device order by max(dbm) desc, bssid) as r from observations group by device, bssid) where r <= 12"))
def x10_strongest(spark, d):
    s = observations(spark, d).groupBy("device", "bssid").agg(F.max("dbm").alias("dbm"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("device").orderBy(F.desc("dbm"), "bssid"))).where("r <= 12").drop("r")


@query(sql("observations", f", o as (select device, t_ms // 86400000 as k, bssid, lat, lon, acc from observations), m as (select device, k, list_sort(list(lat))[count(*) // 2 + 1] as mlat, list_sort(list(lon))[count(*) // 2 + 1] as mlon, count(*) as n from o group by 1, 2), f as (select o.*, {hav_sql('o.lat', 'o.lon', 'm.mlat', 'm.mlon')} > 700 + acc as far from o join m on o.device = m.device and o.k = m.k) select device, k, count(*) as n, count(*) filter (far) as n_far from f group by device, k"))
def x12_far_prescreen(spark, d):
    """Transmitters far from the middle of a scan."""
    o = observations(spark, d).withColumn("k", F.floor(F.col("t_ms") / 86_400_000))
    mid = o.groupBy("device", "k").agg(A.upper_median("lat").alias("mlat"), A.upper_median("lon").alias("mlon"))
    far = geo.haversine(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon")) > 700 + F.col("acc")
    return o.join(mid, ["device", "k"]).groupBy("device", "k").agg(F.count("*").alias("n"), F.count_if(far).alias("n_far"))


@query(sql("passes", "select uid, array_to_string(list_filter([case when confidence < 10 then 'extrapolated' end, case when distance_m > 60 then 'ambiguous' end, case when camera_id % 9 = 0 then 'moved' end], lambda x: x is not null), ',') as flags from passes"))
def x20_flag_list(spark, d):
    flags = F.array(F.when(F.col("confidence") < 10, "extrapolated"), F.when(F.col("distance_m") > 60, "ambiguous"), F.when(F.col("camera_id") % 9 == 0, "moved"))
    return passes(spark, d).select("uid", F.concat_ws(",", F.filter(flags, lambda x: x.isNotNull())).alias("flags"))


@query("select event_type as mode, case when n > 0 then least(cast(24 as double), pow(cast(2 as double), n - 1)) when event_type = 'click' then cast(3 as double) when event_type = 'view' then cast(24 as double) else cast(168 as double) end as hours, count(*) as rows from (select event_type, event_id % 7 as n from events) group by all")
def st13_schedule(spark, d):
    """Hours to the next poll, with a growing pause after failures."""
    mode = F.when(F.col("event_type") == "click", "leaky").when(F.col("event_type") == "view", "driving").otherwise("idle")
    e = read(spark, d, "events").select(F.col("event_type").alias("mode"), radio.schedule_hours(mode, (F.col("event_id") % 7).cast("double")).alias("hours"))
    return e.groupBy("mode", "hours").agg(F.count("*").alias("rows"))


@query("select user_id % 5 as node, min(event_id) as first_seq, max(event_id) as last_seq, count(*) as n from (select event_id, user_id, event_id - row_number() over (partition by user_id % 5 order by event_id) as run from events) group by user_id % 5, run")
def st16_unbroken_runs(spark, d):
    """Unbroken stretches of sequence numbers: what may be acknowledged."""
    e = read(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("node"))
    run = F.col("event_id") - F.row_number().over(Window.partitionBy("node").orderBy("event_id"))
    return e.withColumn("run", run).groupBy("node", "run").agg(F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"), F.count("*").alias("n")).drop("run")


@query("select epoch_us(time_bucket(interval 6 hour, ts)) // 1000000 as start_s, event_type, count(*) as n, cast(floor(sum(value) * 100 + 0.5) as bigint) as cents from events group by 1, 2")
def st17_tumbling_windows(spark, d):
    e = read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("t", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.floor(F.sum("value") * 100 + 0.5).alias("cents"))
    return g.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "cents")
