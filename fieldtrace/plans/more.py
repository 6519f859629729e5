"""Further composite operators as plain plans: calibration, sampling along routes, rule files, propagation of changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..operators import aggregates as A
from ..operators import composites as C
from ..operators import joins as J
from ..operators import merge as M
from ..sources.views import cams, fixes, observations, passes, pois, read, sql, tracks
from .catalog import query
from .common import at, at_sql, hav_sql


@query(
    sql(
        "fixes",
        f""", p as (select a.event_id, a.acc, {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} as m, row_number() over (partition by a.event_id order by abs(a.t_ms - b.t_ms), b.event_id) as r, a.device from fixes a join fixes b on abs(a.t_ms - b.t_ms) <= 600000 where a.source = 'click' and b.source = 'view')
        select device, {at_sql('case when count(*) < 3 then cast(1 as double) else greatest(cast(1 as double), least(cast(25 as double), list_sort(list(m / acc))[cast(ceil(count(*) * 0.68 - 1e-9) as bigint)])) end', 5)} as scale5, count(*) as n from p where r = 1 group by device""",
    )
)
def t12_provider_calibration(spark, d):
    """How far a provider's fixes are off against their claimed accuracy, at 68 %."""
    f = fixes(spark, d)
    left = f.where("source = 'click'").select("event_id", "device", "t_ms", "acc", "lat", "lon")
    right = f.where("source = 'view'").select(F.col("event_id").alias("other"), "t_ms", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    near = J.interval_nearest(left, right, "t_ms", 600_000, "event_id", "other")
    ratio = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / F.col("acc")
    return near.withColumn("ratio", ratio).groupBy("device").agg(at(A.rank_percentile("ratio", 0.68, 1.0, 25.0, 3, 1.0), 5).alias("scale5"), F.count("*").alias("n"))


@query(sql("tracks", f", l as (select device, {hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} / acc as r from tracks window w as (partition by device order by n)) select device, {at_sql('greatest(cast(0.25 as double), least(cast(25 as double), median(r) / cast(1.1774 as double)))', 5)} as scale5 from l where r is not null group by device"))
def t10_accuracy_scale(spark, d):
    """The scale that brings the median of normalised errors to that of a circular normal distribution."""
    w = Window.partitionBy("device").orderBy("n")
    r = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) / F.col("acc")
    scale = F.greatest(F.lit(0.25), F.least(F.lit(25.0), F.median("r") / 1.1774))
    return tracks(spark, d).select("device", r.alias("r")).where("r is not null").groupBy("device").agg(at(scale, 5).alias("scale5"))


@query(
    "with b as (select event_id, (event_id * 7) % 11 as company, event_id % 13 as uuid, event_type from events), hits as (select event_id, 1 as tier from b where company = 3 and uuid < 6 union all select event_id, 2 from b where uuid between 4 and 6 union all select event_id, 3 from b where event_type = 'error' and company = 5) select event_id, max(tier) as tier, count(*) as n_rules from hits group by event_id"
)
def t19_beacon_signatures(spark, d):
    """Names, ranges of identifiers, and companies that count only with a second sign."""
    b = read(spark, d, "events").select("event_id", ((F.col("event_id") * 7) % 11).alias("company"), (F.col("event_id") % 13).alias("uuid"), "event_type")
    prefixes = spark.createDataFrame([], "prefix string, tier int")
    rules = [("company", 1, (F.col("company") == 3) & (F.col("uuid") < 6)), ("range", 2, F.col("uuid").between(4, 6)), ("name", 3, (F.col("event_type") == "error") & (F.col("company") == 5))]
    return C.signatures(b, "event_id", F.col("event_type"), prefixes, rules).select("event_id", "tier", "n_rules")


@query(
    sql(
        "tracks",
        f""", l as (select device, n, lat, lon, lead(lat) over w as lat2, lead(lon) over w as lon2 from tracks window w as (partition by device order by n)),
        m as (select *, greatest(cast(1 as bigint), cast(ceil({hav_sql('lat', 'lon', 'lat2', 'lon2')} / 5) as bigint)) as many from l where lat2 is not null),
        k as (select device, lat, lon, lat2, lon2, many, unnest(range(many)) as k from m),
        s as (select device, lat + (lat2 - lat) * k / many as y, lon + (lon2 - lon) * k / many as x from k)
        select device, count(*) as n_samples, count(*) filter (y > 40.0041234 and y < 40.0201234 and x > -74.9981234 and x < -74.9851234) as inside from s group by device""",
    )
)
def t25_sampled_route_in_area(spark, d):
    """A route sampled every five metres, and how many of the samples lie in an area to avoid."""
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-74.9981234, 40.0041234), (-74.9851234, 40.0041234), (-74.9851234, 40.0201234), (-74.9981234, 40.0201234), (-74.9981234, 40.0041234))))
    w = Window.partitionBy("device").orderBy("n")
    legs = tracks(spark, d).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")
    many = F.greatest(F.lit(1), F.ceil(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / 5))
    s = legs.withColumn("many", many).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    y, x = F.col("lat") + (F.col("lat2") - F.col("lat")) * F.col("k") / F.col("many"), F.col("lon") + (F.col("lon2") - F.col("lon")) * F.col("k") / F.col("many")
    return s.groupBy("device").agg(F.count("*").alias("n_samples"), F.count_if(geo.in_ring(x, y, ring)).alias("inside"))


@query(sql("cams", f"select id, {at_sql('cast(40.02 as double) + ((lat - 40) * cast(111320 as double) * cos(radians(30)) - (lon + 75) * cast(111320 as double) * cos(radians(40)) * sin(radians(30))) / cast(111320 as double)', 6)} as lat6 from cams"))
def t36_anchors_moved(spark, d):
    """Anchors moved to a new reference that is turned by thirty degrees."""
    east, north = geo.local_xy(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-75.0))
    _, n = geo.rotated(east, north, F.lit(30.0))
    return cams(spark, d).select("id", at(40.02 + n / 111_320.0, 6).alias("lat6"))


@query(sql("pois", f", k as (select cat, id, {at_sql(hav_sql('lat', 'lon', 'cast(40.01 as double)', 'cast(-74.99 as double)'))} as mm from pois), b as (select cat, id, mm, row_number() over (partition by cat order by mm, id) as r from k) select cat, id, case when mm < 100000 then 'here' when mm < 400000 then 'walk' else 'drive' end as how from b where r = 1"))
def t42_nearest_help(spark, d):
    """The nearest place of each kind, and how one gets there."""
    p = pois(spark, d).select("cat", "id", at(geo.haversine(F.col("lat"), F.col("lon"), F.lit(40.01), F.lit(-74.99))).alias("mm"))
    b = p.groupBy("cat").agg(F.min(F.struct("mm", "id")).alias("b"))
    return b.select("cat", "b.id", F.when(F.col("b.mm") < 100_000, "here").when(F.col("b.mm") < 400_000, "walk").otherwise("drive").alias("how"))


@query(f"with v as (select event_id, cast((event_id * 37) % 1300 + 3000 as double) as mv from events) select event_id, {at_sql('case when mv <= 3300 then cast(0 as double) when mv <= 3600 then (mv - 3300) / 300 * 20 when mv <= 3750 then 20 + (mv - 3600) / 150 * 30 when mv <= 3950 then 50 + (mv - 3750) / 200 * 30 when mv <= 4200 then 80 + (mv - 3950) / 250 * 20 else cast(100 as double) end', 3)} as level3 from v")
def t43_battery_curve(spark, d):
    """Percent of a voltage, linear between the points of a curve."""
    points = [(3300, 0), (3600, 20), (3750, 50), (3950, 80), (4200, 100)]
    mv = ((F.col("event_id") * 37) % 1300 + 3000).cast("double")
    level = F.when(mv <= points[0][0], 0.0)
    for (a, x), (b, y) in zip(points, points[1:], strict=False):
        level = level.when(mv <= b, x + (mv - a) / (b - a) * (y - x))
    return read(spark, d, "events").select("event_id", at(level.otherwise(100.0)).alias("level3"))


@query(
    sql(
        "passes tracks",
        f""", r as (select camera_id, confidence, row_number() over (partition by camera_id order by t_ms desc, uid) as k from passes where t_ms >= (select max(t_ms) from passes) - 259200000),
        seen as (select camera_id, bool_or(confidence >= 95) as leaky from r where k <= 200 group by camera_id),
        m as (select device, t_ms, max(t_ms) over (partition by device) as now, t_ms - lag(t_ms) over w as dt, {hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as m from tracks window w as (partition by device order by n)),
        d as (select device, bool_or(coalesce(t_ms >= now - 1800000 and dt between 5000 and 600000 and m / (dt / cast(1000 as double)) * 3.6 > 20, false)) as driving from m group by device)
        select c.id as camera_id, case when seen.leaky then 'leaky' when seen.camera_id is not null then 'reader' when coalesce(driving, false) then 'driving' else 'idle' end as mode
        from (select s_suppkey as id from supplier) c left join seen on seen.camera_id = c.id left join d on device = 't' || (c.id % 40)""",
    )
)
def x03_watcher_mode(spark, d):
    """The mode that recent activity calls for: a leaky pass or any pass in 72 hours (the latest 200), else driving within half an hour, else idle."""
    p = passes(spark, d)
    recent = p.crossJoin(F.broadcast(p.agg(F.max("t_ms").alias("now")))).where(F.col("t_ms") >= F.col("now") - 259_200_000)
    k = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("t_ms"), "uid"))
    seen = recent.withColumn("k", k).where("k <= 200").groupBy("camera_id").agg(F.bool_or(F.col("confidence") >= 95).alias("leaky"))
    w = Window.partitionBy("device").orderBy("n")
    t = tracks(spark, d).select("device", "t_ms", F.max("t_ms").over(Window.partitionBy("device")).alias("now"), (F.col("t_ms") - F.lag("t_ms").over(w)).alias("dt"), geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")).alias("m"))
    fast = (F.col("t_ms") >= F.col("now") - 1_800_000) & F.col("dt").between(5_000, 600_000) & (F.col("m") / (F.col("dt") / 1000.0) * 3.6 > 20)
    moving = t.groupBy("device").agg(F.bool_or(F.coalesce(fast, F.lit(False))).alias("driving"))
    c = read(spark, d, "supplier").select(F.col("s_suppkey").alias("camera_id"), F.concat(F.lit("t"), (F.col("s_suppkey") % 40).cast("string")).alias("device"))
    both = c.join(seen, "camera_id", "left").join(moving, "device", "left")
    mode = F.when(F.col("leaky"), "leaky").when(F.col("leaky").isNotNull(), "reader").when(F.col("driving"), "driving").otherwise("idle")
    return both.select("camera_id", mode.alias("mode"))


@query("select '{\"k\":' || o_orderkey || ',\"total\":' || cast(floor(o_totalprice) as bigint) || ',\"status\":\"' || o_orderstatus || '\"}' as row from orders")
def x21_typed_json(spark, d):
    """Rows as JSON with the types of their columns."""
    o = read(spark, d, "orders")
    return o.select(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))).alias("row"))


@query("select o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where l_returnflag <> 'R' union select o_orderkey, l_linenumber from orders join lineitem on l_partkey = o_custkey and l_linenumber = 2 where l_returnflag <> 'R'")
def x22_media_of_events(spark, d):
    """Media of an event and of its asset, without the private kind."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    m = read(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", "l_linenumber")
    own = o.join(m, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")
    shared = o.join(m.where("l_linenumber = 2"), F.col("o_custkey") == F.col("l_partkey")).select("o_orderkey", "l_linenumber")
    return own.union(shared).distinct()


@query(sql("passes cams", ", n as (select p.uid, p.confidence, case when c.dir % 5 = 0 then p.confidence else least(40, p.confidence) end as conf from passes p join cams c on p.camera_id = c.id) select count(*) as n, sum(conf) as total, count(*) filter (conf <> confidence) as changed from n"))
def x24_classification_propagation(spark, d):
    """The type of an asset caps the confidence of its passes; only changed rows get a new number."""
    p = passes(spark, d).select(F.col("uid").alias("k"), "camera_id", F.col("confidence").alias("conf"), F.lit(0).cast("long").alias("seq"))
    c = cams(spark, d).select(F.col("id").alias("camera_id"), (F.col("dir") % 5 == 0).alias("reader"))
    # passes carry their asset's type along, so none is looked up again by its key
    typed = p.join(c, "camera_id").select("k", "conf", "seq", "reader")
    out = M.changed_in_place(typed, "k", {"conf": F.when(F.col("reader"), F.col("conf")).otherwise(F.least(F.lit(40), "conf"))}, "seq", 1)
    return out.agg(F.count("*").alias("n"), F.sum("conf").alias("total"), F.count_if(F.col("seq") > 0).alias("changed"))


@query("select n_nationkey as k, n_name as name from nation")
def r16_own_dump(spark, d):
    """A dump of rows as JSON, read back into a table that has some of them."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    dump = n.groupBy(F.floor(F.col("k") / 1000)).agg(F.to_json(F.struct(F.collect_list(F.struct("k", "name")).alias("rows"))).alias("raw"))
    rows = dump.select(F.inline(F.from_json("raw", "struct<rows: array<struct<k: int, name: string>>>")["rows"]))
    return M.insert_or_ignore(n.where("k < 10"), rows, ["k"], ["name"])


@query("select 'prefix' as kind, n_name as pattern, n_regionkey % 3 as tier from nation where n_nationkey % 2 = 0 union all select 'regex', lower(n_name), 2 from nation where n_nationkey % 2 = 1")
def r20_rule_file(spark, d):
    """A rule file as one row per rule; rules of an unknown kind or tier are left out."""
    n = read(spark, d, "nation")
    rule = F.struct(F.when(F.col("n_nationkey") % 2 == 0, "prefix").otherwise("regex").alias("kind"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("pattern"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey") % 3).otherwise(2).alias("tier"))
    bad = F.array(F.struct(F.lit("magic").alias("kind"), F.lit("x").alias("pattern"), F.lit(1).alias("tier")), F.struct(F.lit("regex").alias("kind"), F.lit("x").alias("pattern"), F.lit(9).alias("tier")))
    doc = n.agg(F.to_json(F.struct(F.concat(F.collect_list(rule), bad).alias("rules"))).alias("raw"))
    rows = doc.select(F.inline(F.from_json("raw", "struct<rules: array<struct<kind: string, pattern: string, tier: int>>>")["rules"]))
    return rows.where("kind in ('prefix', 'regex', 'uuid', 'company', 'name') and tier between 0 and 3")


@query("select p_partkey, case when p_type = 'LARGE' and p_size > 25 then 'hospital' when p_type = 'LARGE' then 'clinic' when p_type = 'SMALL' then 'pharmacy' when p_name like '%ring%' then 'police' else 'other' end as cat, case when p_type = 'LARGE' and p_size > 40 then 1 when p_type = 'LARGE' and p_size > 25 then 2 when p_type = 'LARGE' then 3 else 0 end as tier from part")
def s42_place_rules(spark, d):
    """Ordered rules on tags: the category, and the tier within it."""
    p, t = read(spark, d, "part"), F.create_map(F.lit("amenity"), F.col("p_type"), F.lit("beds"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"))
    amenity, beds = t["amenity"], t["beds"].cast("int")
    cat = F.when((amenity == "LARGE") & (beds > 25), "hospital").when(amenity == "LARGE", "clinic").when(amenity == "SMALL", "pharmacy").when(t["name"].contains("ring"), "police").otherwise("other")
    tier = F.when((amenity == "LARGE") & (beds > 40), 1).when((amenity == "LARGE") & (beds > 25), 2).when(amenity == "LARGE", 3).otherwise(0)
    return p.select("p_partkey", cat.alias("cat"), tier.alias("tier"))


@query(sql("passes", f"select uid, {at_sql('least(cast(1 as double), distance_m / 40) * (confidence / cast(100 as double)) * least(cast(1 as double), confidence / cast(60 as double))', 6)} as q6 from passes"))
def s55_quality_score(spark, d):
    """Height, sharpness and confidence as one number."""
    return passes(spark, d).select("uid", at(F.least(F.lit(1.0), F.col("distance_m") / 40) * (F.col("confidence") / 100.0) * F.least(F.lit(1.0), F.col("confidence") / 60.0), 6).alias("q6"))


@query(
    sql(
        "observations",
        f""", m as (select device, bssid, avg(dbm) as level from observations group by 1, 2), p as (select a.device as a, b.device as b, (a.level - b.level) * (a.level - b.level) as d2 from m a join m b on a.bssid = b.bssid and a.device < b.device)
        select a, b, count(*) as n, {at_sql('sqrt(greatest(cast(0 as double), median(d2)))', 5)} as gap5 from p group by a, b having count(*) >= 5""",
    )
)
def t31_fingerprint_distance(spark, d):
    """How far apart two devices hear the same transmitters, by the median squared difference."""
    m = observations(spark, d).groupBy("device", "bssid").agg(F.avg("dbm").alias("level"))
    a, b = m.select("bssid", F.col("device").alias("a"), F.col("level").alias("x")), m.select("bssid", F.col("device").alias("b"), F.col("level").alias("y"))
    p = a.join(b, "bssid").where("a < b").withColumn("d2", (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), at(F.sqrt(F.greatest(F.lit(0.0), F.median("d2"))), 5).alias("gap5")).where("n >= 5")
