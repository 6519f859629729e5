"""Queries of scans, filters, top-k, paging and set operations (R-01, R-02, F-*, K-*, U-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..operators import windows as N
from ..sources.views import cams, fixes, observations, passes, pois, read, sql, tracks
from .catalog import query
from .common import at, at_sql, hav_sql


@query(sql("fixes", f"select event_id, device, t_ms, source, {at_sql('lat', 6)} as lat6, {at_sql('lon', 6)} as lon6, acc from fixes"))
def r01_table_scan(spark, d):
    return fixes(spark, d).select("event_id", "device", "t_ms", "source", at(F.col("lat"), 6).alias("lat6"), at(F.col("lon"), 6).alias("lon6"), "acc")


@query("select c_custkey, c_name from customer where c_custkey = 77")
def r02_point_lookup(spark, d):
    return read(spark, d, "customer").where("c_custkey = 77").select("c_custkey", "c_name")


@query(sql("fixes", "select event_id from fixes where lat between 40.004 and 40.012 and lon between -74.996 and -74.985"))
def f01_bounding_box(spark, d):
    return fixes(spark, d).where(F.col("lat").between(40.004, 40.012) & F.col("lon").between(-74.996, -74.985)).select("event_id")


@query(sql("tracks", "select device from tracks group by device having min(lat) <= 40.05 and max(lat) >= 40.01 and min(lon) <= -74.97 and max(lon) >= -74.99"))
def f02_box_overlap(spark, d):
    box = tracks(spark, d).groupBy("device").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("x"), F.max("lon").alias("y"))
    return box.where("a <= 40.05 and b >= 40.01 and x <= -74.97 and y >= -74.99").select("device")


@query(sql("observations", "select event_id, bssid from observations where upper(bssid) in ('AP0001', 'AP0007', 'AP0042') and acc <= 100"))
def f03_in_list(spark, d):
    return observations(spark, d).where(F.upper("bssid").isin("AP0001", "AP0007", "AP0042") & (F.col("acc") <= 100)).select("event_id", "bssid")


@query(sql("fixes", "select count(*) as n from fixes where acc >= 0 and acc <= 100 and lat is not null and not (lat = 0 and lon = 0)"))
def f04_valid_fixes(spark, d):
    return fixes(spark, d).where("acc >= 0 and acc <= 100 and lat is not null and not (lat = 0 and lon = 0)").agg(F.count("*").alias("n"))


@query("select p_partkey from part where p_type like 'ECON%' or p_type like 'S%'")
def f05_like_prefix(spark, d):
    return read(spark, d, "part").where(F.col("p_type").startswith("ECON") | F.col("p_type").like("S%")).select("p_partkey")


@query(sql("fixes", "select event_id from fixes where source not like 'p%' and t_ms between 1704500000000 and 1705500000000"))
def f06_not_like_range(spark, d):
    return fixes(spark, d).where(~F.col("source").like("p%") & F.col("t_ms").between(1704500000000, 1705500000000)).select("event_id")


@query("select event_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-08'")
def f07_time_window(spark, d):
    return read(spark, d, "events").where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-08'").select("event_id")


@query(sql("passes", "select uid from passes where camera_id = 7 and confidence >= 50"))
def f08_optional_predicates(spark, d):
    """Only the predicates that are asked for are put together."""
    asked = {"camera_id": 7, "plate": None, "confidence": 50}
    made = {"camera_id": lambda v: F.col("camera_id") == v, "plate": lambda v: F.col("plate") == v, "confidence": lambda v: F.col("confidence") >= v}
    where = reduce(lambda a, b: a & b, (made[k](v) for k, v in asked.items() if v is not None), F.lit(True))
    return passes(spark, d).where(where).select("uid")


@query("select c_custkey, case when c_name like '%9' then 'nomap' when c_mktsegment = 'BUILDING' then 'home' when c_acctbal < 0 then 'ignored' when c_nationkey < 5 then 'travelling' when c_acctbal > 5000 then 'active' else 'used' end as status from customer")
def f09_status_rules(spark, d):
    """Ordered rules: the first that holds decides."""
    status = F.when(F.col("c_name").like("%9"), "nomap").when(F.col("c_mktsegment") == "BUILDING", "home").when(F.col("c_acctbal") < 0, "ignored").when(F.col("c_nationkey") < 5, "travelling").when(F.col("c_acctbal") > 5000, "active").otherwise("used")
    return read(spark, d, "customer").select("c_custkey", status.alias("status"))


@query("select p_partkey from part where p_brand glob 'Brand#?2' or p_name glob '*e*'")
def f10_glob(spark, d):
    from ..functions.text import glob_pattern

    return read(spark, d, "part").where(F.col("p_brand").rlike(glob_pattern("Brand#?2")) | F.col("p_name").rlike(glob_pattern("*e*"))).select("p_partkey")


@query("select c_custkey from customer where ends_with(c_name, '7') or contains(c_name, '00012')")
def f11_opt_out_suffix(spark, d):
    return read(spark, d, "customer").where(F.col("c_name").endswith("7") | F.col("c_name").contains("00012")).select("c_custkey")


@query("select doc_id from documents where regexp_matches(text, 'token|license|http', 'i')")
def f12_regex_alternation(spark, d):
    return read(spark, d, "documents").where(F.col("text").rlike("(?i)token|license|http")).select("doc_id")


def _fold_sql(keep: str) -> str:
    """A recursive expression that carries the last kept row along a track."""
    return sql(
        "tracks",
        f""", recursive r as (select device, n, t_ms, lat, lon, true as kept, t_ms as kt, lat as klat, lon as klon from tracks where n = 1
        union all select t.device, t.n, t.t_ms, t.lat, t.lon, x.keep, case when x.keep then t.t_ms else r.kt end, case when x.keep then t.lat else r.klat end, case when x.keep then t.lon else r.klon end
        from r join tracks t on t.device = r.device and t.n = r.n + 1, lateral (select {keep} as keep) x)
        select device, count(*) as n, sum(case when kept then 1 else 0 end) as n_kept, sum(case when kept then n else 0 end) as kept_sum from r group by device""",
    ).replace("with tracks", "with recursive tracks", 1).replace(", recursive r as", ", r as")


def _kept(df):
    return df.groupBy("device").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("n_kept"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("kept_sum"))


@query(_fold_sql(f"not (t.t_ms - r.kt <= 300000 and {hav_sql('r.klat', 'r.klon', 't.lat', 't.lon')} > 38.0 * (t.t_ms - r.kt) / 1000)"))
def f13_teleport_filter(spark, d):
    """Fixes that imply over 38 m/s against the last kept one go."""
    return _kept(N.fold(tracks(spark, d), ["device"], ["t_ms"], N.no_teleports, restart=("t_ms", 300_000)))


@query(_fold_sql(f"not (t.t_ms - r.kt < 30000 and {hav_sql('r.klat', 'r.klon', 't.lat', 't.lon')} < 25.0)"))
def f15_track_thinning(spark, d):
    """Fixes both soon after and near the last kept one go."""
    return _kept(N.fold(tracks(spark, d), ["device"], ["t_ms"], N.thinned, restart=("t_ms", 30_000)))


@query()
def f16_path_cleaning(spark, d):
    """Fixes over 250 km/h go, unless three in a row agree."""
    return _kept(N.fold(tracks(spark, d), ["device"], ["t_ms"], N.cleaned_path, restart=("t_ms", N.ANYWHERE_MS)))


@query(sql("cams", "select id from cams where dir >= 90"))
def f17_confirmed_only(spark, d):
    return cams(spark, d).where("dir >= 90").select("id")


@query("select c_custkey, case when c_acctbal > 5000 then 'fit' when c_nationkey < 5 then 'placed' when c_mktsegment = 'MACHINERY' then 'peer' else 'observed' end as origin, cast(floor(coalesce(case when c_acctbal > 5000 then c_acctbal end, case when c_nationkey < 5 then cast(c_nationkey as double) end, cast(c_custkey as double))) as bigint) as value from customer")
def f18_position_precedence(spark, d):
    """The first candidate whose condition holds, with its origin."""
    picks = [("fit", F.col("c_acctbal") > 5000, F.col("c_acctbal")), ("placed", F.col("c_nationkey") < 5, F.col("c_nationkey").cast("double")), ("peer", F.col("c_mktsegment") == "MACHINERY", F.col("c_custkey").cast("double"))]
    best = F.coalesce(*(F.when(ok, F.struct(F.lit(name).alias("origin"), v.alias("v"))) for name, ok, v in picks), F.struct(F.lit("observed").alias("origin"), F.col("c_custkey").cast("double").alias("v")))
    return read(spark, d, "customer").withColumn("b", best).select("c_custkey", "b.origin", F.floor("b.v").alias("value"))


@query("select p_partkey from part where p_size in (1, 2, 3) and contains(lower(p_name || ' ' || p_type), 'promo')")
def f19_place_filter(spark, d):
    return read(spark, d, "part").where(F.col("p_size").isin(1, 2, 3) & F.lower(F.concat_ws(" ", "p_name", "p_type")).contains("promo")).select("p_partkey")


@query(sql("pois", f", far as (select id, {at_sql(hav_sql('lat', 'lon', 'cast(40.01 as double)', 'cast(-74.99 as double)'))} as mm from pois where size <= 10) select id, mm from far where mm <= 500000 order by mm, id"))
def f20_radius_nearest_first(spark, d):
    far = at(geo.haversine(F.col("lat"), F.col("lon"), F.lit(40.01), F.lit(-74.99)))
    return pois(spark, d).where("size <= 10").select("id", far.alias("mm")).where("mm <= 500000").orderBy("mm", "id")


@query(sql("pois", "select id, name from pois where lat between 40.004 and 40.006"))
def f21_prune_then_fetch(spark, d):
    return pois(spark, d).where("lat between 40.004 and 40.006").select("id", "name")


@query(sql("passes", "select uid, t_ms from passes order by t_ms desc, uid desc limit 50"))
def k01_latest(spark, d):
    return passes(spark, d).select("uid", "t_ms").orderBy(F.desc("t_ms"), F.desc("uid")).limit(50)


@query(sql("cams", "select id from cams order by (lat - 40.01) * (lat - 40.01) + (lon + 74.99) * (lon + 74.99) * cast(0.5868240888 as double), id limit 10"))
def k02_nearest_k(spark, d):
    """Nearest assets by squared degrees, with the longitude scaled."""
    far = (F.col("lat") - 40.01) * (F.col("lat") - 40.01) + (F.col("lon") + 74.99) * (F.col("lon") + 74.99) * 0.5868240888
    return cams(spark, d).orderBy(far, "id").limit(10).select("id")


@query("select c_custkey, c_custkey = (select max(c_custkey) from (select c_custkey from customer where c_custkey > 100 order by c_custkey limit 21)) as next_page from (select c_custkey from customer where c_custkey > 100 order by c_custkey limit 21)")
def k03_keyset_page(spark, d):
    """A page after a key, with the row that begins the next page."""
    page = read(spark, d, "customer").where("c_custkey > 100").select("c_custkey").orderBy("c_custkey").limit(21)
    return page.crossJoin(F.broadcast(page.agg(F.max("c_custkey").alias("top")))).select("c_custkey", (F.col("c_custkey") == F.col("top")).alias("next_page"))


@query(
    """with o as (select 'orders' as t, o_orderkey as seq from orders where o_orderkey > 40 order by seq limit 100), c as (select 'customer' as t, c_custkey as seq from customer where c_custkey > 40 order by seq limit 100),
    a as (select * from o union all select * from c), caps as (select min(m) as cursor from (select t, max(seq) as m, count(*) as n from a group by t) where n = 100) select t, seq from a, caps where seq <= coalesce(cursor, seq)"""
)
def k04_change_feed(spark, d):
    """The next rows of every table, up to the last sequence number that no capped table has left behind."""
    own = lambda table, key: read(spark, d, table).select(F.lit(table).alias("t"), F.col(key).alias("seq")).where("seq > 40").orderBy("seq").limit(100)
    rows = own("orders", "o_orderkey").union(own("customer", "c_custkey"))
    cursor = rows.groupBy("t").agg(F.max("seq").alias("m"), F.count("*").alias("n")).where("n = 100").agg(F.min("m").alias("cursor"))
    return rows.crossJoin(F.broadcast(cursor)).where("seq <= coalesce(cursor, seq)").select("t", "seq")


@query("select c_custkey from customer order by c_custkey limit 20 offset 40")
def k05_offset_page(spark, d):
    return read(spark, d, "customer").select("c_custkey").orderBy("c_custkey").offset(40).limit(20)


@query(sql("passes", "select camera_id, uid from (select camera_id, uid, row_number() over (partition by camera_id order by confidence desc, distance_m, uid) as r from passes) where r <= 7"))
def k06_top_k_per_group(spark, d):
    r = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("confidence"), "distance_m", "uid"))
    return passes(spark, d).withColumn("r", r).where("r <= 7").select("camera_id", "uid")


@query(sql("pois", "select id from (select id, row_number() over (partition by cat, case when size <= 5 then 0 else 1 end order by size, id) as r, size from pois) where r <= 3"))
def k08_tiered_group_cap(spark, d):
    """The first few of each group and tier."""
    r = F.row_number().over(Window.partitionBy("cat", F.when(F.col("size") <= 5, 0).otherwise(1)).orderBy("size", "id"))
    return pois(spark, d).withColumn("r", r).where("r <= 3").select("id")


@query(sql("observations", ", cells as (select bssid, device, event_id, dbm, row_number() over (partition by bssid, cast(floor(lat * 400) as bigint), cast(floor(lon * 400) as bigint) order by dbm desc, event_id) as r from observations), ranked as (select *, row_number() over (partition by bssid order by dbm desc, event_id) as k from cells where r = 1) select bssid, event_id from ranked where k <= 6"))
def k09_vantage_picks(spark, d):
    """The strongest sample of each cell around a transmitter, the six strongest of those."""
    o = observations(spark, d)
    y, x = geo.cell(F.col("lat"), F.col("lon"), 400)
    best = o.groupBy("bssid", y.alias("y"), x.alias("x")).agg(F.max(F.struct("dbm", (-F.col("event_id")).alias("e"))).alias("b")).select("bssid", "b.dbm", (-F.col("b.e")).alias("event_id"))
    return best.withColumn("k", F.row_number().over(Window.partitionBy("bssid").orderBy(F.desc("dbm"), "event_id"))).where("k <= 6").select("bssid", "event_id")


@query(sql("pois", f", far as (select id, size, {at_sql(hav_sql('lat', 'lon', 'cast(40.01 as double)', 'cast(-74.99 as double)'))} as mm from pois) select id, size from far where mm <= 700000 order by size desc, id limit 10"))
def k10_best_suggestions(spark, d):
    far = at(geo.haversine(F.col("lat"), F.col("lon"), F.lit(40.01), F.lit(-74.99)))
    return pois(spark, d).withColumn("mm", far).where("mm <= 700000").orderBy(F.desc("size"), "id").limit(10).select("id", "size")


@query(sql("observations", ", c as (select event_id, bssid, t_ms, row_number() over (partition by bssid, cast(floor(lat * 200) as bigint), cast(floor(lon * 200) as bigint) order by t_ms desc, event_id desc) as depth from observations), r as (select *, row_number() over (partition by bssid order by depth, t_ms desc, event_id desc) as k from c) select event_id from r where k <= 30"))
def k11_crowded_cells_first(spark, d):
    """At most thirty samples of a transmitter; the oldest of the most crowded cells go first."""
    y, x = geo.cell(F.col("lat"), F.col("lon"), 200)
    newest = (F.desc("t_ms"), F.desc("event_id"))
    depth = F.row_number().over(Window.partitionBy("bssid", y, x).orderBy(*newest))
    o = observations(spark, d).withColumn("depth", depth)
    return o.withColumn("k", F.row_number().over(Window.partitionBy("bssid").orderBy("depth", *newest))).where("k <= 30").select("event_id")


@query("select s_suppkey as id, 'pin' as origin from supplier where s_suppkey % 5 = 0 union all select s_suppkey, 'stored' from supplier where s_suppkey % 5 <> 0")
def u01_pins_override(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    pins = s.where("id % 5 = 0").withColumn("origin", F.lit("pin"))
    return pins.union(s.join(pins, "id", "left_anti").withColumn("origin", F.lit("stored")))


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'F'")
def u02_difference(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct())


@query("select (select count(*) from (select c_custkey from customer intersect select o_custkey from orders)) as common, (select count(*) from (select c_custkey from customer union select o_custkey from orders)) as everything")
def u03_set_sizes(spark, d):
    a, b = read(spark, d, "customer").select(F.col("c_custkey").alias("k")), read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    tagged = a.withColumn("s", F.lit(1)).union(b.withColumn("s", F.lit(2))).groupBy("k").agg(F.countDistinct("s").alias("n"))
    return tagged.agg(F.count_if(F.col("n") == 2).alias("common"), F.count("*").alias("everything"))


@query("select distinct event_type from events")
def u04_distinct(spark, d):
    return read(spark, d, "events").select("event_type").distinct()


@query("select event_type, cast(row_number() over (order by first_id) as integer) as place from (select event_type, min(event_id) as first_id from events group by event_type)")
def u05_distinct_in_order(spark, d):
    """Distinct values by first appearance."""
    first = read(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"))
    return first.select("event_type", F.row_number().over(Window.orderBy("first_id")).alias("place"))


@query(sql("fixes", "select event_id, t_ms from fixes where source = 'click' or source = 'view' order by t_ms, event_id"))
def u06_merged_runs(spark, d):
    f = fixes(spark, d).select("event_id", "t_ms", "source")
    return f.where("source = 'click'").union(f.where("source = 'view'")).select("event_id", "t_ms").orderBy("t_ms", "event_id")
