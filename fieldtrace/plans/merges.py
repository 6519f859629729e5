"""Queries of the merge-style writers (W-*) and of rows as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..sources.views import fixes, observations, passes, pois, read, sql
from .catalog import query
from .common import at, at_sql


def _orders(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.lit(1).cast("long").alias("seen"))


@query("with o as (select o_orderkey as k, o_custkey as cust, o_orderstatus as status, cast(1 as bigint) as seen from orders where o_orderkey % 3 <> 0), n as (select o_orderkey as k, o_custkey + 1 as cust, case when o_orderkey % 4 = 0 then '' else 'N' end as status, cast(1 as bigint) as seen from orders where o_orderkey % 2 = 0) select coalesce(n.k, o.k) as k, coalesce(n.cust, o.cust) as cust, case when n.status <> '' then n.status else o.status end as status, coalesce(o.seen, 0) + coalesce(n.seen, 0) as seen from o full join n on o.k = n.k")
def w01_upsert(spark, d):
    """Counts add up; a text changes only to one that isn't empty."""
    o = _orders(spark, d)
    new = o.where("k % 2 = 0").withColumns({"cust": F.col("cust") + 1, "status": F.when(F.col("k") % 4 == 0, "").otherwise("N")})
    rules = {"status": F.when(F.col("new.status") != "", F.col("new.status")).otherwise(F.col("old.status")), "seen": F.coalesce("old.seen", F.lit(0)) + F.coalesce("new.seen", F.lit(0))}
    return M.upsert(o.where("k % 3 <> 0"), new, ["k"], rules)


@query(sql("observations", "select distinct bssid, t_ms // 3600000 as hour from observations"))
def w02_insert_or_ignore(spark, d):
    o = observations(spark, d).select("bssid", F.floor(F.col("t_ms") / 3_600_000).alias("hour"), "event_id")
    old = M.first_per_key(o.where("event_id < 4000"), ["bssid", "hour"], ["event_id"])
    return M.insert_or_ignore(old, o.where("event_id >= 3000"), ["bssid", "hour"], ["event_id"]).select("bssid", "hour")


@query("select o_orderkey as k, o_custkey as cust, 'N' as status, cast(case when o_orderkey % 5 = 0 then 7 else 1 end as bigint) as seen from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_custkey, o_orderstatus, cast(case when o_orderkey % 5 = 0 then 7 else 1 end as bigint) from orders where o_orderkey % 2 = 1")
def w03_replace_but_keep_learned(spark, d):
    """New rows replace old ones but for what was learned: the larger count stays."""
    o = _orders(spark, d)
    old = o.withColumn("seen", F.when(F.col("k") % 5 == 0, 7).otherwise(1).cast("long"))
    return M.upsert(old, o.where("k % 2 = 0").withColumn("status", F.lit("N")), ["k"], {"seen": F.greatest("old.seen", "new.seen")})


@query("with a as (select o_orderkey as k, o_orderstatus as s from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as s from orders where o_orderkey % 5 <> 0) select case when a.k is null then 'added' when b.k is null then 'missing' when a.s is not distinct from b.s then 'unchanged' else 'updated' end as status, count(*) as n from a full join b on a.k = b.k group by 1")
def w04_three_way_counts(spark, d):
    o = _orders(spark, d)
    new = o.where("k % 5 <> 0").withColumn("status", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("status")))
    return M.three_way(o.where("k % 3 <> 0"), new, "k", ["status"]).groupBy("status").agg(F.count("*").alias("n"))


@query("select s_suppkey as id, case when exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity >= 49 and l_linenumber = 1) then 'stale' else 'delete' end as action from supplier where s_suppkey % 4 = 0")
def w05_reconcile(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    used = read(spark, d, "lineitem").where("l_quantity >= 49 and l_linenumber = 1").select(F.col("l_suppkey").alias("id"))
    return M.reconcile(s, s.where("id % 4 <> 0"), used, "id")


@query("with r as (select o_custkey as k, o_orderdate as stamp, 1 as ours, o_orderkey as v from orders union all select o_custkey, o_orderdate, 0, o_orderkey + 1000000 from orders where o_orderkey % 2 = 0) select k, max(stamp_ms) as stamp_ms, max(ours) as ours from (select k, epoch_us(stamp) // 1000 as stamp_ms, ours, rank() over (partition by k order by stamp desc) as x from r) where x = 1 group by k")
def w07_newest_writer(spark, d):
    """The newest stamp of a key wins, and of equal ones our own."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).alias("stamp_ms"), "o_orderkey")
    rows = o.withColumn("ours", F.lit(1)).union(o.where("o_orderkey % 2 = 0").withColumn("ours", F.lit(0)))
    return M.newest_writer(rows, "k", "stamp_ms", "ours").select("k", "stamp_ms", "ours")


@query("select n_nationkey as k, 'new' as origin from nation where n_regionkey = 1 union all select n_nationkey, 'old' from nation where n_regionkey <> 1")
def w08_replace_scope(spark, d):
    """All rows of one scope are replaced; others stay."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    return n.where("n_regionkey <> 1").select("k", F.lit("old").alias("origin")).union(n.where("n_regionkey = 1").select("k", F.lit("new").alias("origin")))


@query("select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) where r <= 5")
def w09_keep_last_n(spark, d):
    return M.last_n(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], [F.desc("o_orderkey")], 5).select("o_orderkey")


@query("select min(o_orderkey) as o_orderkey from orders group by o_custkey, o_orderstatus")
def w10_keep_first(spark, d):
    return M.first_per_key(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_orderkey")


@query("select event_id from events order by event_id desc limit 500")
def w11_bounded_queue(spark, d):
    return read(spark, d, "events").select("event_id").orderBy(F.desc("event_id")).limit(500)


@query(
    sql(
        "fixes",
        """, s as (select event_id, t_ms, cast(acc as bigint) as bytes, event_id % 100 = 0 as hot from fixes), h as (select sum(bytes) as held from s where hot)
        select event_id from s where hot union all select event_id from (select event_id, sum(bytes) over (order by t_ms desc, event_id desc) as run from s where not hot), h where held + run <= 300000""",
    )
)
def w12_spill_with_classes(spark, d):
    """The newest that fit; rows of the kept class are never dropped."""
    s = fixes(spark, d).select("t_ms", "event_id", F.col("acc").cast("long").alias("bytes"))
    return M.bounded_queue(s, "t_ms", "bytes", 300_000, F.col("event_id") % 100 == 0).select("event_id")


@query(sql("cams", "select id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || cast(floor(lon * 1000) as bigint) || ',' || cast(floor(lat * 1000) as bigint) || ']},\"properties\":{\"id\":' || id || ',\"operator\":\"' || operator || '\"}}' as feature from cams"))
def w13_geojson(spark, d):
    """One feature a row (whole thousandths of a degree here)."""
    from ..sources.views import cams

    point = F.struct(F.lit("Point").alias("type"), F.array(F.floor(F.col("lon") * 1000), F.floor(F.col("lat") * 1000)).alias("coordinates"))
    made = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("id", "operator").alias("properties"))
    return cams(spark, d).select("id", F.to_json(made).alias("feature"))


@query(sql("tracks", """select device, n // 1000 as part, '<trkseg>' || string_agg('<trkpt lat="' || cast(floor(lat * 100000) as bigint) || '" lon="' || cast(floor(lon * 100000) as bigint) || '"/>', '' order by n) || '</trkseg>' as gpx from tracks group by device, n // 1000"""))
def w14_gpx(spark, d):
    """Track segments of a device, a thousand points in each (whole hundred-thousandths of a degree here)."""
    from ..sources.views import tracks

    point = F.concat(F.lit('<trkpt lat="'), F.floor(F.col("lat") * 100000).cast("string"), F.lit('" lon="'), F.floor(F.col("lon") * 100000).cast("string"), F.lit('"/>'))
    t = tracks(spark, d).groupBy("device", F.floor(F.col("n") / 1000).alias("part")).agg(F.sort_array(F.collect_list(F.struct("n", point.alias("p")))).alias("ps"))
    return t.select("device", "part", F.concat(F.lit("<trkseg>"), F.array_join(F.transform("ps", lambda x: x["p"]), ""), F.lit("</trkseg>")).alias("gpx"))


@query("select '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' as row from nation")
def w15_json_dump(spark, d):
    return read(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("row"))


@query("with c as (select c_custkey as k, cast(c_custkey as bigint) as seq, c_nationkey as v, case when c_custkey % 3 = 0 then case when c_custkey % 2 = 0 then c_nationkey else null end else c_nationkey end as nv, c_custkey % 3 = 0 as hit from customer) select k, case when hit and v is distinct from nv then 1000000 + row_number() over (partition by hit and v is distinct from nv order by k) - 1 else seq end as seq, case when hit then nv else v end as v from c")
def w16_bump_only_on_change(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("long").alias("seq"), F.col("c_nationkey").alias("v"))
    new = c.where("k % 3 = 0").select("k", F.when(F.col("k") % 2 == 0, F.col("v")).alias("v"))
    return M.changed(c, new, "k", ["v"], "seq", 1_000_000)


@query("select distinct substr(sha256(text), 1, 32) as uid, octet_length(encode(text)) as bytes from documents")
def w17_content_addressed(spark, d):
    """Content by its digest: equal content is stored once."""
    from ..functions.text import media_uid

    t = F.col("text").cast("binary")
    return read(spark, d, "documents").select(media_uid(t).alias("uid"), F.length(t).cast("long").alias("bytes")).distinct()


@query("select event_id, substr(event_type, 1, 4) as kind from events where event_type in ('click', 'view', 'error') and event_id % 10 <> 0")
def w18_ingest_whitelist(spark, d):
    """Known kinds only, texts clipped, keys that are there already ignored."""
    e = read(spark, d, "events").select("event_id", "event_type")
    known = e.where("event_id % 10 = 0").select("event_id")
    return e.where(F.col("event_type").isin("click", "view", "error")).join(known, "event_id", "left_anti").select("event_id", F.substring("event_type", 1, 4).alias("kind"))


@query(sql("passes", ", a as (select uid as k, 'm:' || camera_id as target from passes where confidence < 10) select p.camera_id, count(distinct coalesce(a.target, p.uid)) as n from passes p left join a on p.uid = a.k group by p.camera_id"))
def x23_alias_resolution(spark, d):
    p = passes(spark, d)
    aliases = p.where("confidence < 10").select("uid", F.concat(F.lit("m:"), F.col("camera_id").cast("string")).alias("target"))
    return M.resolved(p.select("uid", "camera_id"), aliases, "uid").groupBy("camera_id").agg(F.countDistinct("uid").alias("n"))


@query(sql("pois", f", e as (select distinct printf('%.3f,%.3f', floor(lat * 1000) / 1000, floor(lon * 1000) / 1000) as key, cast(floor(lat * 1000) as bigint) % 97 as elev from pois) select p.id, e.elev from pois p left join e on printf('%.3f,%.3f', floor(p.lat * 1000) / 1000, floor(p.lon * 1000) / 1000) = e.key and e.elev > 20"))
def x25_cell_cache_join(spark, d):
    """Elevations by the text key of a cell."""
    key = F.concat_ws(",", F.format_string("%.3f", F.floor(F.col("lat") * 1000) / 1000), F.format_string("%.3f", F.floor(F.col("lon") * 1000) / 1000))
    p = pois(spark, d).withColumn("key", key)
    cells = p.select("key", (F.floor(F.col("lat") * 1000) % 97).alias("elev")).distinct().where("elev > 20")
    return p.join(cells, "key", "left").select("id", "elev")
