"""Queries of the aggregations (A-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..operators import aggregates as A
from ..sources.views import fixes, observations, passes, read, sql, tracks
from .catalog import query
from .common import at, at_sql, hav_sql


@query(sql("passes", "select count(*) as n, count(*) filter (confidence >= 50) as sure, count(*) filter (distance_m < 10) as close from passes"))
def a01_counts(spark, d):
    return passes(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 50).alias("sure"), F.count_if(F.col("distance_m") < 10).alias("close"))


@query(sql("fixes", "select count(distinct device) as devices from fixes"))
def a02_count_distinct(spark, d):
    return fixes(spark, d).agg(F.countDistinct("device").alias("devices"))


@query(sql("passes", "select confidence // 20 as grade, count(*) as n from passes group by grade"))
def a03_group_count(spark, d):
    return passes(spark, d).groupBy(F.floor(F.col("confidence") / 20).cast("int").alias("grade")).agg(F.count("*").alias("n"))


@query("select s_nationkey, sum(case when s_acctbal > 0 then 1 else 0 end) as positive, sum(case when s_acctbal > 5000 then 1 else 0 end) as large from supplier group by s_nationkey")
def a04_conditional_sums(spark, d):
    return read(spark, d, "supplier").groupBy("s_nationkey").agg(F.sum(F.when(F.col("s_acctbal") > 0, 1).otherwise(0)).alias("positive"), F.sum(F.when(F.col("s_acctbal") > 5000, 1).otherwise(0)).alias("large"))


@query(sql("fixes", "select device, count(*) filter (source = 'click' and acc < 50) as clicks, max(t_ms) as newest from fixes group by device"))
def a05_boolean_sums(spark, d):
    return fixes(spark, d).groupBy("device").agg(F.count_if((F.col("source") == "click") & (F.col("acc") < 50)).alias("clicks"), F.max("t_ms").alias("newest"))


@query("select coalesce(nullif(o_orderstatus, 'P'), '') as status, count(*) as n from orders group by 1")
def a06_group_coalesced(spark, d):
    """Unknown and empty are one group."""
    return read(spark, d, "orders").groupBy(F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("")).alias("status")).agg(F.count("*").alias("n"))


@query(sql("fixes", "select device, min(t_ms) as low, max(t_ms) as high, max(event_id) as last_id from fixes where event_id > 500 group by device"))
def a07_ranges_since_cursor(spark, d):
    return fixes(spark, d).where("event_id > 500").groupBy("device").agg(F.min("t_ms").alias("low"), F.max("t_ms").alias("high"), F.max("event_id").alias("last_id"))


@query(sql("observations", "select bssid, arg_max(dbm, event_id) as dbm, max(t_ms) as t_ms from observations group by bssid"))
def a08_arg_max(spark, d):
    return observations(spark, d).groupBy("bssid").agg(F.max_by("dbm", "event_id").alias("dbm"), F.max("t_ms").alias("t_ms"))


@query(sql("passes cams", "select c.id, count(p.uid) as pass_count from cams c left join passes p on p.camera_id = c.id and p.confidence >= 80 group by c.id"))
def a09_correlated_counts(spark, d):
    """Passes of every asset, none included."""
    n = passes(spark, d).where("confidence >= 80").groupBy("camera_id").agg(F.count("*").alias("n"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.join(n, F.col("id") == F.col("camera_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("pass_count"))


@query(sql("passes", "select coalesce(sum(confidence), 0) as total, coalesce(sum(confidence) filter (confidence > 1000), 0) as none from passes"))
def a10_totals(spark, d):
    return passes(spark, d).agg(F.coalesce(F.sum("confidence"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("confidence") > 1000, F.col("confidence"))), F.lit(0)).alias("none"))


@query(sql("observations", "select bssid, median(dbm) as mid from observations group by bssid"))
def a11_median(spark, d):
    return observations(spark, d).groupBy("bssid").agg(F.median("dbm").alias("mid"))


@query(sql("observations", "select bssid, list_sort(list(dbm))[count(*) // 2 + 1] as mid from observations group by bssid"))
def a12_upper_median(spark, d):
    return observations(spark, d).groupBy("bssid").agg(A.upper_median("dbm").cast("int").alias("mid"))


@query(sql("passes", f"select camera_id, {at_sql('quantile_cont(distance_m, 0.9)', 6)} as q90 from passes group by camera_id"))
def a13_quantile_type7(spark, d):
    return passes(spark, d).groupBy("camera_id").agg(at(F.percentile("distance_m", 0.9), 6).alias("q90"))


@query(sql("observations", "select bssid, case when count(*) < 3 then cast(9 as double) else greatest(cast(1 as double), least(cast(25 as double), list_sort(list(acc))[cast(ceil(count(*) * 0.68 - 1e-9) as bigint)])) end as q68 from observations group by bssid"))
def a14_rank_percentile(spark, d):
    return observations(spark, d).groupBy("bssid").agg(A.rank_percentile("acc", 0.68, 1.0, 25.0, 3, 9.0).alias("q68"))


@query(sql("observations", f", m as (select bssid, median(dbm) as mid from observations group by bssid) select o.bssid, mid as median, {at_sql('median(abs(dbm - mid)) * cast(1.4826 as double)', 6)} as mad6 from observations o join m on o.bssid = m.bssid group by o.bssid, mid"))
def a15_median_deviation(spark, d):
    return A.deviation(observations(spark, d), ["bssid"], "dbm").select("bssid", "median", at(F.col("mad"), 6).alias("mad6"))


@query(
    sql(
        "observations",
        f""", p as (select bssid, pow(cast(10 as double), dbm / cast(10 as double)) as p from observations), t as (select bssid, quantile_cont(p, 0.95) as top, count(*) as n from p group by bssid)
        select p.bssid, n, {at_sql('10 * log10(avg(case when n >= 8 then least(p, top) else p end) / (case when n >= 8 then cast(0.95 as double) else cast(1 as double) end))', 4)} as level4 from p join t on p.bssid = t.bssid group by p.bssid, n""",
    )
)
def a16_power_mean(spark, d):
    return A.power_mean(observations(spark, d), ["bssid"], "dbm").select("bssid", "n", at(F.col("level"), 4).alias("level4"))


@query(sql("passes", f"select camera_id, {at_sql('avg(distance_m)', 6)} as mean6 from passes group by camera_id"))
def a17_mean(spark, d):
    return passes(spark, d).groupBy("camera_id").agg(at(F.avg("distance_m"), 6).alias("mean6"))


@query(sql("observations", f", w as (select bssid, lat, lon, cast((dbm + 100) * (dbm + 100) as double) as w from observations) select bssid, {at_sql('sum(w * lat) / sum(w)', 6)} as lat6, {at_sql('sum(w * lon) / sum(w)', 6)} as lon6 from w group by bssid"))
def a19_weighted_centroid(spark, d):
    w = ((F.col("dbm") + 100) * (F.col("dbm") + 100)).cast("double")
    c = observations(spark, d).groupBy("bssid").agg(A.weighted_centroid(w, F.col("lat"), F.col("lon")).alias("c"))
    return c.select("bssid", at(F.col("c.lat"), 6).alias("lat6"), at(F.col("c.lon"), 6).alias("lon6"))


@query(sql("observations", f", r as (select bssid, lat, dbm, row_number() over (partition by bssid order by dbm desc, event_id) as k from observations) select bssid, {at_sql('sum(exp(dbm / cast(10 as double)) * lat) / sum(exp(dbm / cast(10 as double)))', 6)} as lat6 from r where k <= 7 group by bssid"))
def a20_softmax_top_k(spark, d):
    """Mean position of the seven best, weighted by the exponential of their score."""
    k = F.row_number().over(Window.partitionBy("bssid").orderBy(F.desc("dbm"), "event_id"))
    w = F.exp(F.col("dbm") / 10.0)
    return observations(spark, d).withColumn("k", k).where("k <= 7").groupBy("bssid").agg(at(F.sum(w * F.col("lat")) / F.sum(w), 6).alias("lat6"))


@query("select o_orderpriority as name, min(o_orderkey) as first_key, cast(row_number() over (order by min(o_orderkey)) as integer) as place from orders group by o_orderpriority")
def a22_first_seen_order(spark, d):
    first = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderkey").alias("first_key"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("first_key")))


@query(sql("observations", f"select bssid, {at_sql('greatest(cast(-25 as double), least(cast(25 as double), sum(dbm + 68) / (count(*) + cast(0.25 as double))))', 6)} as offset6 from observations group by bssid"))
def a23_shrunk_mean(spark, d):
    """A mean drawn to zero by a quarter of a sample, between bounds."""
    m = F.sum(F.col("dbm") + 68) / (F.count("*") + 0.25)
    return observations(spark, d).groupBy("bssid").agg(at(F.greatest(F.lit(-25.0), F.least(F.lit(25.0), m)), 6).alias("offset6"))


@query(sql("passes", f"select confidence // 20 as grade, {at_sql('avg(case when distance_m <= 40 then cast(1 as double) else cast(0 as double) end)', 6)} as coverage6, {at_sql('sqrt(least(cast(25 as double), greatest(cast(0.25 as double), avg(distance_m * distance_m / 900) / 2)))', 6)} as kappa6 from passes group by grade"))
def a24_coverage_by_grade(spark, d):
    """Share of errors inside the claimed radius, and the scale that errors ask for."""
    nees = F.avg(F.col("distance_m") * F.col("distance_m") / 900)
    return passes(spark, d).groupBy(F.floor(F.col("confidence") / 20).cast("int").alias("grade")).agg(
        at(F.avg(F.when(F.col("distance_m") <= 40, 1.0).otherwise(0.0)), 6).alias("coverage6"), at(F.sqrt(F.least(F.lit(25.0), F.greatest(F.lit(0.25), nees / 2))), 6).alias("kappa6")
    )


@query(
    sql(
        "passes",
        f""", b as (select camera_id, cast((l * 7) % 360 as double) as deg from (select camera_id, row_number() over (partition by camera_id order by uid) as l from passes)),
        s as (select camera_id, deg, deg - lag(deg) over (partition by camera_id order by deg) as step from b)
        select camera_id, {at_sql('max(sqrt(c * c + s_ * s_))', 6)} as r6, {at_sql('greatest(max(coalesce(step, 0)), 360 - (max(deg) - min(deg)))', 3)} as gap3 from s join (select camera_id as k, avg(cos(radians(deg))) as c, avg(sin(radians(deg))) as s_ from b group by camera_id) on k = camera_id group by camera_id""",
    )
)
def a25_circular(spark, d):
    """Agreement of bearings, and the widest arc without one."""
    n = F.row_number().over(Window.partitionBy("camera_id").orderBy("uid"))
    b = passes(spark, d).withColumn("l", n).select("camera_id", ((F.col("l") * 7) % 360).cast("double").alias("deg"))
    return b.groupBy("camera_id").agg(at(A.resultant(F.col("deg")), 6).alias("r6")).join(A.largest_gap(b, ["camera_id"], "deg").select("camera_id", at(F.col("gap"), 3).alias("gap3")), "camera_id")


@query(
    sql(
        "observations",
        f""", r as (select bssid, rank() over (partition by bssid order by dbm) + (count(*) over (partition by bssid, dbm) - 1) / cast(2 as double) as x, rank() over (partition by bssid order by acc) + (count(*) over (partition by bssid, acc) - 1) / cast(2 as double) as y from observations)
        select bssid, {at_sql('corr(x, y)', 6)} as rho6 from r group by bssid""",
    )
)
def a26_spearman(spark, d):
    return A.spearman(observations(spark, d), ["bssid"], "dbm", "acc").select("bssid", at(F.col("rho"), 6).alias("rho6"))


@query(sql("observations", f"select bssid, {at_sql('sum(acc) * sum(acc) / sum(acc * acc)', 6)} as n6 from observations group by bssid"))
def a27_effective_size(spark, d):
    return observations(spark, d).groupBy("bssid").agg(at(A.kish(F.col("acc")), 6).alias("n6"))


@query(sql("passes", f"select camera_id, {at_sql('exp(sum(distance_m * ln(confidence)) / sum(distance_m))', 6)} as score6 from passes where distance_m > 0 group by camera_id"))
def a28_geometric_score(spark, d):
    return passes(spark, d).where("distance_m > 0").groupBy("camera_id").agg(at(A.geometric_score(F.col("confidence"), F.col("distance_m")), 6).alias("score6"))


@query(sql("observations", f"select bssid, {at_sql('var_samp(dbm)', 6)} as var6 from observations group by bssid"))
def a29_variance(spark, d):
    return observations(spark, d).groupBy("bssid").agg(at(F.var_samp("dbm"), 6).alias("var6"))


@query(
    sql(
        "tracks",
        f""", s as (select device, row_number() over w as k, sum(acc) over (w rows unbounded preceding) as s from tracks window w as (partition by device order by n) union all select distinct device, 0, cast(0 as double) from tracks),
        p as (select device, s, m, k + m as k1, k + 2 * m as k2 from s cross join (values (1), (2), (4), (8)) v(m)), t as (select p.device, m, (c.s - 2 * b.s + p.s) / m as d from p join s b on b.device = p.device and b.k = p.k1 join s c on c.device = p.device and c.k = p.k2)
        select device, m, {at_sql('sqrt(sum(d * d) / (2 * count(*)))', 6)} as dev6, count(*) as n from t group by device, m""",
    )
)
def a31_allan_deviation(spark, d):
    return A.allan_deviation(tracks(spark, d), ["device"], "n", "acc", 4).select("device", "m", at(F.col("deviation"), 6).alias("dev6"), "n")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(distinct user_id) as users from events group by 1")
def a32_by_day(spark, d):
    return read(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    sql(
        "tracks",
        f""", legs as (select device, t_ms, {hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as m, t_ms - lag(t_ms) over w as dt from tracks window w as (partition by device order by n))
        select device, count(*) as n_fixes, {at_sql('sum(m)', 2)} as length_cm, {at_sql('max(m)', 2)} as longest_cm, max(t_ms) - min(t_ms) as duration, {at_sql('max(m / dt * 1000)', 3)} as top_speed3, count(*) filter (dt > 300000) as stops from legs group by device""",
    )
)
def a33_trip_statistics(spark, d):
    w = Window.partitionBy("device").orderBy("n")
    m = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    legs = tracks(spark, d).select("device", "t_ms", m.alias("m"), (F.col("t_ms") - F.lag("t_ms").over(w)).alias("dt"))
    return legs.groupBy("device").agg(
        F.count("*").alias("n_fixes"), at(F.sum("m"), 2).alias("length_cm"), at(F.max("m"), 2).alias("longest_cm"), (F.max("t_ms") - F.min("t_ms")).alias("duration"), at(F.max(F.col("m") / F.col("dt") * 1000), 3).alias("top_speed3"), F.count_if(F.col("dt") > 300_000).alias("stops")
    )


@query("with steps(step, title) as (values (0, 'new'), (5, 'local'), (10, 'regular'), (14, 'veteran')) select k, (select title from steps where step <= n order by step desc limit 1) as title from (select o_custkey as k, count(*) as n from orders group by o_custkey)")
def a34_rank_ladder(spark, d):
    """The highest step that a count has reached."""
    steps = F.array(*(F.struct(F.lit(n).alias("at"), F.lit(t).alias("title")) for n, t in ((0, "new"), (5, "local"), (10, "regular"), (14, "veteran"))))
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return n.select("k", F.element_at(F.filter(steps, lambda s: s["at"] <= F.col("n")), -1)["title"].alias("title"))


@query("with m as (select bool_or(acctbal > 9900) as rich, max(acctbal) > 9999 as richest, count(*) >= 1000 as crowd from (select c_acctbal as acctbal from customer)) select 'rich' as name, rich as reached from m union all select 'richest', richest from m union all select 'crowd', crowd from m")
def a35_milestones(spark, d):
    m = read(spark, d, "customer").agg(F.bool_or(F.col("c_acctbal") > 9900).alias("rich"), (F.max("c_acctbal") > 9999).alias("richest"), (F.count("*") >= 1000).alias("crowd"))
    return m.unpivot([], ["rich", "richest", "crowd"], "name", "reached")


@query("select extract(hour from ts) as hour, event_type, count(*) as n from events group by 1, 2")
def a36_hourly_counts(spark, d):
    return read(spark, d, "events").groupBy(F.hour(F.col("ts").cast("timestamp")).cast("long").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query(
    sql(
        "observations",
        ", s as (select device, t_ms // 432000000 as k, list_sort(list_distinct(list(bssid))) as heard from observations group by 1, 2), p as (select *, lag(heard) over (partition by device order by k) as before from s) select device, k, 2 * len(list_intersect(heard, before)) < len(list_distinct(list_concat(heard, before))) as changed from p where before is not null",
    )
)
def a37_neighbourhood_changed(spark, d):
    """Whether a scan has less than half of all transmitters in common with the one before."""
    s = observations(spark, d).groupBy("device", F.floor(F.col("t_ms") / 432_000_000).alias("k")).agg(F.collect_set("bssid").alias("heard"))
    s = s.withColumn("before", F.lag("heard").over(Window.partitionBy("device").orderBy("k"))).where("before is not null")
    return s.select("device", "k", (2 * F.size(F.array_intersect("heard", "before")) < F.size(F.array_union("heard", "before"))).alias("changed"))


@query(sql("observations", ", s as (select device, bssid, max(dbm) + 100 as w from observations group by 1, 2), a as (select * from s where device = 'dev1'), b as (select * from s where device <> 'dev1') select d as device, sum(least(coalesce(wa, 0), coalesce(wb, 0))) as low, sum(greatest(coalesce(wa, 0), coalesce(wb, 0))) as high from (select k.device as d, x.bssid, a.w as wa, b.w as wb from (select distinct device from b) k cross join (select distinct bssid from s) x left join a on a.bssid = x.bssid left join b on b.bssid = x.bssid and b.device = k.device) group by d"))
def a38_signature_similarity(spark, d):
    """Weighted overlap of what two devices hear, as its two sums."""
    s = observations(spark, d).groupBy("device", "bssid").agg((F.max("dbm") + 100).alias("w"))
    own, other = s.where("device = 'dev1'").select("bssid", F.col("w").alias("a")), s.where("device <> 'dev1'")
    total = own.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("total"))
    met = other.join(own, "bssid", "left").withColumn("a", F.coalesce("a", F.lit(0)))
    sums = met.groupBy("device").agg(F.sum(F.least("a", "w")).alias("low"), F.sum(F.greatest("a", "w")).alias("top"), F.sum("a").alias("met"))
    return sums.crossJoin(F.broadcast(total)).select("device", "low", (F.col("top") + F.col("total") - F.col("met")).alias("high"))


@query("select max(event_id) as last_id, min(user_id) as low from events")
def a39_scalars(spark, d):
    return read(spark, d, "events").agg(F.max("event_id").alias("last_id"), F.min("user_id").alias("low"))


@query("select exists (select 1 from orders where o_totalprice > 400000) as found")
def a40_exists(spark, d):
    return read(spark, d, "orders").where("o_totalprice > 400000").limit(1).agg((F.count("*") > 0).alias("found"))


@query("select coalesce(event_type, 'all') as event_type, case when grouping(d) = 1 then null else d end as day, count(*) as n from (select event_type, strftime(ts, '%Y-%m-%d') as d from events) group by grouping sets ((event_type, d), (event_type), ())")
def a42_grouping_sets(spark, d):
    """Counts by kind and day, by kind, and in all, in one pass."""
    e = read(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.rollup("event_type", "day").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "day", "n")
