"""Smaller operators: flags of a fit, levels, plates, presence, sync and the rules of the light locator."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, plates
from ..functions.text import folded_plate
from ..operators import aggregates as A
from ..operators import folds, locate
from ..operators import windows as N
from ..sources.views import cams, fixes, observations, passes, read, sql, tracks
from .catalog import query
from .common import at, at_sql, hav_sql

_LETTER = "case when {s} >= 90 then 'A' when {s} >= 75 then 'B' when {s} >= 60 then 'C' when {s} >= 40 then 'D' else 'F' end"
_LOWER = "case {l} when 'A' then 90 when 'B' then 75 when 'C' then 60 when 'D' then 40 else 0 end"


@query(
    f"""with s as (select p_partkey, cast((p_partkey * 37) % 101 as double) as score, {_LETTER.format(s='((p_partkey * 53) % 101)')} as prev, case when p_partkey % 3 = 0 then {_LETTER.format(s='((p_partkey * 37) % 101)')} end as pending from part),
    r as (select *, {_LETTER.format(s='score')} as raw from s), b as (select *, {_LOWER.format(l='raw')} as lr, {_LOWER.format(l='prev')} as lp from r),
    c as (select *, raw <> prev and not (case when lr > lp then score >= lr + 3 else score <= lp - 3 end) and pending is distinct from raw as holds from b)
    select p_partkey, case when holds then prev else raw end as letter, case when holds then raw end as pending from c"""
)
def n13_letter_hysteresis(spark, d):
    """A letter changes only if the score is three points beyond the border, or the change was pending before."""
    k = F.col("p_partkey")
    letter = lambda s: F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("F")
    lower = lambda c: F.when(c == "A", 90).when(c == "B", 75).when(c == "C", 60).when(c == "D", 40).otherwise(0)
    s = read(spark, d, "part").select(k, ((k * 37) % 101).cast("double").alias("score"), letter((k * 53) % 101).alias("prev"), F.when(k % 3 == 0, letter((k * 37) % 101)).alias("pending"))
    s = s.withColumn("raw", letter(F.col("score")))
    clear = F.when(lower(F.col("raw")) > lower(F.col("prev")), F.col("score") >= lower(F.col("raw")) + 3).otherwise(F.col("score") <= lower(F.col("prev")) - 3)
    holds = (F.col("raw") != F.col("prev")) & ~clear & ~F.col("pending").eqNullSafe(F.col("raw"))
    return s.select("p_partkey", F.when(holds, F.col("prev")).otherwise(F.col("raw")).alias("letter"), F.when(holds, F.col("raw")).alias("pending"))


@query(
    sql(
        "observations",
        f""", p as (select bssid, pow(cast(10 as double), dbm / cast(10 as double)) as x, t_ms, event_id from observations), q as (select bssid, quantile_cont(x, 0.95) as top, count(*) as n, (max(t_ms) - min(t_ms)) / cast(1000 as double) as span, count(distinct event_id % 3) as channels from p group by bssid)
        select bssid, {at_sql('10 * log10(avg(case when n >= 8 then least(x, top) else x end) / max(case when n >= 8 then cast(0.95 as double) else cast(1 as double) end))', 6)} as dbm6,
        {at_sql('max(least(cast(n as double), channels * (1 + span / 30)))', 3)} as neff3 from p join q using (bssid) group by bssid""",
    )
)
def t30_level(spark, d):
    """The level of fading samples and how many independent ones they are: channels times coherence times."""
    o = observations(spark, d)
    level = A.power_mean(o, ["bssid"], "dbm").select("bssid", "level")
    facts = o.groupBy("bssid").agg(F.count("*").alias("n"), ((F.max("t_ms") - F.min("t_ms")) / 1000.0).alias("span"), F.count_distinct(F.col("event_id") % 3).alias("channels"))
    neff = F.least(F.col("n").cast("double"), F.col("channels") * (1 + F.col("span") / 30))
    return level.join(facts, "bssid").select("bssid", at(F.col("level"), 6).alias("dbm6"), at(neff, 3).alias("neff3"))


@query("select c_custkey, translate(regexp_replace(upper(c_name || ' 0-1b'), '[^A-Z0-9]', '', 'g'), 'OIBSZG', '018526') as folded from customer")
def s33_plate_fold(spark, d):
    """A plate as letters and digits, with what looks alike made the same."""
    return read(spark, d, "customer").select("c_custkey", folded_plate(F.concat("c_name", F.lit(" 0-1b"))).alias("folded"))


_SHAPES = "(values " + ", ".join(f"('{s}', '{p}')" for s, p in plates.FORMATS) + ") f(state, shape)"


@query(
    f"""with p as (select c_custkey, case c_custkey % 5 when 0 then 'ABC' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') when 1 then 'AB' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') when 2 then '1ABC' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') when 3 then 'ABCDEFGHIJ' else 'A' || (c_custkey % 100) end as plate, case c_custkey % 3 when 0 then 'PA' when 1 then 'CA' end as state from customer),
    g as (select *, translate(plate, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', repeat('L', 26) || repeat('D', 10)) as shape from p),
    m as (select g.*, exists (select 1 from {_SHAPES} where f.shape = g.shape and f.state = g.state) as own, exists (select 1 from {_SHAPES} where f.shape = g.shape) as any_ from g)
    select c_custkey, case when own then 'state' when any_ then 'us' else 'none' end as fit, case when length(plate) < 5 or length(plate) > 8 then false when length(plate) < 7 then true else any_ or length(plate) < 8 end as passes from m"""
)
def s34_plate_formats(spark, d):
    """Whether a plate has a format of its state or of any, and whether it counts at all."""
    k = F.col("c_custkey")
    four, three = F.lpad((k % 10000).cast("string"), 4, "0"), F.lpad((k % 1000).cast("string"), 3, "0")
    plate = F.when(k % 5 == 0, F.concat(F.lit("ABC"), four)).when(k % 5 == 1, F.concat(F.lit("AB"), four)).when(k % 5 == 2, F.concat(F.lit("1ABC"), three)).when(k % 5 == 3, "ABCDEFGHIJ").otherwise(F.concat(F.lit("A"), (k % 100).cast("string")))
    p = read(spark, d, "customer").select("c_custkey", plate.alias("plate"), F.when(k % 3 == 0, "PA").when(k % 3 == 1, "CA").alias("state"))
    return p.select("c_custkey", plates.format_fit(F.col("plate"), F.col("state")).alias("fit"), plates.counts_as_plate(F.col("plate")).alias("passes"))


@query()
def k07_best_strings(spark, d):
    """The likeliest strings of a lattice of three choices for each of five characters."""
    k = F.col("p_partkey")
    slot = lambda j: F.array(*(F.struct(F.lit("ABC"[c]).alias("char"), (((k * (7 + j) + c * 31) % 97 + 1) / 98.0).alias("p")) for c in range(3)))
    rows = read(spark, d, "part").select("p_partkey", F.array(*map(slot, range(5))).alias("slots"))
    # the strings cost much more than the bytes that a file is split by
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select("p_partkey", F.array_join(F.transform(plates.likeliest("slots", 16), lambda x: x["text"]), ",").alias("best"))


@query()
def t24_hotlist(spark, d):
    """Reads against a list of plates: the text itself, else the likeliest other readings; own plates never, expired ones no more."""
    p = passes(spark, d).select("uid", "plate", "confidence", "t_ms")
    wanted = read(spark, d, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("wanted"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(0).cast("long")).alias("expires_ms"))
    own = read(spark, d, "nation").select(F.concat(F.lit("P"), (F.col("n_nationkey") * 9).cast("string")).alias("own"))
    return plates.hotlist(p, wanted, own, "uid", "plate", (F.col("confidence") / 100.0), F.lit(1)).select("uid", "wanted", "kind", at(F.col("ratio"), 6).alias("ratio6"))


@query(
    f"""with t as (select p_partkey, case when p_type = 'LARGE' then 'hospital' when p_type = 'SMALL' then 'clinic' else 'other' end as amenity, p_name like '%blue%' as peds, p_size % 3 = 0 as er, p_size % 3 = 1 as no_er, p_partkey % 4 = 0 as urgent, p_partkey % 5 = 0 as general, p_partkey % 7 = 0 as always from part)
    select p_partkey, case when amenity = 'hospital' and peds and not general and not no_er then case when er then 1 else 2 end when amenity = 'hospital' and peds and general and er then 3 when amenity = 'clinic' and peds and urgent then 4 else 0 end as tier,
    case when amenity = 'hospital' and peds and not general and no_er then 'children, no ER' when amenity = 'hospital' and peds and not general and er then 'pediatric ER' when amenity = 'hospital' and peds and not general then case when always then 'likely ER' else 'not confirmed' end when amenity = 'hospital' and peds and general and er then 'ER with pediatrics' when amenity = 'clinic' and peds and urgent then 'not an ER' end as detail from t"""
)
def s43_pediatric_tiers(spark, d):
    """Five ordered rules: a children's hospital with or without a confirmed ER, a general ER with pediatrics, urgent care, all else."""
    c = F.col
    t = read(spark, d, "part").select("p_partkey", (c("p_type") == "LARGE").alias("hospital"), (c("p_type") == "SMALL").alias("clinic"), c("p_name").contains("blue").alias("peds"), (c("p_size") % 3 == 0).alias("er"), (c("p_size") % 3 == 1).alias("no_er"), (c("p_partkey") % 4 == 0).alias("urgent"), (c("p_partkey") % 5 == 0).alias("general"), (c("p_partkey") % 7 == 0).alias("always"))
    tier, detail = _tiers(c)
    return t.select("p_partkey", tier.alias("tier"), detail.alias("detail"))


def _tiers(c):
    """(tier, detail) of a place from its tags as booleans: hospital, clinic, peds, er, no_er, urgent, general, always."""
    childrens = c("hospital") & c("peds") & ~c("general")
    both = c("hospital") & c("peds") & c("general") & c("er")
    urgent = c("clinic") & c("peds") & c("urgent")
    tier = F.when(childrens & ~c("no_er"), F.when(c("er"), 1).otherwise(2)).when(both, 3).when(urgent, 4).otherwise(0)
    detail = F.when(childrens & c("no_er"), "children, no ER").when(childrens & c("er"), "pediatric ER").when(childrens, F.when(c("always"), "likely ER").otherwise("not confirmed")).when(both, "ER with pediatrics").when(urgent, "not an ER")
    return tier, detail


@query(sql("fixes", "select device, max(t_ms) as last_ms, case when (select max(t_ms) from fixes) - max(t_ms) <= 120000 then 'online' when (select max(t_ms) from fixes) - max(t_ms) < 600000 then 'stale' else 'offline' end as state from fixes group by device"))
def st10_presence(spark, d):
    """Devices by how long they have been silent, at the time of the newest fix of all."""
    f = fixes(spark, d)
    last = f.groupBy("device").agg(F.max("t_ms").alias("last_ms"))
    silent = F.col("now") - F.col("last_ms")
    return last.crossJoin(F.broadcast(last.agg(F.max("last_ms").alias("now")))).select("device", "last_ms", F.when(silent <= 120_000, "online").when(silent < 600_000, "stale").otherwise("offline").alias("state"))


@query(sql("fixes", "select * from (select 'push' as way, event_id, t_ms from fixes where device = 'dev3' and event_id > 500 union all select 'pull', event_id, t_ms from fixes where device <> 'dev3' and event_id > 700)"))
def st08_two_way_sync(spark, d):
    """What a device sends since its own cursor and what it gets since the other's; its own rows don't come back."""
    f = fixes(spark, d).select("device", "event_id", "t_ms")
    push = f.where("device = 'dev3' and event_id > 500").select(F.lit("push").alias("way"), "event_id", "t_ms")
    return push.union(f.where("device <> 'dev3' and event_id > 700").select(F.lit("pull").alias("way"), "event_id", "t_ms"))


@query("with s as (select 'orders' as source, o_orderkey as seq, o_custkey as k from orders union all select 'customer', c_custkey, c_nationkey from customer) select source, seq, k from s where seq > 100 and seq <= (select min(m) from (select source, max(seq) as m from s group by source))")
def st07_change_feed(spark, d):
    """Changes of several tables after a cursor, up to the sequence that all of them have reached."""
    s = read(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("k")).union(read(spark, d, "customer").select(F.lit("customer"), "c_custkey", "c_nationkey"))
    safe = s.groupBy("source").agg(F.max("seq").alias("m")).agg(F.min("m").alias("safe"))
    return s.crossJoin(F.broadcast(safe)).where("seq > 100 and seq <= safe").select("source", "seq", "k")


@query("with r as (select l_orderkey as job, max(l_partkey) as mark from lineitem group by l_orderkey), w as (select o_orderkey as job, o_custkey as watermark from orders) select w.job, mark, case when mark is null then 'queued' when mark < watermark then 'requeued' else 'done' end as state from w left join r using (job)")
def st14_stale_results(spark, d):
    """A result that is older than its job's watermark is stored, and the job is queued again."""
    r = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.max("l_partkey").alias("mark"))
    w = read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("watermark"))
    state = F.when(F.col("mark").isNull(), "queued").when(F.col("mark") < F.col("watermark"), "requeued").otherwise("done")
    return w.join(r, "job", "left").select("job", "mark", state.alias("state"))


@query(
    sql(
        "tracks",
        f""", m as (select *, case when {hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} > 33 or t_ms - lag(t_ms) over w > 600000 then 1 else 0 end as new from tracks window w as (partition by device order by n)),
        s as (select *, sum(new) over (partition by device order by n) as run from m), w as (select *, 1 / (acc * acc) as w from s)
        select device, run, count(*) as n, {at_sql('sum(w * lat) / sum(w)', 6)} as lat6, {at_sql('sum(w * lon) / sum(w)', 6)} as lon6, {at_sql('sqrt(1 / sum(w))', 4)} as sd4 from w group by device, run having count(*) >= 3""",
    )
)
def st15_static_sessions(spark, d):
    """Sessions that end with motion, and the mean of each by the inverse of the variances."""
    w = Window.partitionBy("device").orderBy("n")
    moved = (geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) > 33) | (F.col("t_ms") - F.lag("t_ms").over(w) > 600_000)
    s = N.with_runs(tracks(spark, d), ["device"], ["n"], moved).withColumn("w", 1 / (F.col("acc") * F.col("acc")))
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    g = s.groupBy("device", "run").agg(F.count("*").alias("n"), at(mean("lat"), 6).alias("lat6"), at(mean("lon"), 6).alias("lon6"), at(F.sqrt(1 / F.sum("w")), 4).alias("sd4"))
    return g.where("n >= 3")


@query(
    sql(
        "observations",
        f""", r as (select event_id // 20 as scan, bssid, max(greatest(1, dbm + 100)) as w, max(t_ms) as t from observations group by 1, 2), k as (select *, row_number() over (partition by scan order by w desc, bssid) as r from r), s as (select * from k where r <= 12),
        a as (select scan, max(t) as t, sum(w) as total from s group by scan), c as (select x.scan, sum(least(x.w, y.w)) as lo from s x join s y on y.scan = x.scan - 1 and y.bssid = x.bssid group by x.scan)
        select a.scan, {at_sql('coalesce(lo, 0) / cast(a.total + b.total - coalesce(lo, 0) as double)', 6)} as s6, coalesce(lo, 0) / cast(a.total + b.total - coalesce(lo, 0) as double) >= 0.02 and a.t - b.t < 864000000 as reuse from a join a b on b.scan = a.scan - 1 left join c on c.scan = a.scan""",
    )
)
def x11_reuse(spark, d):
    """Whether a scan is that of the last place: the weighted Jaccard similarity of the twelve strongest, and the age."""
    o = observations(spark, d).groupBy(F.floor(F.col("event_id") / 20).alias("scan"), "bssid").agg(F.max(F.greatest(F.lit(1), F.col("dbm") + 100)).alias("w"), F.max("t_ms").alias("t"))
    s = o.withColumn("r", F.row_number().over(Window.partitionBy("scan").orderBy(F.desc("w"), "bssid"))).where("r <= 12")
    total = s.groupBy("scan").agg(F.max("t").alias("t"), F.sum("w").alias("total"))
    before = s.select((F.col("scan") + 1).alias("scan"), "bssid", F.col("w").alias("v"))
    low = s.join(before, ["scan", "bssid"]).groupBy("scan").agg(F.sum(F.least("w", "v")).alias("lo"))
    b = total.select((F.col("scan") + 1).alias("scan"), F.col("t").alias("t0"), F.col("total").alias("total0"))
    both = total.join(b, "scan").join(low, "scan", "left").withColumn("lo", F.coalesce("lo", F.lit(0)))
    # the larger weights are both sums without the smaller ones
    same = F.col("lo") / (F.col("total") + F.col("total0") - F.col("lo")).cast("double")
    return both.select("scan", at(same, 6).alias("s6"), ((same >= 0.02) & (F.col("t") - F.col("t0") < 864_000_000)).alias("reuse"))


@query(
    sql(
        "tracks",
        f""", b as (select device, n, lag(lat) over w as la, lag(lon) over w as lo, lag(acc) over w as a0, lat, lon, acc, least(cast(0.5 as double), lag(acc) over w / (lag(acc) over w + acc)) as k from tracks window w as (partition by device order by n)),
        m as (select *, la + k * (lat - la) as y, lo + k * (lon - lo) as x from b where la is not null) select device, n, {at_sql('y', 7)} as lat7, {at_sql('x', 7)} as lon7, {hav_sql('la', 'lo', 'y', 'x')} > 5 or acc < a0 as write from m""",
    )
)
def x14_learned_place(spark, d):
    """A learned place drawn toward a new sighting, and whether that is worth a write."""
    w = Window.partitionBy("device").orderBy("n")
    t = tracks(spark, d).select("device", "n", "lat", "lon", "acc", *(F.lag(c).over(w).alias(f"{c}0") for c in ("lat", "lon", "acc"))).where("lat0 is not null")
    k = F.least(F.lit(0.5), F.col("acc0") / (F.col("acc0") + F.col("acc")))
    t = t.withColumns({"y": F.col("lat0") + k * (F.col("lat") - F.col("lat0")), "x": F.col("lon0") + k * (F.col("lon") - F.col("lon0"))})
    return t.select("device", "n", at(F.col("y"), 7).alias("lat7"), at(F.col("x"), 7).alias("lon7"), ((geo.haversine(F.col("lat0"), F.col("lon0"), F.col("y"), F.col("x")) > 5) | (F.col("acc") < F.col("acc0"))).alias("write"))


@query(
    sql(
        "tracks",
        f""", k as (select device, n, lat, lon, acc, case when acc > 24 then 'none' when acc < 14 then 'reuse' else 'fix' end as kind from tracks),
        p as (select *, last_value(case when kind <> 'none' then lat end ignore nulls) over w as y, last_value(case when kind <> 'none' then lon end ignore nulls) over w as x, last_value(case when kind <> 'none' then acc end ignore nulls) over w as a, sum(case when kind <> 'reuse' then 1 else 0 end) over (partition by device order by n) as run from k window w as (partition by device order by n rows between unbounded preceding and 1 preceding)),
        f as (select *, case when kind = 'fix' and {hav_sql('y', 'x', 'lat', 'lon')} > 500 + a + acc then 120000 else 900000 end as begin from p),
        g as (select device, n, first_value(begin) over w as begin, row_number() over w - case when run = 0 then 0 else 1 end as k from f window w as (partition by device, run order by n))
        select device, n, least(7200000, begin * cast(pow(2, least(k, 10)) as bigint)) as wait_ms from g""",
    )
)
def x15_polling_pace(spark, d):
    """How long to wait before the next look: twice as long as before at the same place, short when it moves."""
    t = tracks(spark, d).withColumn("kind", F.when(F.col("acc") > 24, "none").when(F.col("acc") < 14, "reuse").otherwise("fix"))
    w = Window.partitionBy("device").orderBy("n")
    heard = lambda c: F.last(F.when(F.col("kind") != "none", F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumns({"y": heard("lat"), "x": heard("lon"), "a": heard("acc"), "run": F.sum((F.col("kind") != "reuse").cast("int")).over(w)})
    moved = (F.col("kind") == "fix") & (geo.haversine(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")) > 500 + F.col("a") + F.col("acc"))
    own = Window.partitionBy("device", "run").orderBy("n")
    t = t.withColumn("begin", F.when(moved, 120_000).otherwise(900_000)).withColumns({"begin": F.first("begin").over(own), "k": F.row_number().over(own) - F.when(F.col("run") == 0, 0).otherwise(1)})
    return t.select("device", "n", F.least(F.lit(7_200_000), F.col("begin") * F.pow(F.lit(2), F.least(F.col("k"), F.lit(10))).cast("long")).alias("wait_ms"))


@query("select 'N' || lpad(cast(user_id % 7 as varchar), 2, '0') as node, max(epoch_us(ts) // 1000) as last_ms, arg_max(event_id, (epoch_us(ts), event_id)) as event_id from events where ('N' || lpad(cast(user_id % 7 as varchar), 2, '0')) like 'N0%' and user_id % 7 not in (5, 6) group by 1")
def x18_nodes_by_name(spark, d):
    """Nodes that are known by the beginning of their network's name, but for listed ones, with their last sighting."""
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("N"), F.lpad((F.col("user_id") % 7).cast("string"), 2, "0")).alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    mine = e.where(F.col("node").startswith("N0") & ~F.col("node").isin("N05", "N06"))
    return mine.groupBy("node").agg(F.floor(F.max("us") / 1000).alias("last_ms"), F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))


@query("select c_custkey, coalesce(case when c_nationkey % 4 = 0 then c_nationkey * 100 + 50 end, 240) as mah from customer")
def x19_capacity(spark, d):
    """The capacity that is known of a node, else that of the common one."""
    return read(spark, d, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_nationkey") % 4 == 0, F.col("c_nationkey") * 100 + 50), F.lit(240)).alias("mah"))


@query(
    """with f as (select p_partkey, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z ]', ' ', 'g'), ' '), lambda x: x <> '' and x <> 'part'))) as tokens, p_size, p_type from part)
    select array_to_string(tokens, ' ') as agency, count(*) as files, sum(p_size) as records, max(p_type) as latest from f where len(tokens) > 0 group by 1"""
)
def r15_source_statistics(spark, d):
    """Files of an audit source as one entry for each set of tokens of their names."""
    p = read(spark, d, "part")
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("p_name"), "[^a-z ]", " "), " "), lambda x: (x != "") & (x != "part"))))
    return p.withColumn("tokens", words).where(F.size("tokens") > 0).groupBy(F.array_join("tokens", " ").alias("agency")).agg(F.count("*").alias("files"), F.sum("p_size").alias("records"), F.max("p_type").alias("latest"))


@query(sql("tracks fixes", ", s as (select device, t_ms // 86400000 as day, 0 as rank, n as row_id from tracks union all select 't' || substr(device, 4), (t_ms % 9000000) // 86400000, 1, event_id from fixes), b as (select device, day, min(rank) as rank from s group by device, day) select device, day, rank, count(*) as n from s join b using (device, day, rank) group by all"))
def t40_journal_source(spark, d):
    """Each day of a device from the best source that has it: a track before single fixes."""
    t = tracks(spark, d).select("device", F.floor(F.col("t_ms") / 86_400_000).alias("day"), F.lit(0).alias("rank"))
    f = fixes(spark, d).select(F.concat(F.lit("t"), F.substring("device", 4, 99)).alias("device"), F.floor(F.col("t_ms") % 9_000_000 / 86_400_000).alias("day"), F.lit(1).alias("rank"))
    counts = t.union(f).groupBy("device", "day", "rank").agg(F.count("*").alias("n"))
    best = counts.groupBy("device", "day").agg(F.min(F.struct("rank", "n")).alias("b"))
    return best.select("device", "day", "b.rank", "b.n")


@query()
def a30_correlation_time(spark, d):
    """How many samples of a track's accuracy hang together, by an automatic window."""
    t = N.gap_runs(tracks(spark, d), ["device"], "t_ms", 600_000, "part")
    return A.correlation_time(t, ["device", "part"], "n", "acc").select("device", "part", at(F.col("tau"), 6).alias("tau6"), "converged")


@query()
def a21_vantage_points(spark, d):
    """Observations of a transmitter drawn together into places, greedily in their order."""
    v = folds.vantages(observations(spark, d), "bssid", "event_id")
    return v.select("bssid", "place", at(F.col("lat"), 6).alias("lat6"), at(F.col("lon"), 6).alias("lon6"), "acc", "n")


@query()
def t45_observation_sampling(spark, d):
    """Which observations of a transmitter are new samples: moved, much later, or of another device."""
    return folds.sampled(observations(spark, d), "bssid").select("bssid", "event_id")


@query()
def t28_trilateration(spark, d):
    """A place from ranges to anchors and a prior, by Gauss-Newton."""
    heard = observations(spark, d).withColumn("scan", F.floor(F.col("event_id") / 5)).join(cams(spark, d).select(F.col("id").alias("k"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), F.col("event_id") % 100 == F.col("k"))
    h = heard.select("scan", F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), (400.0 + F.col("dbm") * 3).alias("metres"), F.lit(20.0).alias("sd"))
    prior = h.groupBy("scan").agg(F.avg("lat").alias("p_lat"), F.avg("lon").alias("p_lon")).withColumn("p_sd", F.lit(500.0))
    return locate.trilaterated(h, prior, ["scan"]).select("scan", "n", at(F.col("lat"), 5).alias("lat5"), at(F.col("lon"), 5).alias("lon5"), at(F.col("acc"), 1).alias("acc1"))


@query()
def f14_route_lines(spark, d):
    """Lines of a route to draw: no spikes, no jumps, a new line after a gap, points no nearer than 20 m."""
    return folds.route_lines(tracks(spark, d), "device").select("device", "line", "n")
