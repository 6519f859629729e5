"""Passes from tracks to events: detection, views, merging with precedence, flags and backfill."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..operators import joins as J
from ..operators import merge as M
from ..operators import passes as P
from ..operators import windows as N
from ..sources.views import cams, passes, pois, read, sql, tracks
from .catalog import query
from .common import at, at_sql, bearing_sql, hav_sql


def _xy_sql(lat: str, lon: str, of: str = "c") -> tuple[str, str]:
    return f"(({lon}) - {of}.lon) * cast({geo.ARC!r} as double) * cos(radians({of}.lat))", f"(({lat}) - {of}.lat) * cast({geo.ARC!r} as double)"


def _plane_sql(x: str, y: str) -> str:
    return f"case when sqrt(({x}) * ({x}) + ({y}) * ({y})) >= 0.5 then fmod(degrees(atan2({x}, {y})) + cast(360 as double), cast(360 as double)) end"


_X0, _Y0 = _xy_sql("l.lat", "l.lon")
_X1, _Y1 = _xy_sql("l.lat2", "l.lon2")
_OWN_X, _OWN_Y = _xy_sql("l.lat + u * (l.lat2 - l.lat)", "l.lon + u * (l.lon2 - l.lon)", "t")
#: Legs of tracks in the frames of the assets that they pass, with the pass of each; a fix without a neighbour is a leg of its own.
_NEAR_SQL = f""", raw as (select device, n, t_ms as t0, lat, lon, acc, lead(t_ms) over w as t1, lead(lat) over w as lat2, lead(lon) over w as lon2, lead(acc) over w as acc2, lead(n) over w as n2 from tracks window w as (partition by device order by t_ms, n)),
 ok as (select *, coalesce(t1 - t0 <= 300000 and {hav_sql('lat', 'lon', 'lat2', 'lon2')} <= 1500, false) as goes from raw), held as (select *, coalesce(lag(goes) over (partition by device order by t0, n), false) as came from ok),
 l as (select device, n, n2 as last, t0, t1, lat, lon, acc, lat2, lon2, acc2 from held where goes union all select device, n, n, t0, t0, lat, lon, acc, lat, lon, acc from held where not goes and not came),
 f as (select l.device, c.id, c.lat as a_lat, c.lon as a_lon, l.n, l.last, l.t0, l.t1, l.lat, l.lon, l.lat2, l.lon2, l.acc, l.acc2, {_X0} as x0, {_Y0} as y0, {_X1} as x1, {_Y1} as y1 from l, cams c),
 g as (select *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as a, x0 * (x1 - x0) + y0 * (y1 - y0) as b from f),
 s as (select *, case when a > 0 then greatest(cast(0 as double), least(cast(1 as double), -b / a)) else cast(0 as double) end as u from g),
 d as (select *, sqrt((x0 + u * (x1 - x0)) * (x0 + u * (x1 - x0)) + (y0 + u * (y1 - y0)) * (y0 + u * (y1 - y0))) as m, sqrt(greatest(cast(0 as double), b * b - a * (x0 * x0 + y0 * y0 - 4225))) as root from s),
 k as (select *, case when n <> lag(last) over (partition by device, id order by n) then 1 else 0 end as new,
   (case when a > 0 then greatest(cast(0 as double), least(cast(1 as double), (-b + root) / a) - greatest(cast(0 as double), (-b - root) / a)) else cast(1 as double) end) * (t1 - t0) as inside from d where m <= 65),
 p as (select *, sum(new) over (partition by device, id order by n) as pass, sqrt(x0 * x0 + y0 * y0) as d0, sqrt(x1 * x1 + y1 * y1) as d1 from k)"""

_PASSES_SQL = f"""{_NEAR_SQL}, q as (select *, row_number() over (partition by device, id, pass order by floor(m * 1e6 + 0.5), n) as r from p),
 w as (select device, id, pass, min(t0) as start_ms, max(t1) as end_ms, min(m) as metres, sum(inside) as dwell, count(*) filter (d0 <= 65) + arg_max(case when d1 <= 65 and last > n then 1 else 0 end, n) as n_fixes, arg_min(d0, n) as enter, arg_max(d1, n) as gone from p group by device, id, pass),
 c as (select w.*, a_lat, a_lon, q.t0 + cast(floor(u * (q.t1 - q.t0) + 0.5) as bigint) as c_ms, q.lat + u * (lat2 - q.lat) as c_lat, q.lon + u * (lon2 - q.lon) as c_lon, acc + u * (acc2 - acc) as c_acc,
   case when q.t1 > q.t0 then {hav_sql('q.lat', 'q.lon', 'lat2', 'lon2')} / ((q.t1 - q.t0) / cast(1000 as double)) * 3.6 end as speed, case when {hav_sql('q.lat', 'q.lon', 'lat2', 'lon2')} >= 3 then {bearing_sql('q.lat', 'q.lon', 'lat2', 'lon2')} end as heading,
   x0 + u * (x1 - x0) as cx, y0 + u * (y1 - y0) as cy, case when q.t1 > q.t0 then (x1 - x0) / ((q.t1 - q.t0) / cast(1000 as double)) else 0 end as vx, case when q.t1 > q.t0 then (y1 - y0) / ((q.t1 - q.t0) / cast(1000 as double)) else 0 end as vy
   from w join q using (device, id, pass) where r = 1),
 ask as (select device, id, pass, a_lat as lat, a_lon as lon, c_ms + side * 10000 as ms, side from c, (values (-1), (1)) v(side)),
 own as (select t.device, t.id, t.pass, side, t.lat, t.lon, arg_min(struct_pack(x := {_OWN_X}, y := {_OWN_Y}), l.n) as o from ask t join (select *, 0 as z from l) l on l.device = t.device and l.last > l.n and l.t0 <= t.ms and l.t1 >= t.ms,
   lateral (select case when l.t1 > l.t0 then (t.ms - l.t0) / cast(l.t1 - l.t0 as double) else cast(0 as double) end as u) group by t.device, t.id, t.pass, side, t.lat, t.lon),
 z as (select c.*, coalesce({_plane_sql('cx', 'cy')}, 0) as approach, coalesce(f.o.x, cx - 10 * vx) as fx, coalesce(f.o.y, cy - 10 * vy) as fy, coalesce(r.o.x, cx + 10 * vx) as rx, coalesce(r.o.y, cy + 10 * vy) as ry
   from c left join own f on f.device = c.device and f.id = c.id and f.pass = c.pass and f.side = -1 left join own r on r.device = c.device and r.id = c.id and r.pass = c.pass and r.side = 1)"""


def _assets(spark, d):
    """Every fourth asset has no direction, every fourth has two; every second one is of a make whose view is known."""
    c = cams(spark, d)
    dirs = F.when(F.col("id") % 4 == 0, F.array().cast("array<double>")).when(F.col("id") % 4 == 1, F.array(F.col("dir"), (F.col("dir") + 130) % 360).cast("array<double>")).otherwise(F.array("dir").cast("array<double>"))
    wide = F.col("id") % 2 == 0
    return c.select("id", "lat", "lon", dirs.alias("dirs"), *(F.when(wide, a).otherwise(b).alias(c) for c, a, b in (("half", 7.0, 12.5), ("least_m", 15.0, 5.0), ("most_m", 76.0, 35.0))))


def _near(spark, d):
    return P.with_pass(P.near_legs(P.legs(tracks(spark, d)), _assets(spark, d)))


@query(
    sql(
        "tracks cams",
        f"""{_PASSES_SQL} select device, id, pass, start_ms, end_ms, c_ms, {at_sql('metres')} as mm, {at_sql('dwell', 0)} as dwell_ms, n_fixes, {at_sql('enter')} as enter_mm, {at_sql('gone')} as exit_mm, {at_sql('c_lat', 7)} as lat7, {at_sql('c_lon', 7)} as lon7, {at_sql('c_acc')} as acc_mm,
        {at_sql('speed', 2)} as speed2, {at_sql('heading', 2)} as heading2, {at_sql('approach', 2)} as approach2, {at_sql(f"coalesce({_plane_sql('fx', 'fy')}, approach)", 2)} as front2, {at_sql(f"coalesce({_plane_sql('rx', 'ry')}, approach)", 2)} as rear2 from z""",
    )
)
def t04_passes(spark, d):
    """Runs of legs within 65 m of an asset: closest approach by projection with speed, course and bearings, dwell by clipping with the circle, ends."""
    own = P.legs(tracks(spark, d))
    p = P.with_bearings(P.passes_of(_near(spark, d)), own)
    numbers = {"mm": ("metres", 3), "dwell_ms": ("dwell_ms", 0), "enter_mm": ("enter_m", 3), "exit_mm": ("exit_m", 3), "lat7": ("c_lat", 7), "lon7": ("c_lon", 7), "acc_mm": ("c_acc", 3), "speed2": ("speed_kmh", 2), "heading2": ("heading", 2), "approach2": ("approach", 2), "front2": ("front", 2), "rear2": ("rear", 2)}
    return p.select("device", "id", "pass", "start_ms", "end_ms", "c_ms", "n_fixes", *(at(F.col(c), k).alias(a) for a, (c, k) in numbers.items()))


@query(sql("tracks cams", f"""{_NEAR_SQL}, w as (select device, max(t_ms) as now from tracks group by device) select p.device, id, pass, case when max(now) - max(t1) > 300000 then 'final' else 'open' end as state from p join w on w.device = p.device group by p.device, id, pass"""))
def st03_finalised_passes(spark, d):
    """Passes that no later fix can prolong any more, by the time of the device's newest fix."""
    newest = tracks(spark, d).groupBy("device").agg(F.max("t_ms").alias("now"))
    p = P.passes_of(_near(spark, d)).join(newest, "device")
    return p.select("device", "id", "pass", F.when(F.col("now") - F.col("end_ms") > 300_000, "final").otherwise("open").alias("state"))


@query()
def t04b_views(spark, d):
    """The chance that an asset, of any number of directions, had the device in view at a pass, over the error of the fixes."""
    v = P.views(_near(spark, d))
    return v.select("device", "id", "pass", at(F.col("in_view_s"), 3).alias("ms"), "front", "rear", "facing", "camera_dir", at(F.col("p_view"), 6).alias("view6"), at(F.col("p_read"), 6).alias("read6"))


def _events(spark, d):
    """Every third pass of an asset is old, the others come in; of those every fifth has the uid of a new one before it, by way of an alias of an alias."""
    p = passes(spark, d)
    rank = F.when(F.col("distance_m") < 20, 2).when(F.col("distance_m") < 40, 1).otherwise(0)
    k = F.crc32("uid")
    ev = p.select("uid", "camera_id", "t_ms", rank.alias("source_rank"), "confidence", F.when(F.col("confidence") % 3 == 0, F.col("plate")).alias("note"), (k % 3 == 0).alias("old"), (k % 15 == 1).alias("other"))
    renamed = F.concat(F.lit("again:"), F.col("uid"))
    old = ev.where("old").drop("old", "other")
    # the first old event of each asset is known by two more names, one the alias of the other
    first = old.groupBy("camera_id").agg(F.min(F.struct("t_ms", "uid"))["uid"].alias("uid"))
    aliases = first.select(F.concat(F.lit("alias:"), F.col("camera_id").cast("string")).alias("uid"), F.col("uid").alias("target")).union(first.select(F.concat(F.lit("more:"), F.col("camera_id").cast("string")), F.concat(F.lit("alias:"), F.col("camera_id").cast("string"))))
    one = ev.where("other").groupBy("camera_id").agg(F.min("uid").alias("uid"), F.lit(True).alias("named"))
    new = ev.where("not old").join(one, ["camera_id", "uid"], "left").withColumn("uid", F.when(F.col("named"), F.concat(F.lit("more:"), F.col("camera_id").cast("string"))).when(F.col("other"), renamed).otherwise(F.col("uid")))
    return M.merge_events(old, new.drop("old", "other", "named"), aliases)


@query()
def w06_event_merge(spark, d):
    """New events merged one by one into those of the same asset within ten minutes, or of the same uid; the better source gives the numbers."""
    return _events(spark, d)[0]


@query()
def w06b_event_aliases(spark, d):
    """The uids that were merged away, and where they went."""
    return _events(spark, d)[1]


#: Agencies as token sets, from the names and types of parts; each asset's operator is a nation's name.
_LEAKY_SQL = """, ag as (select p_partkey as agency, list_distinct(string_split(lower(p_name), ' ')) as tokens from part),
 op as (select s_suppkey as camera_id, list_distinct(string_split(lower(p_name), ' '))[1:2] as want from supplier join part on p_partkey = s_suppkey + 1),
 hit as (select camera_id, min(agency) as agency from op join ag on list_has_all(tokens, want) and len(want) > 0 group by camera_id)"""


@query(sql("passes", f"{_LEAKY_SQL}, e as (select p.uid, p.confidence % 2 as leaky, cast(0 as bigint) as seq, case when h.agency is null then 0 else 1 end as now from passes p left join hit h on h.camera_id = p.camera_id) select uid, now as leaky, case when leaky <> now then 1000 + row_number() over (partition by leaky <> now order by uid) - 1 else seq end as seq from e"))
def t21_leaky_flags(spark, d):
    """Passes whose operator is among the agencies that share: only those that change are written and get a number."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    part = read(spark, d, "part").select("p_partkey", words(F.col("p_name")).alias("tokens"))
    operators = read(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey") + 1).select(F.col("s_suppkey").alias("camera_id"), F.slice("tokens", 1, 2).alias("tokens"))
    hit = J.with_superset(operators, part).select("camera_id").distinct().withColumn("hit", F.lit(1))
    p = passes(spark, d).select("uid", "camera_id", (F.col("confidence") % 2).alias("leaky"), F.lit(0).cast("long").alias("seq"))
    # the flag hangs on the asset alone, so no pass is looked up by its uid
    now = p.join(hit, "camera_id", "left").select("uid", "leaky", "seq", F.coalesce("hit", F.lit(0)).alias("now"))
    return M.changed_in_place(now, "uid", {"leaky": F.col("now")}, "seq", 1000).drop("now")


@query(
    sql(
        "tracks",
        """, c as (select device, t_ms - 1800000 as low, t_ms + 1800000 as high from tracks where n % 37 = 0), m as (select *, max(high) over (partition by device order by low, high rows between unbounded preceding and 1 preceding) as reach from c),
        r as (select *, sum(case when low > reach then 1 else 0 end) over (partition by device order by low, high) as run from m), g as (select device, min(low) as low, max(high) as high from r group by device, run),
        k as (select device, low, high, unnest(range(cast(floor(low / cast(86400000 as double)) as bigint), cast(floor(high / cast(86400000 as double)) as bigint) + 1)) as day from g)
        select device, day, greatest(low, day * 86400000) as from_ms, least(high, (day + 1) * 86400000) as to_ms from k where greatest(low, day * 86400000) < least(high, (day + 1) * 86400000)""",
    )
)
def st06_backfill_chunks(spark, d):
    """What changed since the watermark as ranges of half an hour around, merged, and cut into days that own their part of a range."""
    day = 86_400_000
    changed = tracks(spark, d).where("n % 37 = 0").select("device", (F.col("t_ms") - 1_800_000).alias("low"), (F.col("t_ms") + 1_800_000).alias("high"))
    ranges = N.merged_intervals(changed, ["device"], "low", "high")
    days = ranges.withColumn("day", F.explode(F.sequence(F.floor(F.col("low") / day), F.floor(F.col("high") / day))))
    own = days.select("device", "day", F.greatest("low", F.col("day") * day).alias("from_ms"), F.least("high", (F.col("day") + 1) * day).alias("to_ms"))
    return own.where("from_ms < to_ms")


@query(sql("tracks cams", f"{_PASSES_SQL} select device, id, start_ms, end_ms, c_ms, {at_sql('metres')} as mm, {at_sql('dwell', 0)} as dwell_ms from z"))
def st06b_backfilled_passes(spark, d):
    """Tracks whose every tenth stretch was uploaded after the passes had been detected: what is around it is detected again, and the whole is as if all had been there."""
    seq = (F.floor(F.col("n") / 50) * 7919 + F.substring("device", 2, 9).cast("long")) % 1000 * 1000 + F.col("n") % 50
    t, a = tracks(spark, d).withColumn("seq", seq), _assets(spark, d)
    through = 900_000
    old = P.passes_of(P.with_pass(P.near_legs(P.legs(t.where(F.col("seq") < through)), a)))
    new = P.backfilled(old, t.drop("seq"), t.where(F.col("seq") >= through).select("device", "t_ms"), a)
    return new.select("device", "id", "start_ms", "end_ms", "c_ms", at(F.col("metres")).alias("mm"), at(F.col("dwell_ms"), 0).alias("dwell_ms"))


#: An area to stay away from: its corners (longitude, latitude), the first again at the end.
_RING = ((-74.9981234, 40.0041234), (-74.9851234, 40.0041234), (-74.9851234, 40.0201234), (-74.9981234, 40.0201234), (-74.9981234, 40.0041234))


@query(
    sql(
        "tracks",
        f""", raw as (select device, n, t_ms, lat, lon, lead(lat) over w as lat2, lead(lon) over w as lon2 from tracks window w as (partition by device order by n)),
        l as (select *, greatest(cast(1 as bigint), cast(ceil({hav_sql('lat', 'lon', 'lat2', 'lon2')} / 5) as bigint)) as many from raw where lat2 is not null),
        s as (select device, n, many, unnest(range(many)) as k, lat, lon, lat2, lon2 from l),
        i as (select device, n, k, lat + (lat2 - lat) * k / many as y, lon + (lon2 - lon) * k / many as x, 1.0 as one from s),
        j as (select *, y > 40.0041234 and y < 40.0201234 and x > -74.9981234 and x < -74.9851234 as inside from i),
        r as (select *, sum(case when inside and not coalesce(lag_in, false) then 1 else 0 end) over (partition by device order by n, k) as run from (select *, lag(inside) over (partition by device order by n, k) as lag_in from j))
        select device, run, min(n) as first_leg, max(n) as last_leg, count(*) as n_samples from r where inside group by device, run""",
    )
)
def t26_exposures(spark, d):
    """A route sampled every 5 m: the stretches of it that lie in an area, each from its first to its last leg."""
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING))
    w = Window.partitionBy("device").orderBy("n")
    legs = tracks(spark, d).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")
    many = F.greatest(F.lit(1), F.ceil(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / 5))
    s = legs.withColumn("many", many).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    y, x = F.col("lat") + (F.col("lat2") - F.col("lat")) * F.col("k") / F.col("many"), F.col("lon") + (F.col("lon2") - F.col("lon")) * F.col("k") / F.col("many")
    s = s.select("device", "n", "k", geo.in_ring(x, y, ring).alias("inside"))
    begins = F.col("inside") & ~F.coalesce(F.lag("inside").over(Window.partitionBy("device").orderBy("n", "k")), F.lit(False))
    runs = N.with_runs(s, ["device"], ["n", "k"], begins).where("inside")
    return runs.groupBy("device", "run").agg(F.min("n").alias("first_leg"), F.max("n").alias("last_leg"), F.count("*").alias("n_samples"))


_SCORE_SQL = "(case when size > 25 then 4 else 0 end) + (case when id % 3 = 0 then 2 else 0 end) + (case when id % 2 = 0 then 1 else 0 end)"


@query(
    sql(
        "pois",
        f""", q as (select id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as key, lat, lon, {_SCORE_SQL} as score, case when id % 2 = 0 then 'p' || id end as phone from (select id, lat, lon, size, substr(name, 1, 6) as name from pois)),
        better as (select a.id, count(*) as n from q a join q b on a.key = b.key and a.id <> b.id and {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500 and (b.score > a.score or (b.score = a.score and b.id < a.id)) group by a.id),
        kept as (select q.* from q left join better using (id) where n is null),
        near as (select k.id, min(b.phone) as other from kept k join q b on b.key = k.key and b.id <> k.id and {hav_sql('k.lat', 'k.lon', 'b.lat', 'b.lon')} <= 500 group by k.id)
        select k.id, coalesce(k.phone, near.other) as phone from kept k left join near using (id)""",
    )
)
def j18_same_place(spark, d):
    """Places of the same name within 500 m are one: that with no better one near; it takes over a phone that another has."""
    score = F.when(F.col("size") > 25, 4).otherwise(0) + F.when(F.col("id") % 3 == 0, 2).otherwise(0) + F.when(F.col("id") % 2 == 0, 1).otherwise(0)
    key = F.regexp_replace(F.lower(F.substring("name", 1, 6)), "[^a-z0-9]", "")
    q = pois(spark, d).select("id", key.alias("key"), "lat", "lon", score.alias("score"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("phone"))
    return M.one_of_each_place(q, 500.0).select("id", "phone")
