"""Domain views over the sample tables: radio observations, GPS fixes, assets, places and tracks.

The sample tables have no positions. Each view derives them by integer arithmetic on keys, then casts to double, so that any SQL
engine gets the same rows; ``SQL`` has the same views as common table expressions for one that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _place(low: float, key: Column, times: int, modulus: int) -> Column:
    return F.lit(low) + ((key * times) % modulus).cast("double") / F.lit(float(modulus)) * F.lit(0.02)


def _place_sql(low: float, key: str, times: int, modulus: int) -> str:
    return f"cast({low} as double) + cast((({key}) * {times}) % {modulus} as double) / cast({modulus} as double) * cast(0.02 as double)"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, device, t_ms, source, lat, lon, acc: a device's positions over time."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("dev"), (F.col("user_id") % 8).cast("string")).alias("device"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("t_ms"),
        F.col("event_type").alias("source"),
        _place(40.0, F.col("event_id"), 7919, 10007).alias("lat"),
        _place(-75.0, F.col("event_id"), 104729, 10009).alias("lon"),
        (5 + (F.col("event_id") * 31) % 200).cast("double").alias("acc"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with the transmitter that was heard there: bssid, dbm. Several devices hear each transmitter."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    heard = e.select("event_id", F.concat(F.lit("dev"), (F.col("event_id") % 8).cast("string")).alias("device"), F.concat(F.lit("AP"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("bssid"), (-40 - (F.col("event_id") * 17) % 55).cast("int").alias("dbm"))
    return fixes(spark, sf_dir).drop("device").join(heard, "event_id")


def cams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, operator, lat, lon, dir: assets with a direction."""
    key = F.col("s_suppkey") + 1
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("operator"), _place(40.0, key, 7919 * 31, 10007).alias("lat"), _place(-75.0, key, 104729 * 17, 10009).alias("lon"), ((F.col("s_suppkey") * 37) % 360).cast("int").alias("dir")
    )


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, cat, size, lat, lon: places."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(key.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("cat"), F.col("p_size").alias("size"), _place(40.0, key, 7919 * 13, 10007).alias("lat"), _place(-75.0, key, 104729 * 7, 10009).alias("lon"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, n, t_ms, lat, lon, acc: plausible motion, a step of about 30 m every 20 s with a jump now and then."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("k"), F.floor(F.col("o_orderkey") / 100_000).alias("part"))
    # a device's rows are numbered by ranges of the key, after the sizes of the ranges before
    sizes = o.groupBy("k", "part").agg(F.count("*").alias("size"))
    before = sizes.select("k", "part", (F.sum("size").over(Window.partitionBy("k").orderBy("part")) - F.col("size")).alias("before"))
    own = F.row_number().over(Window.partitionBy("k", "part").orderBy("o_orderkey"))
    o = o.withColumn("own", own).join(before, ["k", "part"]).withColumn("n", (F.col("before") + F.col("own")).cast("long"))
    jump = F.when(F.col("o_orderkey") % 41 == 0, 900).otherwise(0)
    gap = F.floor(F.col("n") / 50) * 700_000
    return o.select(
        F.concat(F.lit("t"), F.col("k").cast("string")).alias("device"),
        "n",
        (F.col("n") * 20_000 + gap).cast("long").alias("t_ms"),
        (F.lit(40.0) + (F.col("n") * 25 + (F.col("o_orderkey") * 7) % 13 + jump).cast("double") * F.lit(0.00001)).alias("lat"),
        (F.lit(-75.0) + (F.col("n") * 15 + (F.col("o_orderkey") * 11) % 17).cast("double") * F.lit(0.00001)).alias("lon"),
        (4 + F.col("o_orderkey") % 23).cast("double").alias("acc"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, highway, layer, oneway, nodes, points: roads along the tracks, eight steps each, that share the nodes of their ends; and a oneway beside each of them."""
    t = tracks(spark, sf_dir).select(F.substring("device", 2, 9).cast("long").alias("k"), "n", "lat", "lon")
    part = F.floor(F.col("n") / 8)
    t = t.withColumn("c", F.explode(F.when((F.col("n") % 8 == 0) & (F.col("n") > 0), F.array(part - 1, part)).otherwise(F.array(part)))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    point = F.struct("n", "lat", (F.col("lon") + F.col("side") * F.lit(0.0002)).alias("lon"))
    w = t.groupBy("k", "c", "side").agg(F.sort_array(F.collect_list(point)).alias("p")).where(F.size("p") >= 2)
    return w.select(
        ((F.col("k") * 1_000_000 + F.col("c")) * 2 + F.col("side")).alias("way"),
        F.when(F.col("c") % 4 == 1, "service").otherwise("residential").alias("highway"),
        F.when((F.col("side") == 0) & (F.col("c") % 5 == 0), 1).otherwise(0).alias("layer"),
        F.when(F.col("side") == 1, -1).when(F.col("c") % 3 == 0, 1).otherwise(0).alias("oneway"),
        F.transform("p", lambda x: F.col("k") * 10_000_000 + x["n"] * 2 + F.col("side")).alias("nodes"),
        F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"),
    )


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, camera_id, plate, t_ms, distance_m, confidence: events of an asset."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    t = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    minute = F.floor(t / 60_000_000)
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws(":", F.lit("pass"), F.col("l_suppkey").cast("string"), (minute + F.col("l_partkey") % 40).cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("uid"),
        F.col("l_suppkey").alias("camera_id"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("plate"),
        (F.floor(t / 1000) + (F.col("l_partkey") % 40) * 60_000).cast("long").alias("t_ms"),
        (F.col("l_partkey") % 65).cast("double").alias("distance_m"),
        (F.col("l_quantity") * 2).cast("int").alias("confidence"),
    )


#: The same views as common table expressions.
SQL = {
    "fixes": f"""fixes as (select event_id, 'dev' || cast(user_id % 8 as varchar) as device, epoch_us(ts) // 1000 as t_ms, event_type as source,
  {_place_sql(40.0, "event_id", 7919, 10007)} as lat, {_place_sql(-75.0, "event_id", 104729, 10009)} as lon, cast(5 + (event_id * 31) % 200 as double) as acc from events)""",
    "observations": f"""observations as (select event_id, 'dev' || cast(event_id % 8 as varchar) as device, epoch_us(ts) // 1000 as t_ms, event_type as source,
  {_place_sql(40.0, "event_id", 7919, 10007)} as lat, {_place_sql(-75.0, "event_id", 104729, 10009)} as lon, cast(5 + (event_id * 31) % 200 as double) as acc,
  'AP' || lpad(cast(user_id as varchar), 4, '0') as bssid, cast(-40 - (event_id * 17) % 55 as integer) as dbm from events)""",
    "cams": f"""cams as (select s_suppkey as id, s_name as operator, {_place_sql(40.0, "s_suppkey + 1", 7919 * 31, 10007)} as lat,
  {_place_sql(-75.0, "s_suppkey + 1", 104729 * 17, 10009)} as lon, cast((s_suppkey * 37) % 360 as integer) as dir from supplier)""",
    "pois": f"""pois as (select p_partkey as id, p_name as name, p_type as cat, p_size as size, {_place_sql(40.0, "p_partkey", 7919 * 13, 10007)} as lat,
  {_place_sql(-75.0, "p_partkey", 104729 * 7, 10009)} as lon from part)""",
    "tracks": """tracks as (select 't' || cast(k as varchar) as device, n, n * 20000 + (n // 50) * 700000 as t_ms,
  cast(40.0 as double) + cast(n * 25 + (o_orderkey * 7) % 13 + (case when o_orderkey % 41 = 0 then 900 else 0 end) as double) * cast(0.00001 as double) as lat,
  cast(-75.0 as double) + cast(n * 15 + (o_orderkey * 11) % 17 as double) * cast(0.00001 as double) as lon, cast(4 + o_orderkey % 23 as double) as acc
  from (select o_orderkey, o_custkey % 40 as k, row_number() over (partition by o_custkey % 40 order by o_orderkey) as n from orders))""",
    "legs": """legs as (select * from (select (cast(substr(device, 2) as bigint) * 1000000 + n // 8) * 2 + side as way, case when (n // 8) % 4 = 1 then 'service' else 'residential' end as highway, case when side = 0 and (n // 8) % 5 = 0 then 1 else 0 end as layer,
  case when side = 1 then -1 when (n // 8) % 3 = 0 then 1 else 0 end as oneway, n as k, lat, lon + side * cast(0.0002 as double) as lon, lead(lat) over w as lat2, lead(lon) over w + side * cast(0.0002 as double) as lon2
  from tracks, (values (0), (1)) v(side) window w as (partition by device, side order by n)) where lat2 is not null and (lat <> lat2 or lon <> lon2))""",
    "passes": """passes as (select 'pass:' || cast(l_suppkey as varchar) || ':' || cast(epoch_us(l_shipdate) // 60000000 + l_partkey % 40 as varchar) || ':' || cast(l_orderkey as varchar) || ':' || cast(l_linenumber as varchar) as uid,
  l_suppkey as camera_id, 'P' || cast(o_custkey as varchar) as plate, epoch_us(l_shipdate) // 1000 + (l_partkey % 40) * 60000 as t_ms, cast(l_partkey % 65 as double) as distance_m,
  cast(l_quantity * 2 as integer) as confidence from lineitem join orders on l_orderkey = o_orderkey)""",
}


def sql(views: str, body: str) -> str:
    """``body`` with the named views (and further expressions, given whole) in front of it."""
    return "with " + ", ".join(SQL[v] for v in views.split()) + " " + body
