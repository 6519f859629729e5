"""Queries of the readers (R-*): documents of each format are made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, json_arrays
from ..sources.views import cams, fixes, observations, pois, read, sql, tracks
from .catalog import query
from .common import at, at_sql

_E7 = "cast(floor(lat * 10000000) as bigint)"


#: Rows that one document of a device holds at most.
RUN = 1000


def _run(column: str):
    """What splits a key's rows into documents of bounded size."""
    return [F.floor(F.col(column) / RUN).alias("__run")]


def _records(spark, d):
    """Documents of a device, a bounded run of rows in each."""
    p = F.struct(F.floor(F.col("lat") * 1e7).alias("latitudeE7"), F.floor(F.col("lon") * 1e7).alias("longitudeE7"), F.col("acc").alias("accuracy"), F.col("source"), F.col("t_ms").cast("string").alias("timestampMs"))
    return fixes(spark, d).groupBy("device", *_run("event_id")).agg(F.collect_list(p).alias("locations")).select(F.to_json(F.struct("locations")).alias("raw"))


@query(sql("fixes", f"select cast(floor(cast({_E7} as double) / cast(10000000 as double) * 1000000 + 0.5) as bigint) as lat6, acc, source, t_ms from fixes"))
def r05_records(spark, d):
    return files.parse_records(_records(spark, d)).select(at(F.col("lat"), 6).alias("lat6"), "acc", "source", "t_ms")


@query(sql("observations", "select t_ms, cast(event_id as bigint) as n, dbm from observations where event_id > 0"))
def r04_timeline_scans(spark, d):
    """Scans of a timeline document, with addresses as numbers."""
    a = F.struct(F.struct(F.col("t_ms").cast("string").alias("deliveryTime"), F.array(F.struct(F.col("event_id").alias("mac"), F.col("dbm").alias("rawRssi"))).alias("devicesRecords")).alias("wifiScan"))
    docs = observations(spark, d).where("event_id > 0").groupBy("device", *_run("event_id")).agg(F.collect_list(a).alias("rawSignals")).select(F.to_json(F.struct("rawSignals")).alias("raw"))
    _, scans, _ = files.parse_timeline(docs)
    return scans.select("t_ms", F.conv(F.regexp_replace("bssid", ":", ""), 16, 10).cast("bigint").alias("n"), "dbm")


@query(sql("tracks", f"select cast(floor(cast({_E7} as double) / cast(10000000 as double) * 1000000 + 0.5) as bigint) as lat6, t_ms from tracks"))
def r06_semantic_history(spark, d):
    p = F.struct(F.floor(F.col("lat") * 1e7).alias("latE7"), F.floor(F.col("lon") * 1e7).alias("lngE7"), (F.col("t_ms") + 1_000_000_000_000).cast("string").alias("timestampMs"))
    seg = F.struct(F.struct(F.struct(F.collect_list(p).alias("points")).alias("simplifiedRawPath")).alias("activitySegment"))
    docs = tracks(spark, d).groupBy("device", *_run("n")).agg(F.array(seg).alias("timelineObjects")).select(F.to_json(F.struct("timelineObjects")).alias("raw"))
    _, points = files.parse_semantic(docs)
    return points.select(at(F.col("lat"), 6).alias("lat6"), (F.col("t_ms") - 1_000_000_000_000).alias("t_ms"))


@query(sql("observations", "select event_id as n, dbm, case when event_id % 2 = 0 then 'WPA2' else 'OPEN' end as security from observations where event_id > 0 and event_id % 5 <> 0"))
def r07_survey_csv(spark, d):
    """A quoted survey; rows of another type and without a position are left out."""
    header = ",".join(files.SURVEY)
    mac = F.lpad(F.hex("event_id"), 12, "0")
    o = observations(spark, d).where("event_id > 0")
    line = F.concat_ws(",", mac, F.lit('"a ""b"", c"'), F.when(F.col("event_id") % 2 == 0, "[WPA2-PSK][ESS]").otherwise("[ESS]"), F.lit("2024-01-01 00:00:00"), F.lit("6"), F.lit("2437"), F.col("dbm").cast("string"), F.when(F.col("event_id") % 10 == 5, "0.0").otherwise("40.0"), F.when(F.col("event_id") % 10 == 5, "0.0").otherwise("-75.0"), F.lit("1"), F.lit("5"), F.lit(""), F.lit(""), F.when(F.col("event_id") % 10 == 0, "BLE").otherwise("WIFI"))
    lines = o.select(line.alias("value")).union(spark.createDataFrame([("WigleWifi-1.6,appRelease=1",), (header,)], "value string"))
    out = files.parse_survey(lines, header).where("ssid = 'a \"b\", c'")
    return out.select(F.conv(F.regexp_replace("bssid", ":", ""), 16, 10).cast("bigint").alias("n"), "dbm", "security")


@query(sql("tracks", "select cast(floor(floor(lat * 100000) / 100000 * 100000 + 0.5) as bigint) as lat5, greatest(cast(5 as double), acc * 5) as acc, t_ms from tracks"))
def r08_gpx(spark, d):
    t = tracks(spark, d)
    num = lambda c: F.format_string("%.5f", F.floor(F.col(c) * 100000) / 100000)
    point = F.concat(F.lit('<trkpt lat="'), num("lat"), F.lit('" lon="'), num("lon"), F.lit('"><time>'), F.date_format(F.timestamp_millis(F.col("t_ms")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time><hdop>"), F.col("acc").cast("string"), F.lit("</hdop></trkpt>"))
    docs = t.groupBy("device", *_run("n")).agg(F.concat(F.lit("<gpx><trk><trkseg>"), F.array_join(F.collect_list(point), ""), F.lit('<trkpt lat="1" lon="2"></trkpt></trkseg></trk></gpx>')).alias("raw"))
    return files.parse_gpx(docs).select(at(F.col("lat"), 5).alias("lat5"), "acc", "t_ms")


@query(sql("tracks", "select cast(floor(floor(lat * 100000) / 100000 * 100000 + 0.5) as bigint) as lat5, t_ms from tracks"))
def r09_kml(spark, d):
    t = tracks(spark, d)
    num = lambda c: F.format_string("%.5f", F.floor(F.col(c) * 100000) / 100000)
    rows = F.sort_array(F.collect_list(F.struct("n", F.date_format(F.timestamp_millis(F.col("t_ms")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("w"), F.concat_ws(" ", num("lon"), num("lat"), F.lit("0")).alias("c"))))
    g = t.groupBy("device", *_run("n")).agg(rows.alias("r"))
    made = F.concat(F.lit("<kml><Placemark><gx:Track>"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("<when>"), x["w"], F.lit("</when>"))), ""), F.array_join(F.transform("r", lambda x: F.concat(F.lit("<gx:coord>"), x["c"], F.lit("</gx:coord>"))), ""), F.lit("</gx:Track></Placemark></kml>"))
    return files.parse_kml(g.select(made.alias("raw"))).select(at(F.col("lat"), 5).alias("lat5"), "t_ms")


@query(sql("cams", f"select 'osm:node/' || id as id, operator, {at_sql('lat', 6)} as lat6 from cams where dir % 5 <> 0"))
def r11_camera_features(spark, d):
    """Features without an id are left out."""
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.when(F.col("dir") % 5 != 0, F.col("id")).alias("osmId"), F.lit("node").alias("osmType"), "operator").alias("properties"))
    docs = cams(spark, d).groupBy(F.floor(F.col("id") / RUN).alias("k")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(f).alias("features"))).alias("raw"))
    return files.parse_cameras(docs).select("id", "operator", at(F.col("lat"), 6).alias("lat6"))


@query(sql("cams", "select operator as name from cams where dir % 5 = 0"))
def r12_unlisted_features(spark, d):
    f = F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.when(F.col("dir") % 5 != 0, F.col("id").cast("string")).otherwise("").alias("osm_id"), F.col("operator").alias("name")).alias("properties"))
    docs = cams(spark, d).groupBy(F.floor(F.col("id") / RUN).alias("k")).agg(F.to_json(F.struct(F.collect_list(f).alias("features"))).alias("raw"))
    return files.parse_unlisted_cameras(docs).select("name")


@query("select p_partkey as id, case when p_partkey % 4 = 0 then 'primary' when p_partkey % 4 = 1 then 'motorway_link' else 'service' end as highway, case when p_partkey % 5 = 0 then 1 when p_partkey % 5 = 1 then -1 else 0 end as layer, case when p_partkey % 4 = 1 then 1 else 0 end as oneway from part where p_partkey % 4 <> 3")
def r13_map_ways(spark, d):
    """Ways for motor vehicles, with layer and direction where the tags leave them out."""
    k = F.col("p_partkey")
    tags = F.map_filter(F.create_map(F.lit("highway"), F.when(k % 4 == 0, "primary").when(k % 4 == 1, "motorway_link").when(k % 4 == 2, "service").otherwise("footway"), F.lit("bridge"), F.when(k % 5 == 0, "yes"), F.lit("tunnel"), F.when(k % 5 == 1, "yes")), lambda _, v: v.isNotNull())
    e = F.struct(F.lit("way").alias("type"), k.alias("id"), tags.alias("tags"))
    docs = read(spark, d, "part").groupBy(F.floor(k / RUN).alias("g")).agg(F.to_json(F.struct(F.collect_list(e).alias("elements"))).alias("raw"))
    return files.parse_ways(docs).select("id", "highway", "layer", "oneway")


@query("select n_name as slug, case when n_nationkey >= 5 then n_nationkey end as cameras from nation")
def r14_portals(spark, d):
    p = F.struct(F.col("n_name").alias("slug"), F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey")).otherwise(-1).alias("cameras"))
    docs = read(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(p).alias("portals"))).alias("raw"))
    return files.parse_portals(docs).select("slug", "cameras")


@query("select p_partkey, (['timeline', 'records', 'semantic', 'survey', 'gpx', 'kml', 'geojson', null])[p_partkey % 8 + 1] as format from part")
def r17_format_detection(spark, d):
    heads = F.array(*map(F.lit, ('{"semanticSegments": [', '{"locations": [', '{"timelineObjects": [', "WigleWifi-1.6,a", '<?xml?><gpx version="1">', "<?xml?><kml >", '{"type": "FeatureCollection"', "hello")))
    return read(spark, d, "part").select("p_partkey", files.format_of(F.element_at(heads, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("format"))


@query(sql("observations", "select event_id as n, cast(dbm as double) as dbm, case when event_id % 2 = 0 then 'WPA2' else 'OPEN' end as security from observations where event_id > 0"))
def r18_scan_dump(spark, d):
    mac = F.lower(F.regexp_replace(F.lpad(F.hex("event_id"), 12, "0"), "(..)(?!$)", "$1:"))
    block = F.concat(F.lit("BSS "), mac, F.lit("(on wlan0)\n\tfreq: 2437\n\tsignal: "), F.col("dbm").cast("string"), F.lit(".00 dBm\n\tSSID: net\n"), F.when(F.col("event_id") % 2 == 0, "\tcapability: Privacy\n\tRSN:\t * Version: 1\n").otherwise(""))
    docs = observations(spark, d).where("event_id > 0").groupBy("device", *_run("event_id")).agg(F.array_join(F.collect_list(block), "").alias("raw"))
    return files.parse_scan_dump(docs).select(F.conv(F.regexp_replace("bssid", ":", ""), 16, 10).cast("bigint").alias("n"), "dbm", "security")


@query("select user_id % 5 as node, event_id as time_ms, cast(floor(greatest(cast(0 as double), least(cast(100 as double), (event_id % 1500 + 3000 - 3300) / cast(8.5 as double))) * 1000 + 0.5) as bigint) as level3, case when event_id % 3 = 0 then 'packet' when user_id % 5 < 3 then 'anchor' end as loc_source from events where event_type in ('click', 'view')")
def r21_node_packets(spark, d):
    """Messages of nodes, with battery and place filled in."""
    e = read(spark, d, "events")
    made = F.struct(F.when(F.col("event_type") == "click", "status").when(F.col("event_type") == "view", "beacon").otherwise("noise").alias("kind"), (F.col("user_id") % 5).cast("string").alias("node"), F.col("event_id").alias("time_ms"), (F.col("event_id") % 1500 + 3000).alias("mv"), F.when(F.col("event_id") % 3 == 0, 40.0).alias("lat"), F.when(F.col("event_id") % 3 == 0, -75.0).alias("lon"))
    places = spark.createDataFrame([(str(k), 40.0 + k, -75.0) for k in range(3)], "node string, lat double, lon double")
    out = files.parse_packets(e.select(F.to_json(made).alias("raw")), places)
    return out.select(F.col("node").cast("long").alias("node"), "time_ms", at(F.col("battery")).alias("level3"), "loc_source")


def _huge(df, head: str, tail: str) -> str:
    """Writes one document for each task: its head, the elements ``value`` with garbage between some of them, and its tail. Returns the folder."""
    from ..streaming.live import folder

    def document(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for batch in batches:
            yield batch
        yield pa.RecordBatch.from_arrays([pa.array([tail])], names=["value"])

    home = folder(df.sparkSession)
    df.mapInArrow(document, "value string").write.text(home)
    return home


@query("select event_id, event_type as kind, cast(user_id as bigint) as n from events")
def r03_streamed_array(spark, d):
    """Elements of a huge array: two orders of keys, texts that look like the array, an array of the same name inside, garbage between."""
    e = read(spark, d, "events")
    note, inner = F.lit('a "locations": [{ text'), F.array(F.struct(F.lit(-1).alias("event_id")))
    one, other = F.struct("event_id", note.alias("note"), F.col("event_type").alias("kind"), inner.alias("locations"), F.col("user_id").alias("n")), F.struct(inner.alias("locations"), F.col("user_id").alias("n"), F.col("event_type").alias("kind"), note.alias("note"), "event_id")
    value = F.concat(F.when(F.col("event_id") % 2 == 0, F.to_json(one)).otherwise(F.to_json(other)), F.when(F.col("event_id") % 5 == 0, ", garbage").otherwise(","))
    home = _huge(e.select(value.alias("value")), '{"settings": {"locations": "none"}, "locations": [', '{}], "more": {"event_id": 1}}')
    return json_arrays.elements(spark, home, "locations", "event_id long, kind string, n long").where("event_id is not null")


@query(sql("cams", f"select id, operator, {at_sql('lat', 6)} as lat6, {at_sql('lon', 6)} as lon6 from cams"))
def r10_streamed_features(spark, d):
    """Features of a huge collection, one at a time."""
    f = cams(spark, d).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("id", "operator").alias("properties"))).alias("value"))
    home = _huge(f.select(F.concat("value", F.lit(" , ")).alias("value")), '{"type": "FeatureCollection", "features": [', "{}]}")
    found = json_arrays.elements(spark, home, "features", "geometry struct<coordinates: array<double>>, properties struct<id: long, operator: string>").where("properties is not null")
    return found.select("properties.id", "properties.operator", at(F.col("geometry.coordinates")[1], 6).alias("lat6"), at(F.col("geometry.coordinates")[0], 6).alias("lon6"))
