"""Readers of file formats: each takes a path (or raw rows) and gives rows of the domain. Schemas are declared, never inferred.

The JSON formats are read as whole documents and exploded; text formats as lines. A reader has a second form ``parse_*`` that takes
a column of raw documents, for texts that are in a table already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio, text

RECORDS = "struct<locations: array<struct<latitudeE7: bigint, longitudeE7: bigint, accuracy: double, altitude: double, source: string, timestamp: string, timestampMs: string, wifiScan: struct<accessPoints: array<struct<mac: string, strength: int, frequencyMhz: int>>>>>>"
TIMELINE = "struct<semanticSegments: array<struct<startTime: string, endTime: string, visit: struct<topCandidate: struct<placeId: string, semanticType: string, placeLocation: struct<latLng: string>>>, timelinePath: array<struct<point: string, time: string>>>>, rawSignals: array<struct<position: struct<LatLng: string, point: string, timestamp: string, accuracyMeters: double, altitudeMeters: double>, wifiScan: struct<deliveryTime: string, devicesRecords: array<struct<mac: bigint, rawRssi: int>>>>>>"
SEMANTIC = "struct<timelineObjects: array<struct<placeVisit: struct<location: struct<latitudeE7: bigint, longitudeE7: bigint, name: string>, duration: struct<startTimestamp: string, endTimestamp: string>>, activitySegment: struct<simplifiedRawPath: struct<points: array<struct<latE7: bigint, lngE7: bigint, accuracyMeters: double, timestamp: string, timestampMs: string>>>>>>>"
FEATURES = "struct<features: array<struct<geometry: struct<coordinates: array<double>>, properties: struct<osmId: bigint, osmType: string, operator: string, brand: string, direction: double, directions: array<double>, osmVersion: int, osm_id: string, name: string>>>>"
WAYS = "struct<elements: array<struct<type: string, id: bigint, nodes: array<bigint>, geometry: array<struct<lat: double, lon: double>>, tags: map<string, string>>>>"
PORTALS = "struct<portals: array<struct<slug: string, city: string, county: string, state: string, type: string, cameras: bigint, searches: bigint>>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: ``path`` and ``raw``."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))


def format_of(head: F.Column) -> F.Column:
    """The import format of a file by how it begins, or null."""
    return (
        F.when(head.rlike(r'"(semanticSegments|rawSignals)"'), "timeline")
        .when(head.rlike(r'"timelineObjects"'), "semantic")
        .when(head.rlike(r'"locations"'), "records")
        .when(head.rlike(r"^WigleWifi-"), "survey")
        .when(head.rlike(r"<gpx[\s>]"), "gpx")
        .when(head.rlike(r"<kml[\s>]"), "kml")
        .when(head.rlike(r'"FeatureCollection"'), "geojson")
    )


def _time(*candidates: F.Column) -> F.Column:
    return F.coalesce(*map(text.epoch_ms, candidates))


def parse_records(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Positions of a location-records document; rows without coordinates are left out."""
    r = docs.select(F.explode(F.from_json(raw, RECORDS)["locations"]).alias("p"))
    return r.where("p.latitudeE7 is not null and p.longitudeE7 is not null").select(
        (F.col("p.latitudeE7") / 1e7).alias("lat"), (F.col("p.longitudeE7") / 1e7).alias("lon"), F.col("p.accuracy").alias("acc"), "p.source", _time(F.col("p.timestampMs"), F.col("p.timestamp")).alias("t_ms")
    )


def parse_records_scans(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Transmitters heard at the positions of a location-records document."""
    r = docs.select(F.explode(F.from_json(raw, RECORDS)["locations"]).alias("p"))
    return r.select(_time(F.col("p.timestampMs"), F.col("p.timestamp")).alias("t_ms"), F.explode("p.wifiScan.accessPoints").alias("a")).select("t_ms", text.mac_of_number(F.col("a.mac").cast("bigint")).alias("bssid"), F.col("a.strength").alias("dbm"), F.col("a.frequencyMhz").alias("mhz"))


def parse_timeline(docs: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positions, scans, visits) of an on-device timeline document."""
    d = docs.select(F.from_json(raw, TIMELINE).alias("d"))
    signals = d.select(F.explode("d.rawSignals").alias("s"))
    p = F.coalesce("s.position.LatLng", "s.position.point")
    positions = signals.withColumn("at", text.degrees_pair(p)).where("at is not null").select("at.lat", "at.lon", F.col("s.position.accuracyMeters").alias("acc"), _time(F.col("s.position.timestamp")).alias("t_ms"))
    scans = signals.select(_time(F.col("s.wifiScan.deliveryTime")).alias("t_ms"), F.explode("s.wifiScan.devicesRecords").alias("a")).select("t_ms", text.mac_of_number(F.col("a.mac")).alias("bssid"), F.col("a.rawRssi").alias("dbm"))
    v = d.select(F.explode("d.semanticSegments").alias("v")).withColumn("at", text.degrees_pair(F.col("v.visit.topCandidate.placeLocation.latLng"))).where("at is not null")
    return positions, scans, v.select("at.lat", "at.lon", F.col("v.visit.topCandidate.semanticType").alias("kind"), _time(F.col("v.startTime")).alias("from_ms"), _time(F.col("v.endTime")).alias("to_ms"))


def parse_semantic(docs: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(visits, path points) of a semantic-history document; a time is text or milliseconds."""
    o = docs.select(F.explode(F.from_json(raw, SEMANTIC)["timelineObjects"]).alias("o"))
    visits = o.where("o.placeVisit is not null").select((F.col("o.placeVisit.location.latitudeE7") / 1e7).alias("lat"), (F.col("o.placeVisit.location.longitudeE7") / 1e7).alias("lon"), F.col("o.placeVisit.location.name").alias("name"), _time(F.col("o.placeVisit.duration.startTimestamp")).alias("from_ms"), _time(F.col("o.placeVisit.duration.endTimestamp")).alias("to_ms"))
    p = o.select(F.explode("o.activitySegment.simplifiedRawPath.points").alias("p"))
    return visits, p.select((F.col("p.latE7") / 1e7).alias("lat"), (F.col("p.lngE7") / 1e7).alias("lon"), F.col("p.accuracyMeters").alias("acc"), _time(F.col("p.timestampMs"), F.col("p.timestamp")).alias("t_ms"))


SURVEY = ("MAC", "SSID", "AuthMode", "FirstSeen", "Channel", "Frequency", "RSSI", "CurrentLatitude", "CurrentLongitude", "AltitudeMeters", "AccuracyMeters", "RCOIs", "MfgrId", "Type")


def parse_survey(lines: DataFrame, header: str, line: str = "value") -> DataFrame:
    """Rows of a radio survey: quoted CSV with columns found by the header's names; Wi-Fi rows with a position only."""
    names = [h.strip() for h in header.split(",")]
    schema = ", ".join(f"`{n}` string" for n in names)
    r = lines.where(~F.col(line).startswith("WigleWifi-") & (F.col(line) != header)).select(F.from_csv(line, schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    r = r.where("Type = 'WIFI' and not (cast(CurrentLatitude as double) = 0 and cast(CurrentLongitude as double) = 0)")
    return r.select(text.mac(F.col("MAC")).alias("bssid"), F.col("SSID").alias("ssid"), radio.security_of_text(F.col("AuthMode")).alias("security"), F.col("RSSI").cast("int").alias("dbm"), F.col("CurrentLatitude").cast("double").alias("lat"), F.col("CurrentLongitude").cast("double").alias("lon"), F.col("AccuracyMeters").cast("double").alias("acc"), text.epoch_ms(F.col("FirstSeen")).alias("t_ms"))


def parse_gpx(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Timed points of tracks, routes and waypoints; the accuracy is five times the dilution, five metres at least."""
    point = "struct<_lat: double, _lon: double, ele: double, time: string, hdop: double>"
    found = None
    for tag in ("trkpt", "rtept", "wpt"):
        parts = F.regexp_extract_all(raw, F.lit(rf"(?s)<{tag}\b.*?</{tag}>"), F.lit(0))
        own = docs.select(F.explode(parts).alias("x")).select(F.from_xml("x", point).alias("p"))
        found = own if found is None else found.union(own)
    return found.where("p.time is not null").select(F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.greatest(F.lit(5.0), F.col("p.hdop") * 5).alias("acc"), text.epoch_ms(F.col("p.time")).alias("t_ms"))


def parse_kml(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Timed points: tracks of times and coordinates that are paired in order, and placemarks with a time."""
    inner = lambda x, tag: F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1))
    track = docs.select(F.explode(F.regexp_extract_all(raw, F.lit(r"(?s)<gx:Track>.*?</gx:Track>"), F.lit(0))).alias("t"))
    pairs = track.select(F.explode(F.arrays_zip(inner(F.col("t"), "when").alias("w"), F.transform(inner(F.col("t"), "gx:coord"), lambda c: F.split(c, r"\s+")).alias("c"))).alias("z")).select("z.w", "z.c")
    mark = docs.select(F.explode(F.regexp_extract_all(raw, F.lit(r"(?s)<Placemark>.*?</Placemark>"), F.lit(0))).alias("m")).where(~F.col("m").contains("<gx:Track>") & F.col("m").contains("<Point>"))
    points = mark.select(inner(F.col("m"), "when")[0].alias("w"), F.split(inner(F.col("m"), "coordinates")[0], ",").alias("c"))
    both = pairs.union(points).where("w is not null and size(c) >= 2")
    return both.select(F.trim(F.col("c")[1]).cast("double").alias("lat"), F.trim(F.col("c")[0]).cast("double").alias("lon"), text.epoch_ms(F.col("w")).alias("t_ms"))


def parse_cameras(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Assets of a feature collection with an id of their own, away from (0, 0)."""
    f = docs.select(F.explode(F.from_json(raw, FEATURES)["features"]).alias("f")).select(F.col("f.geometry.coordinates").alias("c"), "f.properties.*")
    f = f.where("osmId is not null and size(c) >= 2 and not (c[0] = 0 and c[1] = 0)")
    return f.select(F.concat_ws(":", F.lit("osm"), F.concat_ws("/", F.coalesce("osmType", F.lit("node")), F.col("osmId").cast("string"))).alias("id"), F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"), F.coalesce("operator", "brand").alias("operator"), F.coalesce("directions", F.when(F.col("direction").isNotNull(), F.array("direction"))).alias("directions"), "osmVersion")


def parse_unlisted_cameras(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Assets of a feature collection that no public map lists."""
    f = docs.select(F.explode(F.from_json(raw, FEATURES)["features"]).alias("f")).select(F.col("f.geometry.coordinates").alias("c"), "f.properties.*")
    return f.where("coalesce(osm_id, '') = '' and size(c) >= 2").select("name", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"))


#: Ways that no motor vehicle uses.
FOOTED = ("footway", "cycleway", "path", "steps", "pedestrian", "bridleway", "corridor", "construction", "proposed")


def parse_ways(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Roads of a map extract: a bridge without a layer is on layer 1, a tunnel on -1; links of motorways are one-way."""
    w = docs.select(F.explode(F.from_json(raw, WAYS)["elements"]).alias("e")).where("e.type = 'way' and e.tags['highway'] is not null").select("e.*")
    tag = lambda k: F.col("tags")[k]
    yes = lambda k: F.coalesce(tag(k) != "no", F.lit(False))
    w = w.where(~tag("highway").isin(*FOOTED))
    layer = F.coalesce(tag("layer").cast("int"), F.when(yes("bridge"), 1).when(yes("tunnel"), -1).otherwise(0))
    oneway = F.when(tag("oneway").isin("yes", "1", "true"), 1).when(tag("oneway") == "-1", -1).when(tag("oneway").isNull() & tag("highway").isin("motorway", "motorway_link"), 1).otherwise(0)
    return w.select("id", tag("highway").alias("highway"), tag("name").alias("name"), layer.alias("layer"), yes("bridge").alias("bridge"), yes("tunnel").alias("tunnel"), oneway.alias("oneway"), "nodes", F.col("geometry").alias("pts"))


def parse_portals(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Portal rows; negative counts are unknown."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return docs.select(F.explode(F.from_json(raw, PORTALS)["portals"]).alias("p")).select("p.*").select("slug", "city", "county", "state", "type", known("cameras"), known("searches"))


def parse_scan_dump(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Transmitters of the text that a scan command prints."""
    blocks = F.filter(F.split(raw, r"(?m)^BSS "), lambda b: b.rlike(r"^[0-9a-f]{2}(:[0-9a-f]{2}){5}"))
    b = docs.select(F.explode(blocks).alias("b"))
    part = lambda p: F.nullif(F.regexp_extract("b", p, 1), F.lit(""))
    return b.select(text.mac(F.substring("b", 1, 17)).alias("bssid"), part(r"(?m)^\s*SSID: (.*)$").alias("ssid"), part(r"signal: (-?[\d.]+)").cast("double").alias("dbm"), part(r"freq: (\d+)").cast("int").alias("mhz"), radio.security_of_flags(F.col("b").contains("Privacy").cast("int"), F.col("b").contains("WPA:").cast("int"), F.col("b").contains("RSN:").cast("int")).alias("security"))


PACKET = "struct<kind: string, node: string, mac: string, ssid: string, rssi: int, ch: int, time_ms: bigint, mv: int, battery: double, lat: double, lon: double>"


def parse_packets(rows: DataFrame, places: DataFrame, raw: str = "raw") -> DataFrame:
    """Node messages; works on a stream. A missing battery level is linear from 3300 to 4150 mV, a missing place is the node's anchor."""
    p = rows.select(F.from_json(raw, PACKET).alias("p")).select("p.*").where(F.col("kind").isin("status", "mesh_telemetry", "beacon", "probe"))
    level = F.coalesce("battery", F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("mv") - 3300) / 8.5)))
    a = places.select(F.col("node"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    j = p.join(a, "node", "left")
    return j.select("kind", "node", text.mac(F.col("mac")).alias("mac"), "ssid", "rssi", "time_ms", level.alias("battery"), F.coalesce("lat", "a_lat").alias("lat"), F.coalesce("lon", "a_lon").alias("lon"), F.when(F.col("lat").isNotNull(), "packet").when(F.col("a_lat").isNotNull(), "anchor").alias("loc_source"))

