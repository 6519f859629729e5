"""Queries of the scalar functions (S-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, radio, text
from ..sources.views import cams, fixes, observations, passes, pois, read, sql
from .catalog import query
from .common import at, at_sql, bearing_sql, hav_sql

_HOME = "cast(40.01 as double)", "cast(-74.99 as double)"



def _home():
    return F.lit(40.01), F.lit(-74.99)


@query(sql("fixes", f"select event_id, {at_sql(hav_sql('lat', 'lon', *_HOME))} as mm from fixes"))
def s01_haversine(spark, d):
    return fixes(spark, d).select("event_id", at(geo.haversine(F.col("lat"), F.col("lon"), *_home())).alias("mm"))


@query(sql("fixes", f"select event_id, {at_sql(f'cast(6371000 as double) * sqrt(radians({_HOME[1]} - lon) * cos(radians((lat + {_HOME[0]}) / 2)) * radians({_HOME[1]} - lon) * cos(radians((lat + {_HOME[0]}) / 2)) + radians({_HOME[0]} - lat) * radians({_HOME[0]} - lat))')} as mm from fixes"))
def s02_equirectangular(spark, d):
    return fixes(spark, d).select("event_id", at(geo.flat_distance(F.col("lat"), F.col("lon"), *_home())).alias("mm"))


@query(sql("fixes", f"select event_id, {at_sql(f'(lon - {_HOME[1]}) * cast(111320 as double) * cos(radians({_HOME[0]}))')} as east, {at_sql(f'(lat - {_HOME[0]}) * cast(111320 as double)')} as north from fixes"))
def s03_local_frame(spark, d):
    x, y = geo.local_xy(F.col("lat"), F.col("lon"), *_home())
    return fixes(spark, d).select("event_id", at(x).alias("east"), at(y).alias("north"))


@query(sql("fixes", f"select event_id, {at_sql(bearing_sql('lat', 'lon', *_HOME), 4)} as deg4 from fixes"))
def s04_bearing(spark, d):
    return fixes(spark, d).select("event_id", at(geo.bearing(F.col("lat"), F.col("lon"), *_home()), 4).alias("deg4"))


@query(sql("cams", "select id, least(abs(dir - 100) % 360, 360 - abs(dir - 100) % 360) as between_, case when least(abs(dir - 100) % 360, 360 - abs(dir - 100) % 360) > 90 then 180 - least(abs(dir - 100) % 360, 360 - abs(dir - 100) % 360) else least(abs(dir - 100) % 360, 360 - abs(dir - 100) % 360) end as axial from cams"))
def s05_angle_difference(spark, d):
    a, b = F.col("dir").cast("double"), F.lit(100.0)
    return cams(spark, d).select("id", geo.angle_between(a, b).cast("int").alias("between_"), geo.axial_angle(a, b).cast("int").alias("axial"))


@query(sql("cams", "select id, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[cast(floor((dir + 11.25) / 22.5) as bigint) % 16 + 1] as point from cams"))
def s06_compass(spark, d):
    return cams(spark, d).select("id", geo.compass(F.col("dir")).alias("point"))


@query(sql("fixes", "select event_id, cast(floor(lat * 1000) as bigint) as y, cast(floor(lon * 1000) as bigint) as x, cast(floor(lat * 20 + 0.5) as bigint) as big_y from fixes"))
def s07_cell_keys(spark, d):
    y, x = geo.cell(F.col("lat"), F.col("lon"), 1000)
    return fixes(spark, d).select("event_id", y.alias("y"), x.alias("x"), F.floor(F.col("lat") * 20 + 0.5).alias("big_y"))


@query(sql("cams", "select id, dir || ',' || ((dir + 90) % 360) as deg from cams where dir > 0"))
def s08_direction_grammar(spark, d):
    """Texts of the grammar, made from the table, read back."""
    c = cams(spark, d).where("dir > 0")
    made = F.concat(F.col("dir").cast("string"), F.lit("; "), F.pmod(F.col("dir") + 45, F.lit(360)).cast("string"), F.lit("-"), F.pmod(F.col("dir") + 135, F.lit(360)).cast("string"))
    return c.select("id", F.array_join(F.transform(text.directions(made), lambda x: x.cast("int").cast("string")), ",").alias("deg"))


@query("select p_partkey, case when p_name like '%widget%' then 'alpr' when p_type = 'PROMO' then 'webcam' when p_brand in ('Brand#1', 'Brand#2') then 'ptz' when p_size > 25 then 'cctv' else 'not_camera' end as kind from part")
def s09_classification_rules(spark, d):
    kind = F.when(F.col("p_name").contains("widget"), "alpr").when(F.col("p_type") == "PROMO", "webcam").when(F.col("p_brand").isin("Brand#1", "Brand#2"), "ptz").when(F.col("p_size") > 25, "cctv").otherwise("not_camera")
    return read(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query("select p_partkey, case when regexp_matches(lower(p_name), 'ring|gear') then 25 when regexp_matches(lower(p_name), 'wid') then 35 else 60 end as half_angle from part")
def s10_vendor_cone(spark, d):
    n = F.lower("p_name")
    return read(spark, d, "part").select("p_partkey", F.when(n.rlike("ring|gear"), 25).when(n.rlike("wid"), 35).otherwise(60).alias("half_angle"))


@query(sql("observations", f"select event_id, {at_sql('greatest(cast(3 as double), least(cast(800 as double), pow(cast(10 as double), (cast(-36 as double) - dbm) / 24)))')} as mm from observations"))
def s11_range_of_level(spark, d):
    return observations(spark, d).select("event_id", at(radio.metres_of_level(F.col("dbm"), F.lit(-36.0))).alias("mm"))


@query(sql("observations", f"select event_id, {at_sql('pow(cast(10 as double), (cast(-40 as double) - (cast(-40 as double) - 10 * cast(2.7 as double) * log10(greatest(acc, cast(1 as double))))) / (10 * cast(2.7 as double)))')} as mm from observations"))
def s12_path_loss_inverse(spark, d):
    level = radio.level_at(F.lit(-40.0), F.lit(2.7), F.col("acc"))
    return observations(spark, d).select("event_id", at(radio.metres_at(F.lit(-40.0), F.lit(2.7), level)).alias("mm"))


@query(sql("observations", f"select event_id, {at_sql('20 * log10(acc) + 20 * log10(cast(2437 as double)) - cast(27.55 as double)', 4)} as loss4 from observations"))
def s13_free_space_loss(spark, d):
    return observations(spark, d).select("event_id", at(radio.free_space_loss(F.col("acc"), F.lit(2437.0)), 4).alias("loss4"))


@query("with f as (select event_id, 2400 + (event_id * 13) % 4800 as mhz from events) select event_id, case when mhz between 2400 and 2500 then '2.4' when mhz between 4900 and 5924 then '5' when mhz between 5925 and 7125 then '6' end as band, cast(case when mhz = 2484 then 14 when mhz between 2412 and 2472 then (mhz - 2407) // 5 when mhz between 5000 and 5924 then (mhz - 5000) // 5 when mhz between 5925 and 7125 then trunc((mhz - 5950) / 5) end as integer) as channel from f")
def s14_band_and_channel(spark, d):
    mhz = 2400 + (F.col("event_id") * 13) % 4800
    return read(spark, d, "events").select("event_id", radio.band(mhz).alias("band"), radio.channel(mhz).alias("channel"))


@query("with f as (select event_id, event_id % 2 as p, event_id % 3 as w, case event_id % 5 when 0 then 1024 when 1 then 2048 when 2 then 2 else 0 end as r from events) select event_id, case when r = 1024 then 'WPA3' when r = 2048 then 'OWE' when r <> 0 then 'WPA2' when w <> 0 then 'WPA' when p = 1 then 'WEP' else 'OPEN' end as security from f")
def s15_security_of_flags(spark, d):
    e = F.col("event_id")
    rsn = F.when(e % 5 == 0, 1024).when(e % 5 == 1, 2048).when(e % 5 == 2, 2).otherwise(0)
    return read(spark, d, "events").select("event_id", radio.security_of_flags((e % 2).cast("int"), (e % 3).cast("int"), rsn).alias("security"))


_CAPS = "['[WPA2-PSK-CCMP][ESS]', '[RSN-SAE]', '[wpa-psk]', '[WEP]', '[ESS]', '[OWE]']"


@query(f"select event_id, (['WPA2', 'WPA3', 'WPA', 'WEP', 'OPEN', 'OWE'])[event_id % 6 + 1] as security from events where len({_CAPS}) = 6")
def s16_security_of_text(spark, d):
    caps = F.array(*map(F.lit, ("[WPA2-PSK-CCMP][ESS]", "[RSN-SAE]", "[wpa-psk]", "[WEP]", "[ESS]", "[OWE]")))
    return read(spark, d, "events").select("event_id", radio.security_of_text(F.element_at(caps, (F.col("event_id") % 6 + 1).cast("int"))).alias("security"))


@query("select event_id, (['BAD', 'BAD', 'OK', 'OK', 'UNKNOWN'])[event_id % 5 + 1] as verdict from events")
def s17_security_verdict(spark, d):
    kinds = F.array(*map(F.lit, ("OPEN", "WEP", "WPA2", "WPA3", "?")))
    return read(spark, d, "events").select("event_id", radio.verdict(F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int"))).alias("verdict"))


@query("with m as (select event_id, lpad(upper(printf('%x', event_id * 1234567891)), 12, '0') as h from events) select event_id, substr(h,1,2)||':'||substr(h,3,2)||':'||substr(h,5,2)||':'||substr(h,7,2)||':'||substr(h,9,2)||':'||substr(h,11,2) as mac from m")
def s18_mac_forms(spark, d):
    return read(spark, d, "events").select("event_id", text.mac(text.mac_of_number(F.col("event_id") * 1234567891)).alias("mac"))


@query("select event_id, cast(event_id % 181 - 90 as double) as lat, cast(event_id % 361 - 180 as double) as lon from events where event_id % 7 <> 3")
def s19_degrees_text(spark, d):
    e = F.col("event_id")
    made = F.concat(F.when(e % 7 == 3, F.lit("200")).otherwise((e % 181 - 90).cast("string")), F.lit("°, "), (e % 361 - 180).cast("string"), F.lit("°"))
    return read(spark, d, "events").select("event_id", text.degrees_pair(made).alias("p")).where("p is not null").select("event_id", "p.lat", "p.lon")


@query("select event_id, epoch_us(ts) // 1000000 * 1000 as ms from events")
def s20_time_text(spark, d):
    """Three encodings of a time, read as one."""
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    e = F.col("event_id") % 3
    made = F.when(e == 0, s.cast("string")).when(e == 1, (s * 1000).cast("string")).otherwise(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss"))
    return read(spark, d, "events").select("event_id", text.epoch_ms(made).alias("ms"))


@query("select event_id, strftime(ts - interval 5 hour, '%Y-%m-%dT%H:%M:%S') as iso from events")
def s21_local_time(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "-05:00"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("with s as (select event_id, event_id * 37 as s from events) select event_id, case when s < 60 then s || ' s' when s < 3600 then (s // 60) || ' min' when s < 86400 then (s // 3600) || ' h ' || (s % 3600 // 60) || ' min' else (s // 86400) || ' d ' || (s % 86400 // 3600) || ' h' end as text from s")
def s22_duration_text(spark, d):
    return read(spark, d, "events").select("event_id", text.duration(F.col("event_id") * 37).alias("text"))


@query("select event_id, cast(greatest(300, floor(event_id * 10 * cast(1.4 as double) / (70 / cast(3.6 as double)) / 300 + 0.5) * 300) as bigint) as s from events")
def s23_drive_estimate(spark, d):
    return read(spark, d, "events").select("event_id", text.drive_seconds(F.col("event_id") * 10).alias("s"))


@query()
def s24_sun_times(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 366).cast("int")).alias("day"), (F.col("c_custkey") % 160 - 80).cast("double").alias("lat"))
    up, down, state = geo.sun_events(F.col("day"), F.col("lat"), F.lit(10.0))
    return c.select("c_custkey", F.floor(up).alias("rise"), F.floor(down).alias("set"), state.alias("state"))


@query(sql("fixes", f"select event_id, {at_sql('lon / 360 + 0.5', 9)} as x9, {at_sql('0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())', 9)} as y9 from fixes"))
def s25_web_mercator(spark, d):
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    return fixes(spark, d).select("event_id", at(x, 9).alias("x9"), at(y, 9).alias("y9"))


@query("select c_custkey, sha256(lower(trim('  ' || c_name))) as full_hash, substr(sha256(lower(trim(c_name))), 1, 8) as prefix from customer")
def s26_hashes(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.hashed(F.concat(F.lit("  "), F.col("c_name"))).alias("full_hash"), F.substring(text.hashed(F.col("c_name")), 1, 8).alias("prefix"))


@query("select c_custkey, regexp_replace(upper(c_name || ' & co'), '[^A-Z0-9]', '', 'g') as plate, translate(regexp_replace(upper(c_name || ' & co'), '[^A-Z0-9]', '', 'g'), 'OIBSZG', '018526') as folded from customer")
def s28_plate_forms(spark, d):
    made = F.concat(F.col("c_name"), F.lit(" & co"))
    return read(spark, d, "customer").select("c_custkey", text.plate(made).alias("plate"), text.folded_plate(made).alias("folded"))


@query(sql("passes", "select uid, 'pass:' || camera_id || ':' || (t_ms // 60000) as made, 'ev:' || substr(sha256(plate || '|' || camera_id), 1, 24) as key from passes"))
def s29_deterministic_uids(spark, d):
    key = F.concat(F.lit("ev:"), F.substring(F.sha2(F.concat_ws("|", "plate", F.col("camera_id").cast("string")).cast("binary"), 256), 1, 24))
    return passes(spark, d).select("uid", text.pass_uid(F.col("camera_id"), F.col("t_ms")).alias("made"), key.alias("key"))


@query("select p_partkey, array_to_string(list_filter(string_split(upper(p_name), ' '), lambda x: x not in ('SMALL', 'RED')), ' ') as tokens from part where p_partkey >= 0")
def s30_name_tokens(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(text.name_tokens(F.col("p_name"), ("SMALL", "RED")), " ").alias("tokens"))


@query("select c_custkey, case when c_nationkey % 3 = 0 then 'PA' when c_nationkey % 3 = 1 then 'NJ' end as state from customer")
def s31_trailing_state(spark, d):
    n = F.col("c_nationkey") % 3
    made = F.concat(F.col("c_name"), F.when(n == 0, ", PA").when(n == 1, " NJ ").otherwise(" XX"))
    return read(spark, d, "customer").select("c_custkey", text.trailing_state(made, ("PA", "NJ", "NY")).alias("state"))


@query("select c_custkey from customer where c_name like '%00__7_'")
def s35_wildcard_match(spark, d):
    return read(spark, d, "customer").where(F.col("c_name").like("%00__7_")).select("c_custkey")


@query(sql("observations", f"select event_id, {at_sql('1 / (1 + exp(-(dbm + 60) / cast(10 as double)))', 9)} as p9 from observations"))
def s36_sigmoid(spark, d):
    return observations(spark, d).select("event_id", at(radio.sigmoid((F.col("dbm") + 60) / 10), 9).alias("p9"))


@query()
def s37_normal_cdf(spark, d):
    return observations(spark, d).select("event_id", at(radio.normal_cdf((F.col("dbm") + 67) / 15), 6).alias("p6"))


@query(sql("observations", f"select event_id, {at_sql('acc * pow(1 - 2 / (9 * acc) + cast(1.645 as double) * sqrt(2 / (9 * acc)), cast(3 as double))', 5)} as q5 from observations"))
def s38_chi_square_quantile(spark, d):
    return observations(spark, d).select("event_id", at(radio.chi_square_quantile(F.lit(1.645), F.col("acc")), 5).alias("q5"))


@query(
    sql(
        "fixes",
        f"""select event_id, {at_sql('sqrt(greatest(cast(0 as double), (acc + 9) / 2 + sqrt((acc - 9) / 2 * ((acc - 9) / 2) + 4)))', 5)} as major5, {at_sql('sqrt(greatest(cast(0 as double), (acc + 9) / 2 - sqrt((acc - 9) / 2 * ((acc - 9) / 2) + 4)))', 5)} as minor5,
        {at_sql('fmod(90 - degrees(atan2(cast(4 as double), acc - 9)) / 2 + 180, cast(180 as double))', 4)} as axis4 from fixes""",
    )
)
def s39_ellipse(spark, d):
    a, b, axis = geo.ellipse(F.col("acc"), F.lit(2.0), F.lit(9.0))
    return fixes(spark, d).select("event_id", at(a, 5).alias("major5"), at(b, 5).alias("minor5"), at(axis, 4).alias("axis4"))


@query(sql("passes", "select uid, case when confidence >= 85 then 'A' when confidence >= 70 then 'B' when confidence >= 55 then 'C' when confidence >= 40 then 'D' when confidence >= 20 then 'E' else 'F' end as letter from passes"))
def s40_letter(spark, d):
    return passes(spark, d).select("uid", radio.letter(F.col("confidence")).alias("letter"))


@query("select c_custkey, concat_ws(', ', nullif(concat_ws(' ', cast(c_custkey as varchar), nullif(c_name, '')), ''), nullif(concat_ws(' ', case when c_nationkey > 5 then cast(c_nationkey as varchar) end, c_mktsegment), '')) as line from customer")
def s41_address(spark, d):
    key = F.col("c_custkey").cast("string")
    return read(spark, d, "customer").select("c_custkey", text.address(F.col("c_name"), key, F.col("c_mktsegment"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey").cast("string"))).alias("line"))


@query("select c_custkey, c_name as place, case when c_custkey % 3 > 0 then 'Town' end as city, case when c_custkey % 3 = 2 then 'Region' end as region from customer")
def s45_place_parts(spark, d):
    k = F.col("c_custkey") % 3
    made = F.concat(F.col("c_name"), F.when(k > 0, ", Town").otherwise(""), F.when(k == 2, " , Region").otherwise(""))
    return read(spark, d, "customer").select("c_custkey", text.place_parts(made).alias("p")).select("c_custkey", "p.place", "p.city", "p.region")


@query("select event_id, case when event_id < 1000 then event_id || ' m' else printf('%.1f', floor(event_id / cast(100 as double) + 0.5) / 10) || ' km' end as text, case when f < 100 then cast(floor(f) as bigint) || ' ft' when f < 528 then cast(floor(f / 10) as bigint) * 10 || ' ft' when f / 5280 < 10 then printf('%.1f', floor(f / 5280 * 10 + 0.5) / 10) || ' mi' else cast(floor(f / 5280 + 0.5) as bigint) || ' mi' end as miles from (select event_id, event_id * cast(3.28084 as double) as f from events)")
def s46_units(spark, d):
    return read(spark, d, "events").select("event_id", text.metric(F.col("event_id").cast("double")).alias("text"), text.imperial(F.col("event_id").cast("double")).alias("miles"))


@query(sql("cams", f"select id, {at_sql('(dir + 1) * (dir + 2) / cast(2 as double)', 3)} as area3 from cams"))
def s47_ring_area(spark, d):
    """Area of a right triangle with the corner at the origin."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    z = F.lit(0)
    ring = F.array(p(z, z), p(F.col("dir") + 1, z), p(z, F.col("dir") + 2), p(z, z))
    return cams(spark, d).select("id", at(geo.ring_area(ring)).alias("area3"))


@query(sql("cams", "select id, cast(10 as bigint) + 1 as corners, true as holds_front, false as holds_back from cams"))
def s48_cone_polygon(spark, d):
    """A field of view as a ring holds what is in front and not what is behind."""
    zero = F.lit(0.0)
    ring = geo.cone_ring(zero, zero, F.col("dir").cast("double"), 30.0, 40.0)
    ahead = (20 * F.sin(F.radians("dir")), 20 * F.cos(F.radians("dir")))
    return cams(spark, d).withColumn("ring", ring).select("id", F.size("ring").cast("long").alias("corners"), geo.in_ring(ahead[0], ahead[1], F.col("ring")).alias("holds_front"), geo.in_ring(-ahead[0], -ahead[1], F.col("ring")).alias("holds_back"))


@query(sql("cams", f"select id, {at_sql('case when dir < 10 then sqrt(cast((dir - 10) * (dir - 10) + 25 as double)) when dir > 90 then sqrt(cast((dir - 90) * (dir - 90) + 25 as double)) else cast(5 as double) end')} as mm from cams"))
def s49_point_to_segment(spark, d):
    lit = F.lit
    return cams(spark, d).select("id", at(geo.segment_distance(F.col("dir").cast("double"), lit(5.0), lit(10.0), lit(0.0), lit(90.0), lit(0.0))).alias("mm"))


@query(sql("cams", f"select id, {at_sql('greatest(cast(0 as double), (dir - 40) / cast(400 as double))', 6)} as low6, {at_sql('least(cast(1 as double), (dir + 40) / cast(400 as double))', 6)} as high6 from cams"))
def s50_circle_on_segment(spark, d):
    lit = F.lit
    low, high = geo.circle_interval(F.col("dir").cast("double"), lit(30.0), lit(50.0), lit(0.0), lit(0.0), lit(400.0), lit(0.0))
    return cams(spark, d).select("id", at(low, 6).alias("low6"), at(high, 6).alias("high6"))


@query(sql("cams", f"select id, {at_sql('3 * cos(radians(dir)) + 4 * sin(radians(dir))')} as east, {at_sql('4 * cos(radians(dir)) - 3 * sin(radians(dir))')} as north from cams"))
def s51_rotation(spark, d):
    e, n = geo.rotated(F.lit(3.0), F.lit(4.0), F.col("dir"))
    return cams(spark, d).select("id", at(e).alias("east"), at(n).alias("north"))


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def s52_json_field(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select s_suppkey, replace(replace(upper(s_name), '#', ''), '0', '') as plain from supplier")
def s53_text_normalise(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", F.replace(F.replace(F.upper("s_name"), F.lit("#"), F.lit("")), F.lit("0"), F.lit("")).alias("plain"))


@query(sql("cams", f"select id, {at_sql('case when dir < 100 then cast((100 - dir) * 10 as double) / (2000 - (100 - dir) * 10) else cast(0 as double) end', 6)} as iou6 from cams"))
def s54_box_overlap(spark, d):
    x, lit = F.col("dir").cast("double"), F.lit
    return cams(spark, d).select("id", at(radio.overlap_of_boxes((lit(0.0), lit(0.0), lit(100.0), lit(10.0)), (x, lit(0.0), x + 100, lit(10.0))), 6).alias("iou6"))


@query("select event_id, coalesce(nullif(upper(replace(event_type, 'c', 'k')), 'VIEW'), '') as t, abs(cast(value as integer)) as v, epoch_us(ts) // 1000000 as s from events")
def s57_builtins(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(F.nullif(F.upper(F.replace("event_type", F.lit("c"), F.lit("k"))), F.lit("VIEW")), F.lit("")).alias("t"), F.abs(F.rint("value").cast("int")).alias("v"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
