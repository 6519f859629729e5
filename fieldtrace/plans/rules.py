"""Queries of ordered rules over tags (S-09, S-10, S-42, S-43) and of the trust in an asset (T-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio, rules
from ..operators.joins import grid_join
from ..sources.views import cams, observations, read, sql
from .catalog import query
from .common import at, at_sql, hav_sql

_HELP = ["amenity=hospital", "healthcare=hospital", "amenity=clinic", "amenity=doctors", "healthcare=doctor", "building=hospital", "amenity=dentist"]
#: What the parts stand for: the main tags of an object, what it may have beside them, and the beginnings of names.
_MAIN = _HELP * 6 + [
    "man_made=surveillance", "brand=Flock", "camera:model=Sparrow", "amenity=police", "amenity=fire_station", "shop=chemist", "amenity=veterinary", "amenity=library", "amenity=townhall", "amenity=courthouse", "office=government|government=transportation", "office=government",
    "amenity=kindergarten", "amenity=community_centre", "leisure=playground", "leisure=dog_park", "leisure=garden", "leisure=swimming_pool", "leisure=swimming_pool|access=private", "leisure=sports_centre|sport=swimming;tennis", "leisure=sports_centre|sport=trampoline", "playground=splash_pad",
    "tourism=aquarium", "tourism=gallery", "tourism=theme_park", "shop=ice_cream", "amenity=cinema", "leisure=bowling_alley", "leisure=amusement_arcade", "leisure=pitch|sport=skateboard", "natural=beach", "leisure=picnic_table", "boundary=national_park", "amenity=fuel|fuel:lpg=yes",
    "amenity=fuel|fuel:lpg=yes|fuel:diesel=yes", "shop=gas", "amenity=charging_station", "shop=wholesale", "amenity=pub", "amenity=cafe", "tourism=camp_site", "amenity=sanitary_dump_station", "amenity=water_point", "amenity=toilets|shower=yes", "amenity=toilets", "amenity=laundry", "shop=tyres",
    "amenity=car_wash", "shop=trade", "amenity=parcel_locker", "highway=services", "internet_access=wlan", "highway=residential", "amenity=bench",
]
_MORE = ["", "|emergency=yes", "|emergency=no", "|healthcare:speciality=general; Paediatrics", "|healthcare:speciality=paediatrics|emergency=yes", "|healthcare:speciality=child_psychiatry;addiction", "|healthcare:speciality=general;pediatric|emergency=yes", "|opening_hours=24/7", "|urgent_care=yes", "|healthcare:speciality=paediatric_emergency", "|health_specialty:paediatrics=yes|opening_hours=24/7"]
_NAMES = ["Saint Anne", "Children’s Hospital", "Kids Urgent Care", "Children's Cardiology", "Child and Adolescent Center", "Pediatric Dental", "Walk-in Clinic", "County DMV", "Flock Safety", "Shriners for Children", "Paediatrics East", "General", ""]
_CAMERAS = [
    "surveillance:type=ALPR", "surveillance:type=camera; ALRP", "surveillance:type=camera", "surveillance:type=camera|contact:webcam=http", "surveillance:type=camera|manufacturer=Flock Safety", "highway=speed_camera", "enforcement=maxspeed", "surveillance:type=gunshot_detector", "man_made=monitoring_station|monitoring:traffic=yes",
    "surveillance=ANPR", "camera:type=alpr", "",
]
_MODELS = ["Flock Falcon", "Falcon LR", "Raven", "Motorola L6Q", "Genetec AutoVu", "Verkada CB61", "Camera", "traffic cam 7", "Sparrow", "Rekor Edge", "long-range LPR", ""]


def _pick(key: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def _pick_sql(key: str, values: list[str]) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[1 + ({key}) % {len(values)}]"


def _tags(text: Column) -> Column:
    """A map of ``key=value`` pairs between bars."""
    return F.when(text == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit("[|]"), F.lit("=")))


def _g(key: str) -> str:
    return f"regexp_extract('|' || tags, '\\|{key}=([^|]*)', 1)"


def _in(key: str, values: str) -> str:
    return f"{_g(key)} in ({', '.join(repr(v) for v in values.split())})"


def tagged_places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(_pick(k, _MAIN), _pick(F.floor(k / 7), _MORE), F.lit("|name="), _pick(F.floor(k / 5), _NAMES), F.lit(" "), F.col("p_name"))
    return read(spark, d, "part").select(k, _tags(text).alias("tags"))


def tagged_cameras(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    source = _pick(F.floor(k / 3), ["osm", "deflock", "community", "suspected"])
    return read(spark, d, "part").select(k, F.concat(F.when(k % 3 == 0, "osm:node/").otherwise("list:"), k.cast("string")).alias("id"), source.alias("source"), _pick(F.floor(k / 2), _MODELS).alias("model"), _tags(_pick(k, _CAMERAS)).alias("tags"))


_PLACES_SQL = f"with t as (select p_partkey, {_pick_sql('p_partkey', _MAIN)} || {_pick_sql('p_partkey // 7', _MORE)} || '|name=' || {_pick_sql('p_partkey // 5', _NAMES)} || ' ' || p_name as tags from part), n as (select *, lower({_g('name')}) as nm from t)"
_CATEGORY_SQL = f"""case when {_in('man_made', 'surveillance')} or {_in('surveillance', 'camera outdoor')} or regexp_matches(lower({_g('camera:model')}), 'falcon|condor|sparrow') or contains(lower({_g('brand')}), 'flock') or contains(nm, 'flock safety') or contains(nm, 'flock camera') then 'surveillance'
 when {_in('amenity', 'police')} then 'police' when {_in('amenity', 'fire_station')} then 'fire' when {_in('amenity', 'hospital')} or {_in('healthcare', 'hospital')} then 'health'
 when {_in('amenity', 'clinic doctors urgent_care')} or {_in('healthcare', 'urgent_care clinic doctor')} then 'urgent' when {_in('amenity', 'pharmacy')} or {_in('shop', 'chemist')} or {_in('healthcare', 'pharmacy')} then 'pharmacy'
 when {_in('amenity', 'dentist')} or {_in('healthcare', 'dentist')} then 'dentist' when {_in('amenity', 'veterinary')} then 'vet' when {_in('amenity', 'library')} then 'library' when {_in('amenity', 'townhall')} then 'townhall' when {_in('amenity', 'courthouse')} then 'court'
 when {_in('office', 'government')} and ({_in('government', 'transportation vehicle_registration driving_license')} or regexp_matches(nm, 'dmv|motor vehicle|driver')) then 'dmv' when {_in('amenity', 'school kindergarten')} then 'school' when {_in('amenity', 'community_centre')} then 'community'
 when {_in('leisure', 'playground')} then 'playground' when {_in('leisure', 'dog_park')} then 'dogpark' when {_in('leisure', 'park garden')} then 'park'
 when {_in('leisure', 'swimming_pool swimming_area')} or ({_in('leisure', 'sports_centre')} and contains({_g('sport')}, 'swimming')) then case when {_in('access', 'private')} then null else 'pool' end
 when {_in('leisure', 'water_park')} or {_in('playground', 'splash_pad')} then 'splash' when {_in('tourism', 'zoo aquarium')} then 'zoo' when {_in('tourism', 'museum gallery')} then 'museum' when {_in('tourism', 'theme_park')} then 'themepark' when {_in('amenity', 'ice_cream')} or {_in('shop', 'ice_cream')} then 'icecream'
 when {_in('amenity', 'cinema')} then 'cinema' when {_in('leisure', 'bowling_alley')} then 'bowling' when {_in('leisure', 'amusement_arcade')} then 'arcade' when {_in('leisure', 'trampoline_park')} or ({_in('leisure', 'sports_centre')} and contains({_g('sport')}, 'trampoline')) then 'trampoline'
 when {_in('leisure', 'skatepark')} or ({_in('leisure', 'pitch')} and contains({_g('sport')}, 'skateboard')) then 'skate' when {_in('natural', 'beach')} or {_in('leisure', 'beach_resort')} then 'beach' when {_in('tourism', 'picnic_site')} or {_in('leisure', 'picnic_table')} then 'picnic'
 when {_in('highway', 'trailhead')} or {_in('leisure', 'nature_reserve')} or {_in('boundary', 'national_park')} then 'trail' when {_in('amenity', 'fuel')} then case when {_in('fuel:lpg', 'yes')} and not {_in('fuel:diesel', 'yes')} and not {_in('fuel:octane_87', 'yes')} then 'propane' else 'fuel' end
 when {_in('shop', 'gas bottled_gas')} then 'propane' when {_in('amenity', 'charging_station')} then 'charging' when {_in('shop', 'supermarket convenience greengrocer wholesale')} then 'grocery' when {_in('amenity', 'restaurant fast_food food_court pub')} then 'food' when {_in('amenity', 'cafe')} then 'cafe'
 when {_in('tourism', 'camp_site caravan_site')} then 'camp' when {_in('amenity', 'sanitary_dump_station')} then 'dump' when {_in('amenity', 'drinking_water water_point')} then 'water' when {_in('amenity', 'shower')} or ({_in('amenity', 'toilets')} and {_in('shower', 'yes')}) then 'shower' when {_in('amenity', 'toilets')} then 'toilets'
 when {_in('shop', 'laundry')} or {_in('amenity', 'laundry')} then 'laundry' when {_in('shop', 'car_repair tyres car_parts')} or {_in('amenity', 'vehicle_inspection')} then 'repair' when {_in('amenity', 'car_wash')} then 'carwash' when {_in('shop', 'hardware doityourself outdoor trade')} then 'hardware'
 when {_in('amenity', 'post_office parcel_locker')} then 'post' when {_in('highway', 'rest_area services')} then 'rest' when {_in('internet_access', 'wlan yes')} then 'wifi' end"""


@query(f"{_PLACES_SQL} select p_partkey, {_CATEGORY_SQL} as cat from n")
def s42_place_categories(spark, d):
    """The category of each place by the ordered rules over its tags."""
    return tagged_places(spark, d).select("p_partkey", rules.place_category(F.col("tags")).alias("cat"))


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SQ = "''"
_PEDIATRIC_SQL = f"""{_PLACES_SQL}, w as (select p_partkey, tags, nm, replace(nm, '’', '''') as name2, list_filter(list_transform(string_split(lower({_g('healthcare:speciality')}), ';'), lambda x: trim(x)), lambda x: x <> '') as listed from n),
 f as (select *, {_CATEGORY_SQL} as base, {_in('amenity', 'hospital')} or {_in('healthcare', 'hospital')} as hospital, {_in('amenity', 'clinic doctors urgent_care')} or {_in('healthcare', 'clinic doctor urgent_care')} as clinic,
  {_in('health_specialty:paediatrics', 'yes')} or {_in('emergency:paediatric', 'yes')} or list_has_any(listed, {_quoted(rules.CHILDREN)}) or len(list_filter(listed, lambda x: regexp_matches(x, '^pa?ediatric_') and not contains(x, 'dent'))) > 0 as field,
  regexp_matches(name2, '{rules.CHILDREN_NAME.replace("'", _SQ)}') as named, list_contains(listed, 'general') as general,
  (len(listed) > 0 and len(list_filter(listed, lambda x: not list_contains({_quoted(rules.NO_EMERGENCY)}, x))) = 0) or regexp_matches(name2, '{rules.OTHER_NAME}') as other,
  {_in('amenity', 'dentist')} or {_in('healthcare', 'dentist')} or contains(name2, 'dent') or len(list_filter(listed, lambda x: contains(x, 'dent'))) > 0 as teeth,
  {_in('emergency', 'yes')} or {_in('emergency:paediatric', 'yes')} or list_has_any(listed, ['emergency', 'paediatric_emergency', 'pediatric_emergency']) as er, {_in('emergency', 'no')} as no_er,
  {_in('urgent_care', 'yes')} or list_has_any(listed, ['urgent', 'urgent_care']) or regexp_matches(name2, '{rules.URGENT_NAME}') as urgent, {_in('opening_hours', '24/7')} as always, {_in('building', 'hospital')} as building from w),
 r as (select *, case when hospital and (field or named) and not (general and not named) then case when no_er then 1 when other then 2 when er then 3 else 4 end when hospital and field and general and not named and er then 5
  when building and not hospital and named and not other then 4 when clinic and (field or named) and urgent and not teeth then 6 else 0 end as k from f),
 c as (select *, case when k in (1, 2, 5) then 'health' when k in (3, 4) then 'peds_er' when k = 6 then 'peds_urgent' else base end as cat from r),
 e as (select *, case when cat = 'health' or k = 3 then case when er then 'yes' when no_er then 'no' end end as room from c),
 g as (select *, coalesce(room, '') = 'yes' or (coalesce(cat, '') = 'health' and always and coalesce(room, '') <> 'no') as emergency from e)
 select p_partkey, cat, case k when 3 then 1 when 4 then 2 when 5 then 3 when 6 then 4 else 0 end as tier, room as er, emergency,
 case when k = 1 then 'children''s hospital · no ER' when k = 3 then 'pediatric ER' when k = 4 then case when always then 'likely ER (24/7) — call ahead' else 'ER not confirmed — call ahead' end when k = 5 then 'ER · pediatrics dept.' when k = 6 then 'not an ER'
 when cat = 'health' and emergency then 'emergency dept.' when cat = 'health' and room = 'no' then 'no ER' end as detail from g"""


@query(_PEDIATRIC_SQL)
def s43_pediatric_places(spark, d):
    """Which help for children a place gives, from its tags and names."""
    return tagged_places(spark, d).select("p_partkey", rules.pediatric(F.col("tags")).alias("p")).select("p_partkey", "p.*")


_CAMERAS_SQL = f"with t as (select p_partkey, case when p_partkey % 3 = 0 then 'osm:node/' else 'list:' end || p_partkey as id, {_pick_sql('p_partkey // 3', ['osm', 'deflock', 'community', 'suspected'])} as source, {_pick_sql('p_partkey // 2', _MODELS)} as model, {_pick_sql('p_partkey', _CAMERAS)} as tags from part)"


@query(
    f"""{_CAMERAS_SQL}, n as (select *, regexp_matches(lower(model), '{rules.READERS}') as reader, list_transform(string_split_regex(upper({_g('surveillance:type')}), '[;,]'), lambda x: trim(x)) as kinds from t)
    select p_partkey, case when not (starts_with(id, 'osm:') or source = 'osm') then case when regexp_matches(lower(model), '\\braven\\b|gunshot') and not reader then 'not_camera' when regexp_matches(lower(model), '{rules.NO_READERS}') and not reader then 'cctv' else 'alpr' end
    when tags = '' then case when source = 'deflock' or reader then 'alpr' else 'cctv' end
    when {_in('highway', 'speed_camera')} or {_g('enforcement')} <> '' then 'enforcement' when list_has_any(kinds, ['GUNSHOT_DETECTOR', 'GUARD']) or ({_in('man_made', 'monitoring_station')} and {_g('monitoring:traffic')} <> '') then 'not_camera'
    when list_has_any(kinds, {_quoted(rules.READER_TYPES)}) or lower({_g('camera:type')}) = 'alpr' or lower({_g('surveillance')}) = 'anpr' then 'alpr' when list_contains(kinds, 'CAMERA') and {_g('contact:webcam')} <> '' then 'webcam'
    when list_contains(kinds, 'CAMERA') and contains(lower({_g('manufacturer')}), 'flock') then 'ptz' else 'cctv' end as kind from n"""
)
def s09_camera_kinds(spark, d):
    """What each camera is, by its tags where it comes from the map, else by its model."""
    return tagged_cameras(spark, d).select("p_partkey", rules.camera_kind(F.col("id"), F.col("source"), F.col("model"), F.col("tags")).alias("kind"))


@query(
    f"""{_CAMERAS_SQL}, n as (select p_partkey, lower(model || ' ' || {_g('manufacturer')}) as m from t)
    select p_partkey, v.half as half, v.a as least_m, v.b as most_m, v.make as make from (select p_partkey, case when regexp_matches(m, 'falcon[ -]*(lr|long)|long[- ]range') then struct_pack(half := 7.0::double, a := 15.0::double, b := 76.0::double, make := 'long range')
    when regexp_matches(m, 'motorola|vigilant|\\bl5f\\b|\\bl6q\\b') then struct_pack(half := 12.0::double, a := 8.0::double, b := 23.0::double, make := 'vigilant') when regexp_matches(m, 'genetec|autovu|sharpv') then struct_pack(half := 12.0::double, a := 3.0::double, b := 45.0::double, make := 'autovu')
    when contains(m, 'verkada') then struct_pack(half := 22.0::double, a := 3.0::double, b := 20.0::double, make := 'verkada') when regexp_matches(m, 'flock|falcon|sparrow') then struct_pack(half := 10.0::double, a := 6.0::double, b := 25.0::double, make := 'falcon')
    else struct_pack(half := 12.5::double, a := 5.0::double, b := 35.0::double, make := 'unknown') end as v from n)"""
)
def s10_camera_views(spark, d):
    """Half of the angle and the distances that each make of camera sees at."""
    c = tagged_cameras(spark, d)
    return c.select("p_partkey", rules.camera_view(F.concat_ws(" ", "model", F.col("tags")["manufacturer"])).alias("v")).select("p_partkey", "v.*")


#: Log-odds of a class of source, of a year since the last edit, of a strong and a weak radio sign within so many metres, and of a user who was there.
PRIORS, A_YEAR, STRONG, WEAK, SIGN_M, PRESENT, ABSENT = {"osm": 2.2, "deflock": 2.2, "community": 1.0, "suspected": -0.5}, -0.25, 1.5, 0.7, 60.0, 1.0, -1.5
_NOW = 1_735_689_600


@query(
    sql(
        "cams observations",
        f""", c as (select *, {_pick_sql('id', ['osm', 'deflock', 'community', 'suspected', 'other'])} as source, case when id % 6 <> 5 then {_NOW} - (id * 7919) % 3000 * 86400 end as edited, {_pick_sql('id // 5', ['', 'present', 'absent', ''])} as verdict from cams),
        s as (select lat, lon, event_id % 4 as tier from observations where event_id % 37 = 0), r as (select c.id, max(s.tier) as tier from c join s on abs(c.lat - s.lat) < 0.001 and abs(c.lon - s.lon) < 0.001 and {hav_sql('s.lat', 's.lon', 'c.lat', 'c.lon')} <= 60 group by c.id),
        o as (select c.id, cast(case source when 'osm' then 2.2 when 'deflock' then 2.2 when 'community' then 1.0 when 'suspected' then -0.5 else 0 end as double) + coalesce(cast(-0.25 as double) * ({_NOW} - edited) / cast(31557600 as double), 0) + cast(case when tier >= 2 then 1.5 when tier >= 0 then 0.7 else 0 end as double) + cast(case verdict when 'present' then 1.0 when 'absent' then -1.5 else 0 end as double) as odds from c left join r on r.id = c.id)
        select id, {at_sql('odds', 6)} as odds6, {at_sql('1 / (1 + exp(-odds))', 9)} as trust9 from o""",
    )
)
def t17_asset_trust(spark, d):
    """How sure it is that an asset is there: its source, the age of the last edit, the best radio sign within 60 m, and what a user said."""
    c = cams(spark, d).withColumns({"source": _pick(F.col("id"), ["osm", "deflock", "community", "suspected", "other"]), "edited": F.when(F.col("id") % 6 != 5, _NOW - (F.col("id") * 7919) % 3000 * 86400), "verdict": _pick(F.floor(F.col("id") / 5), ["", "present", "absent", ""])})
    signs = observations(spark, d).where("event_id % 37 = 0").select("lat", "lon", (F.col("event_id") % 4).alias("tier"))
    best = grid_join(signs, c.select("id", "lat", "lon"), SIGN_M).groupBy("id").agg(F.max("tier").alias("tier"))
    prior = F.coalesce(*(F.when(F.col("source") == s, v) for s, v in PRIORS.items()), F.lit(0.0))
    age = F.coalesce(F.when(F.col("edited") < _NOW, A_YEAR * (_NOW - F.col("edited")) / 31_557_600.0), F.lit(0.0))
    sign = F.when(F.col("tier") >= 2, STRONG).when(F.col("tier") >= 0, WEAK).otherwise(0.0)
    user = F.when(F.col("verdict") == "present", PRESENT).when(F.col("verdict") == "absent", ABSENT).otherwise(0.0)
    o = c.join(best, "id", "left").select("id", (prior + age + sign + user).alias("odds"))
    return o.select("id", at(F.col("odds"), 6).alias("odds6"), at(radio.sigmoid(F.col("odds")), 9).alias("trust9"))
