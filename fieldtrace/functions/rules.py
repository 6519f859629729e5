"""Ordered rules over tags (a map of strings): what kind of place or camera an object is, how sure an emergency room is, and what a make of camera sees.

A missing map, tag or name meets no rule. Tags are compared as they are, names and makes in lower case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tag(tags: Column, key: str) -> Column:
    return F.coalesce(tags[key], F.lit(""))


def _is(tags: Column, **keys: str) -> Column:
    """Whether a tag has one of its listed values; ``__`` in a key stands for a colon."""
    return reduce(Column.__or__, (_tag(tags, k.replace("__", ":")).isin(v.split()) for k, v in keys.items()))


def _first(rules: list[tuple[str | None, Column]]) -> Column:
    return reduce(lambda c, r: c.when(r[1], F.lit(r[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0])))


def place_category(tags: Column) -> Column:
    """The category of a place by the first rule that it meets; null if none or if it is a private pool."""
    t = lambda **k: _is(tags, **k)
    low = lambda k: F.lower(_tag(tags, k))
    holds = lambda k, *words: reduce(Column.__or__, (_tag(tags, k).contains(w) for w in words))
    name, sports = low("name"), t(leisure="sports_centre")
    # fixed values: categories with the tags that give them, in order
    watch = t(man_made="surveillance", surveillance="camera outdoor") | low("surveillance:type").contains("alpr") | low("camera:type").contains("alpr") | low("camera:model").rlike("falcon|condor|sparrow")
    watch |= low("brand").contains("flock") | low("operator").contains("flock") | low("manufacturer").contains("flock") | name.rlike("flock (safety|camera)")
    swims = t(leisure="swimming_pool swimming_area") | (sports & holds("sport", "swimming"))
    rules = [
        ("surveillance", watch), ("police", t(amenity="police")), ("fire", t(amenity="fire_station")), ("health", t(amenity="hospital", healthcare="hospital")),
        ("urgent", t(amenity="clinic doctors urgent_care", healthcare="urgent_care clinic doctor")), ("pharmacy", t(amenity="pharmacy", shop="chemist", healthcare="pharmacy")), ("dentist", t(amenity="dentist", healthcare="dentist")), ("vet", t(amenity="veterinary")),
        ("library", t(amenity="library")), ("townhall", t(amenity="townhall")), ("court", t(amenity="courthouse")),
        ("dmv", t(office="government") & (t(government="transportation vehicle_registration driving_license") | name.rlike("dmv|motor vehicle|driver"))),
        ("school", t(amenity="school kindergarten")), ("community", t(amenity="community_centre")),
        ("playground", t(leisure="playground")), ("dogpark", t(leisure="dog_park")), ("park", t(leisure="park garden")), (None, swims & t(access="private")), ("pool", swims), ("splash", t(leisure="water_park", playground="splash_pad", playground__splash_pad="yes")),
        ("zoo", t(tourism="zoo aquarium")), ("museum", t(tourism="museum gallery")), ("themepark", t(tourism="theme_park")), ("icecream", t(amenity="ice_cream", shop="ice_cream")), ("cinema", t(amenity="cinema")), ("bowling", t(leisure="bowling_alley")), ("arcade", t(leisure="amusement_arcade")),
        ("trampoline", t(leisure="trampoline_park") | (sports & holds("sport", "trampoline"))), ("skate", t(leisure="skatepark") | (t(leisure="pitch") & holds("sport", "skateboard"))), ("beach", t(natural="beach", leisure="beach_resort")),
        ("picnic", t(tourism="picnic_site", leisure="picnic_table")), ("trail", t(highway="trailhead", leisure="nature_reserve", boundary="national_park")),
        ("propane", t(amenity="fuel") & t(fuel__lpg="yes") & ~t(fuel__diesel="yes", fuel__octane_87="yes")), ("fuel", t(amenity="fuel")), ("propane", t(shop="gas bottled_gas")), ("charging", t(amenity="charging_station")),
        ("grocery", t(shop="supermarket convenience greengrocer wholesale")), ("food", t(amenity="restaurant fast_food food_court pub")), ("cafe", t(amenity="cafe")), ("camp", t(tourism="camp_site caravan_site")), ("dump", t(amenity="sanitary_dump_station")), ("water", t(amenity="drinking_water water_point")),
        ("shower", t(amenity="shower") | (t(amenity="toilets") & t(shower="yes"))), ("toilets", t(amenity="toilets")), ("laundry", t(shop="laundry", amenity="laundry")), ("repair", t(shop="car_repair tyres car_parts", amenity="vehicle_inspection")), ("carwash", t(amenity="car_wash")),
        ("hardware", t(shop="hardware doityourself outdoor trade")), ("post", t(amenity="post_office parcel_locker")), ("rest", t(highway="rest_area services")), ("wifi", t(internet_access="wlan yes")),
    ]
    return _first(rules)


# fixed values: specialities of children, specialities that are never an emergency room, and patterns of names
CHILDREN = "paediatrics pediatrics paediatric pediatric paediatrician pediatrician specialist_pediatrician".split()
NO_EMERGENCY = (
    "psychiatry child_psychiatry paediatric_psychiatry pediatric_psychiatry psychotherapy psychology addiction substance_abuse rehabilitation physiotherapy occupational_therapy speech_therapy "
    "dentistry orthodontics paediatric_dentistry pediatric_dentistry oral_surgery hospice palliative dialysis ophthalmology dermatology fertility"
).split()
CHILDREN_NAME = r"\b(children'?s?|child|pa?ediatric\w*|kids?)\b"
OTHER_NAME = (
    r"rehab|behavio|psychiat|hospice|home\b|dental|outpatient|specialty (care|center)|medical office|pavilion|therapy|surgery center|shriners|medical building|office building|cent(er|re) for children|adolescent|residential"
    r"|\b(cardiology|oncology|hematology|neurology|neurosurgery|orthopa?edics?|radiology|imaging|urology|dermatology|endocrinology|gastroenterology|pulmonology|nephrology|rheumatology|audiology|ophthalmology|sports medicine|infusion|dialysis|laboratory)\b"
)
URGENT_NAME = r"urgent|express care|after.?hours|walk.?in|immediate care"


def pediatric(tags: Column) -> Column:
    """(cat, tier, er, emergency, detail) of a place: which help children get there.

    Tier 1 is a children's hospital with an emergency room, 2 one whose room isn't confirmed, 3 a general emergency room with a department for children, 4 urgent care for
    children, 0 anything else. ``er`` is yes, no or null; ``emergency`` says that a room is there or, open day and night, likely.
    """
    t = lambda **k: _is(tags, **k)
    listed = F.filter(F.transform(F.split(F.lower(_tag(tags, "healthcare:speciality")), ";"), lambda s: F.trim(s)), lambda s: s != "")
    name = F.replace(F.lower(F.concat_ws(" ", *(_tag(tags, k) for k in ("name", "alt_name", "official_name")))), F.lit("’"), F.lit("'"))
    has = lambda *values: F.arrays_overlap(listed, F.array(*map(F.lit, values)))

    hospital, clinic = t(amenity="hospital", healthcare="hospital"), t(amenity="clinic doctors urgent_care", healthcare="clinic doctor urgent_care")
    by_field = t(health_specialty__paediatrics="yes", emergency__paediatric="yes") | has(*CHILDREN) | F.exists(listed, lambda s: s.rlike("^pa?ediatric_") & ~s.contains("dent"))
    by_name = name.rlike(CHILDREN_NAME)
    for_children, general = by_field | by_name, has("general")
    other = ((F.size(listed) > 0) & F.forall(listed, lambda s: s.isin(NO_EMERGENCY))) | name.rlike(OTHER_NAME)
    teeth = t(amenity="dentist", healthcare="dentist") | F.exists(listed, lambda s: s.contains("dent")) | name.contains("dent")
    er, no_er = t(emergency="yes", emergency__paediatric="yes") | has("emergency", "paediatric_emergency", "pediatric_emergency"), t(emergency="no")
    urgent, always = t(urgent_care="yes") | has("urgent", "urgent_care") | name.rlike(URGENT_NAME), F.trim(_tag(tags, "opening_hours")) == "24/7"

    own = hospital & for_children & (by_name | ~general)
    building = t(building="hospital") & ~hospital & by_name & ~other
    cases = [
        ("closed", own & no_er), ("other", own & other), ("sure", own & er), ("open", own), ("mixed", hospital & by_field & general & ~by_name & er), ("open", building), ("urgent", clinic & for_children & urgent & ~teeth),
    ]
    # bound to one variable, so that the rules are evaluated once a row however often their outcome is asked for
    facts = F.struct(F.coalesce(_first(cases), F.lit("else")).alias("case"), place_category(tags).alias("base"), er.alias("er"), no_er.alias("no_er"), always.alias("always"))
    with_cat = F.transform(F.array(facts), lambda f: f.withField("cat", F.when(f["case"].isin("closed", "other", "mixed"), "health").when(f["case"].isin("sure", "open"), "peds_er").when(f["case"] == "urgent", "peds_urgent").otherwise(f["base"])))
    with_room = F.transform(with_cat, lambda f: f.withField("room", F.when((f["cat"] == "health") | (f["case"] == "sure"), F.when(f["er"], "yes").when(f["no_er"], "no"))))
    return F.transform(with_room, _outcome)[0]


def _outcome(f: Column) -> Column:
    case, health, room = f["case"], F.coalesce(f["cat"] == "health", F.lit(False)), F.coalesce(f["room"], F.lit(""))
    tier = F.when(case == "sure", 1).when(case == "open", 2).when(case == "mixed", 3).when(case == "urgent", 4).otherwise(0)
    emergency = (room == "yes") | (health & f["always"] & (room != "no"))
    detail = (
        F.when(case == "closed", "children's hospital · no ER").when(case == "sure", "pediatric ER").when(case == "open", F.when(f["always"], "likely ER (24/7) — call ahead").otherwise("ER not confirmed — call ahead"))
        .when(case == "mixed", "ER · pediatrics dept.").when(case == "urgent", "not an ER").when(health & emergency, "emergency dept.").when(health & (room == "no"), "no ER")
    )
    return F.struct(f["cat"].alias("cat"), tier.alias("tier"), f["room"].alias("er"), emergency.alias("emergency"), detail.alias("detail"))


# fixed values: models that read plates, words of models that don't, and types of readers with their misspellings
READERS = r"\b(alpr|lpr|anpr)\b|plate|falcon|sparrow|autovu|sharpv|vigilant|elsag|platesmart|neology|rekor|l5f|l6q"
NO_READERS = r"^\s*camera\s*$|other surveillance|traffic cam|cctv|webcam"
READER_TYPES = "ALPR ANPR ALRP APLR AMPR".split()


def camera_kind(id_: Column, source: Column, model: Column, tags: Column) -> Column:
    """alpr, webcam, ptz, cctv, enforcement or not_camera. Objects of the map (id osm:…, or that source) go by their tags, all others by the model's name."""
    text, own = F.lower(F.coalesce(model, F.lit(""))), F.coalesce(source, F.lit(""))
    reader = text.rlike(READERS)
    mapped = F.coalesce(id_.startswith("osm:"), F.lit(False)) | (F.lower(own) == "osm")
    listed = F.when(text.rlike(r"\braven\b|gunshot") & ~reader, "not_camera").when(text.rlike(NO_READERS) & ~reader, "cctv").otherwise("alpr")

    types = F.transform(F.split(F.upper(_tag(tags, "surveillance:type")), "[;,]"), lambda s: F.trim(s))
    has = lambda *values: F.arrays_overlap(types, F.array(*map(F.lit, values)))
    low = lambda k: F.lower(_tag(tags, k))
    webcam = _tag(tags, "contact:webcam").startswith("http") | _tag(tags, "webcam").startswith("http")
    by_tags = _first([
        ("enforcement", (_tag(tags, "highway") == "speed_camera") | (_tag(tags, "enforcement") != "")),
        ("not_camera", has("GUNSHOT_DETECTOR", "GUARD") | ((_tag(tags, "man_made") == "monitoring_station") & (_tag(tags, "monitoring:traffic") != ""))),
        ("alpr", has(*READER_TYPES) | (low("camera:type") == "alpr") | (low("surveillance") == "anpr")),
        ("webcam", has("CAMERA") & webcam),
        ("ptz", has("CAMERA") & (low("manufacturer").contains("flock") | low("brand").contains("flock"))),
    ])
    tagged = F.coalesce(F.size(tags) > 0, F.lit(False))
    return F.when(~mapped, listed).when(tagged, F.coalesce(by_tags, F.lit("cctv"))).when((own == "deflock") | reader, "alpr").otherwise("cctv")


def camera_view(make: Column) -> Column:
    """(half, least_m, most_m, make): half of the angle and the distances at which a make of camera sees, by a text of its model, maker, tags and operator."""
    # fixed values: patterns of makes with their views
    views = [
        (r"falcon[ -]*(lr|long)|long[- ]range", 7.0, 15.0, 76.0, "long range"), (r"motorola|vigilant|\bl5f\b|\bl6q\b", 12.0, 8.0, 23.0, "vigilant"), (r"genetec|autovu|sharpv", 12.0, 3.0, 45.0, "autovu"),
        (r"verkada", 22.0, 3.0, 20.0, "verkada"), (r"flock|falcon|sparrow", 10.0, 6.0, 25.0, "falcon"), (r"", 12.5, 5.0, 35.0, "unknown"),
    ]
    text = F.lower(F.coalesce(make, F.lit("")))
    one = lambda h, a, b, m: F.struct(F.lit(h).alias("half"), F.lit(a).alias("least_m"), F.lit(b).alias("most_m"), F.lit(m).alias("make"))
    return F.coalesce(*(F.when(text.rlike(p) if p else F.lit(True), one(*v)) for p, *v in views))
