"""Ordered rules over tags, case by case; rows without tags."""

import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import rules

TAGS = "tags map<string,string>"

PLACES = [
    ({"amenity": "police", "brand": "Flock Group"}, "surveillance"), ({"surveillance:type": "Alpr"}, "surveillance"), ({"amenity": "clinic", "leisure": "park"}, "urgent"), ({"office": "government", "name": "State DMV"}, "dmv"), ({"office": "government"}, None),
    ({"leisure": "swimming_pool", "access": "private", "amenity": "cafe"}, None), ({"leisure": "sports_centre", "sport": "tennis;swimming"}, "pool"), ({"leisure": "pitch", "sport": "skateboard"}, "skate"), ({"amenity": "fuel", "fuel:lpg": "yes", "fuel:octane_87": "yes"}, "fuel"),
    ({"amenity": "fuel", "fuel:lpg": "yes"}, "propane"), ({"amenity": "toilets", "shower": "yes"}, "shower"), ({"internet_access": "wlan", "amenity": "cafe"}, "cafe"), ({}, None), (None, None),
]


def test_categories(spark):
    got = spark.createDataFrame([(t,) for t, _ in PLACES], TAGS).select(rules.place_category(F.col("tags"))).collect()
    assert [r[0] for r in got] == [c for _, c in PLACES]


HOSPITAL = {"amenity": "hospital"}
CHILDREN = [
    (HOSPITAL | {"name": "Children’s Hospital", "emergency": "yes"}, ("peds_er", 1, "yes", True)), (HOSPITAL | {"name": "Children's Hospital"}, ("peds_er", 2, None, False)), (HOSPITAL | {"name": "Kids", "emergency": "no"}, ("health", 0, "no", False)),
    (HOSPITAL | {"name": "Children's Hospital - Cardiology", "emergency": "yes"}, ("health", 0, "yes", True)), (HOSPITAL | {"healthcare:speciality": "General; Paediatrics", "emergency": "yes"}, ("health", 3, "yes", True)), (HOSPITAL | {"healthcare:speciality": "child_psychiatry", "name": "Children"}, ("health", 0, None, False)),
    (HOSPITAL | {"healthcare:speciality": "paediatric_surgery", "opening_hours": " 24/7 "}, ("peds_er", 2, None, False)), (HOSPITAL | {"opening_hours": "24/7"}, ("health", 0, None, True)), ({"building": "hospital", "alt_name": "Children's"}, ("peds_er", 2, None, False)),
    ({"amenity": "clinic", "name": "Kids Urgent Care"}, ("peds_urgent", 4, None, False)), ({"amenity": "clinic", "name": "Kids Urgent Dental"}, ("urgent", 0, None, False)), ({"amenity": "cafe", "name": "Kids"}, ("cafe", 0, None, False)), (None, (None, 0, None, False)),
]


def test_pediatric(spark):
    got = spark.createDataFrame([(t,) for t, _ in CHILDREN], TAGS).select(rules.pediatric(F.col("tags")).alias("p")).select("p.*").collect()
    assert [tuple(r)[:4] for r in got] == [c for _, c in CHILDREN]
    assert got[0]["detail"] == "pediatric ER" and got[2]["detail"] == "children's hospital · no ER" and got[9]["detail"] == "not an ER"


CAMERAS = [
    (("list:1", "community", "Raven", None), "not_camera"), (("list:1", "community", "Raven ALPR", None), "alpr"), (("list:1", "community", " Camera ", None), "cctv"), (("list:1", None, None, None), "alpr"),
    (("osm:1", None, None, {"surveillance:type": "camera;ALRP", "enforcement": "maxspeed"}), "enforcement"), (("osm:1", None, None, {"surveillance:type": "camera;ALRP"}), "alpr"), (("osm:1", None, None, {"surveillance:type": "camera", "contact:webcam": "https://x"}), "webcam"),
    (("osm:1", None, None, {"surveillance:type": "camera", "contact:webcam": "none", "brand": "FLOCK"}), "ptz"), (("osm:1", None, None, {"surveillance:type": "guard"}), "not_camera"), (("osm:1", None, None, {"a": "b"}), "cctv"), (("osm:1", "deflock", None, {}), "alpr"), (("osm:1", None, "x", None), "cctv"),
]


def test_cameras(spark):
    got = spark.createDataFrame([c for c, _ in CAMERAS], f"id string, source string, model string, {TAGS}").select(rules.camera_kind(*map(F.col, ("id", "source", "model", "tags")))).collect()
    assert [r[0] for r in got] == [k for _, k in CAMERAS]


@pytest.mark.parametrize(("text", "view"), [("Flock Falcon LR", (7.0, 15.0, 76.0)), ("flock", (10.0, 6.0, 25.0)), ("Vigilant L5F", (12.0, 8.0, 23.0)), ("", (12.5, 5.0, 35.0)), (None, (12.5, 5.0, 35.0))])
def test_views(spark, text, view):
    r = spark.createDataFrame([(text,)], "m string").select(rules.camera_view(F.col("m")).alias("v")).select("v.*").collect()[0]
    assert tuple(r)[:3] == view
