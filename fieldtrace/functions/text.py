"""Text of the domain: identifiers, patterns, names, durations and units, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A regular expression for a whole value by ``*`` and ``?``."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def mac(x: Column) -> Column:
    """Upper-case with colons, or null if it doesn't have twelve hexadecimal digits."""
    digits = F.upper(F.regexp_replace(x, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits) == 12, F.regexp_replace(digits, "(..)(?!$)", "$1:"))


def mac_of_number(x: Column) -> Column:
    return mac(F.lpad(F.hex(x), 12, "0"))


def mac_group(x: Column) -> Column:
    """Addresses of one device: the local bit and the last four bits are cleared."""
    n = F.conv(F.regexp_replace(x, ":", ""), 16, 10).cast("bigint")
    return F.lpad(F.hex(n.bitwiseAND(F.lit(~((2 << 40) | 15) & (1 << 48) - 1))), 12, "0")


def degrees_pair(x: Column) -> Column:
    """Struct lat, lon of a text such as ``1.5°, -2°``; null beyond the bounds."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*°?\s*,\s*(-?\d+(?:\.\d+)?)\s*°?\s*$"
    lat = F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).cast("double")
    lon = F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 2)).cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def epoch_ms(x: Column) -> Column:
    """Milliseconds of seconds, milliseconds (above 1e11) or an ISO or blank-separated UTC time in text; else null."""
    number = F.when(x.rlike(r"^\d{1,15}(\.\d+)?$"), x).cast("double")
    iso = F.try_to_timestamp(x)
    return F.when(number.isNotNull(), F.when(number > 1e11, number).otherwise(number * 1000).cast("bigint")).otherwise(F.floor(F.unix_micros(iso) / 1000).cast("bigint"))


def duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    part = lambda a, x, b, y: F.concat(F.floor(s / a).cast("string"), F.lit(f" {x} "), F.floor(F.pmod(s, F.lit(a)) / b).cast("string"), F.lit(f" {y}"))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min"))).when(s < 86400, part(3600, "h", 60, "min")).otherwise(part(86400, "d", 3600, "h"))


def metric(m: Column) -> Column:
    return F.when(m < 1000, F.concat(F.floor(m).cast("string"), F.lit(" m"))).otherwise(F.concat((F.floor(m / 100 + 0.5) / 10).cast("decimal(12,1)").cast("string"), F.lit(" km")))


def imperial(metres: Column) -> Column:
    """A length in feet up to 100, in tens of feet up to a tenth of a mile, then in miles, with one decimal below ten."""
    feet = metres * 3.28084
    miles = feet / 5280.0
    return (
        F.when(feet < 100, F.concat(F.floor(feet).cast("string"), F.lit(" ft")))
        .when(feet < 528, F.concat((F.floor(feet / 10) * 10).cast("string"), F.lit(" ft")))
        .when(miles < 10, F.concat(F.format_string("%.1f", F.floor(miles * 10 + 0.5) / 10.0), F.lit(" mi")))
        .otherwise(F.concat(F.floor(miles + 0.5).cast("string"), F.lit(" mi")))
    )


def drive_seconds(m: Column) -> Column:
    """A drive over 1.4 times the distance at 70 km/h, in whole five minutes, five at least."""
    return F.greatest(F.floor(m * 1.4 / (70 / 3.6) / 300 + 0.5) * 300, F.lit(300)).cast("bigint")


#: Letters and digits that are taken for each other on plates.
CONFUSED = ("OIBSZG", "018526")


def plate(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def folded_plate(x: Column) -> Column:
    return F.translate(plate(x), *CONFUSED)


def hashed(x: Column) -> Column:
    """SHA-256 of a value in lower case without outer blanks."""
    return F.sha2(F.lower(F.trim(x)).cast("binary"), 256)


def media_uid(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 32)


def pass_uid(camera: Column, ms: Column) -> Column:
    return F.concat_ws(":", F.lit("pass"), camera.cast("string"), F.floor(ms / 60_000).cast("string"))


def name_tokens(x: Column, stop: tuple[str, ...] = ("THE", "OF", "AND", "DEPARTMENT", "DEPT", "POLICE", "SHERIFF", "OFFICE", "COUNTY", "CITY")) -> Column:
    """Distinct upper-case words of a name without stop words, in order."""
    words = F.split(F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*stop)))


def trailing_state(x: Column, codes: tuple[str, ...]) -> Column:
    """The two-letter code that ends a name, if it is one of ``codes``."""
    code = F.regexp_extract(x, r"(?:^|[\s,])([A-Z]{2})\s*$", 1)
    return F.when(code.isin(*codes), code)


def place_parts(x: Column) -> Column:
    """Struct place, city, region of a text ``place, city, region``, from its end."""
    parts = F.transform(F.split(x, ","), lambda p: F.trim(p))
    n = F.size(parts)
    return F.struct(parts[0].alias("place"), F.when(n >= 2, F.element_at(parts, F.when(n >= 3, -2).otherwise(-1))).alias("city"), F.when(n >= 3, F.element_at(parts, -1)).alias("region"))


def address(street: Column, number: Column, city: Column, postcode: Column) -> Column:
    """One line from the parts that are there."""
    none = lambda c: F.when(F.trim(c) != "", F.trim(c))
    blank = lambda *c: F.nullif(F.concat_ws(" ", *c), F.lit(""))
    return F.nullif(F.concat_ws(", ", blank(none(number), none(street)), blank(none(postcode), none(city))), F.lit(""))


def directions(x: Column) -> Column:
    """Degrees of a direction text: numbers, the sixteen points, bounds such as NB, ranges (their middle, clockwise), lists by ; or ,.

    Parts that say nothing (a bare 0, a whole circle, other words) are left out.
    """
    from .geo import COMPASS

    bounds = {"NB": 0.0, "EB": 90.0, "SB": 180.0, "WB": 270.0, "NORTH": 0.0, "EAST": 90.0, "SOUTH": 180.0, "WEST": 270.0}
    known = {**{c: k * 22.5 for k, c in enumerate(COMPASS)}, **bounds}
    table = F.create_map(*(F.lit(v) for pair in known.items() for v in pair))

    def one(p: Column) -> Column:
        number = F.when(p.rlike(r"^\d{1,3}(\.\d+)?$"), p).cast("double")
        return F.coalesce(number, F.element_at(table, p))

    def part(p: Column) -> Column:
        ends = F.split(p, r"\s*-\s*")
        low, high = one(ends[0]), one(F.element_at(ends, -1))
        span = F.pmod(high - low + 360, F.lit(360.0))
        middle = F.pmod(low + span / 2, F.lit(360.0))
        ranged = F.when((F.size(ends) == 2) & low.isNotNull() & high.isNotNull() & ~((low == 0) & (high == 360)), middle)
        return F.when(F.size(ends) == 1, F.when(p != "0", one(p))).otherwise(ranged)

    parts = F.transform(F.split(F.upper(x), "[;,]"), lambda p: F.trim(p))
    return F.filter(F.transform(parts, lambda p: F.pmod(part(p), F.lit(360.0))), lambda v: v.isNotNull())
