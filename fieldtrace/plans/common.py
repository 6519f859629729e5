"""What the query modules share: exact rounding in both engines, and SQL of the geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(x: Column, digits: int = 3) -> Column:
    """Rounded half up by floor, which is the same in every engine."""
    k = float(10**digits)
    return F.floor(x * k + 0.5).cast("long")


def at_sql(x: str, digits: int = 3) -> str:
    return f"cast(floor(({x}) * cast({10**digits} as double) + cast(0.5 as double)) as bigint)"


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(cast(12742000 as double) * asin(least(cast(1 as double), sqrt(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2)"
        f" + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2)))))"
    )


def bearing_sql(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + cast(360 as double), cast(360 as double))"
