"""Radio levels, ranges, grades and rules of classification, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def metres_of_level(dbm: Column, at_one_metre: Column) -> Column:
    """Range by a path loss of 24 dB a decade, from 3 to 800 m."""
    return F.greatest(F.lit(3.0), F.least(F.lit(800.0), F.pow(F.lit(10.0), (at_one_metre - dbm) / 24)))


def level_at(p0: Column, exponent: Column, metres: Column) -> Column:
    return p0 - 10 * exponent * F.log10(F.greatest(metres, F.lit(1.0)))


def metres_at(p0: Column, exponent: Column, level: Column) -> Column:
    return F.pow(F.lit(10.0), (p0 - level) / (10 * exponent))


def free_space_loss(metres: Column, mhz: Column) -> Column:
    return 20 * F.log10(metres) + 20 * F.log10(mhz) - 27.55


def band(mhz: Column) -> Column:
    return F.when(mhz.between(2400, 2500), "2.4").when(mhz.between(4900, 5924), "5").when(mhz.between(5925, 7125), "6")


def channel(mhz: Column) -> Column:
    return F.when(mhz == 2484, 14).when(mhz.between(2412, 2472), ((mhz - 2407) / 5).cast("int")).when(mhz.between(5000, 5924), ((mhz - 5000) / 5).cast("int")).when(mhz.between(5925, 7125), ((mhz - 5950) / 5).cast("int"))


def security_of_text(capabilities: Column) -> Column:
    """The strongest scheme that a capability text names."""
    c = F.upper(capabilities)
    has = lambda *names: F.lit(False) if not names else c.rlike("|".join(names))
    return F.when(has("SAE", "WPA3"), "WPA3").when(has("RSN", "WPA2"), "WPA2").when(has("WPA"), "WPA").when(has("WEP"), "WEP").when(has("OWE"), "OWE").otherwise("OPEN")


def security_of_flags(privacy: Column, wpa: Column, rsn: Column) -> Column:
    """The class of a network by its privacy bit and the bit sets of its two key managements (0x400: SAE, 0x800: OWE)."""
    bit = lambda f, b: f.bitwiseAND(F.lit(b)) != 0
    return F.when(bit(rsn, 0x400), "WPA3").when(bit(rsn, 0x800), "OWE").when(rsn != 0, "WPA2").when(wpa != 0, "WPA").when(bit(privacy, 1), "WEP").otherwise("OPEN")


def verdict(security: Column) -> Column:
    return F.when(security.isin("OPEN", "WEP", "WPA"), "BAD").when(security.isin("WPA2", "WPA3", "OWE"), "OK").otherwise("UNKNOWN")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def chi_square_quantile(z: Column, freedom: Column) -> Column:
    """Wilson and Hilferty's cube."""
    a = 2 / (9 * freedom)
    return freedom * F.pow(1 - a + z * F.sqrt(a), F.lit(3.0))


#: The least score of each letter.
LETTERS = (("A", 85), ("B", 70), ("C", 55), ("D", 40), ("E", 20))


def letter(score: Column) -> Column:
    out = F.lit("F")
    for name, least in reversed(LETTERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def range_class(metres: Column) -> Column:
    return F.when(metres <= 2, "adjacent").when(metres <= 6, "room").when(metres <= 30, "near").otherwise("far")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, to 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def overlap_of_boxes(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of boxes x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = w * h
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def pass_confidence(read_chance: Column, suspected: Column, misspelt: Column, is_reader: Column) -> Column:
    """Rounded percent of the chance, less for suspected and misspelt cases, at most 40 for what isn't a reader."""
    c = F.floor(100 * read_chance * F.when(suspected, 0.7).otherwise(1.0) * F.when(misspelt, 0.85).otherwise(1.0) + 0.5)
    return F.when(is_reader, c).otherwise(F.least(c, F.lit(40))).cast("int")


def schedule_hours(mode: Column, failures: Column) -> Column:
    """Hours to the next poll by mode; after failures 1 h, doubled each time, up to 24."""
    calm = F.when(mode == "leaky", 3).when(mode == "reader", 12).when(mode == "driving", 24).otherwise(168)
    return F.when(failures > 0, F.least(F.lit(24.0), F.pow(F.lit(2.0), failures - 1))).otherwise(calm.cast("double"))
