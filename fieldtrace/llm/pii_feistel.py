"""Format-preserving pseudonyms of personal data by keyed Feistel networks. DataFrame functions only.

Found and validated: payment cards (issuer prefix and check digit), phone numbers, social security numbers (no reserved group), IPv4
addresses (octets), calendar dates (real days) and e-mail addresses. What fails its validation stays as it is. Each value is
permuted within the set of valid values of its kind by a network whose round function is a keyed SHA-512:

 * cards: the digits, as two halves of characters that are shifted by each other; the check digit is made anew;
 * e-mail: the local part, letters within letters and digits within digits, its case kept; the domain stays;
 * phones, social security numbers, addresses and dates: their number within the valid ones, as a pair (a, b) of a rectangular domain
   of exactly that size, so the result is always valid and no value is walked through twice. Phone numbers that nobody can have are
   permuted among themselves, so they aren't left in clear.

Separators and widths of the original stay. The permuted value depends on the key, the kind and the value alone, so equal values stay
linked across documents and formats, and different values stay different (a date as a day: ``05/06/2024`` may stand for one or the other day). The text is rebuilt from gaps and matches of one pattern:
one pass, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
DATE = r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
PHONE = r"(?<![\d(])(?:\+1[ .-]?)?(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
ANY = "|".join((EMAIL, DATE, SSN, IP, PHONE, CARD))
KINDS = ("email", "date", "ssn", "ip", "phone", "card")
ROUNDS = 8
BLOCK = 32  # characters that one digest shifts

#: Days from 1900-01-01 that dates are permuted among: 170 * 430, up to 2100-02-19. Areas 1..899 but 666, groups 1..99, serials 1..9999.
DATE_SIDES = (170, 430)
SSN_SIDES = (898 * 99, 9999)
IP_SIDES = (65536, 65536)
#: Phones with area code and exchange from 200 on, and all others of ten digits: pairs of the two codes by lines.
PHONE_SIDES = (800 * 800, 10_000)
FREE_PHONE_SIDES = (200 * 1000 + 800 * 200, 10_000)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 512)


def _pair_network(key: str, kind: str, value: Column, sides: tuple[int, int]) -> Column:
    """Permutes 0 <= value < a * b as the pair (value div b, value mod b); each round shifts one of the two by a digest of the other."""
    a, b = sides

    def step(pair: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        noise = F.conv(F.substring(_digest(key, F.lit(kind), turn.cast("string"), F.when(even, pair["y"]).otherwise(pair["x"]).cast("string")), 1, 14), 16, 10).cast("bigint")
        return F.struct(
            F.when(even, F.pmod(pair["x"] + noise, F.lit(a).cast("bigint"))).otherwise(pair["x"]).alias("x"),
            F.when(even, pair["y"]).otherwise(F.pmod(pair["y"] + noise, F.lit(b).cast("bigint"))).alias("y"),
        )

    start = F.struct(F.floor(value / b).cast("bigint").alias("x"), F.pmod(value, F.lit(b)).cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda p: p["x"] * b + p["y"])


def _shifted(key: str, kind: str, turn: Column, half: Column, other: Column) -> Column:
    """``half`` with each digit and letter moved within its class by a digest of ``other``."""
    chars = F.split(half, "")

    def move(c: Column, i: Column) -> Column:
        noise = F.conv(F.substring(_digest(key, F.lit(kind), turn.cast("string"), F.floor(i / BLOCK).cast("string"), F.length(half).cast("string"), other), (i % BLOCK * 4 + 1).cast("int"), 4), 16, 10).cast("int")
        code = F.ascii(c)
        within = lambda low, n: F.char(F.pmod(code - low + noise, F.lit(n)) + low)
        return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(c)

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(chars, move), ""))


def _text_network(key: str, kind: str, value: Column) -> Column:
    """Permutes a string among those with the same class of character at every place."""
    middle = F.floor(F.length(value) / 2).cast("int")

    def step(pair: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        half, other = F.when(even, pair["x"]).otherwise(pair["y"]), F.when(even, pair["y"]).otherwise(pair["x"])
        # one shift a round: the halves are chosen first, so that the expression doesn't hold the network twice
        moved = F.transform(F.array(F.struct(half.alias("h"), other.alias("o"))), lambda p: _shifted(key, kind, turn, p["h"], p["o"]))[0]
        return F.transform(F.array(moved), lambda m: F.struct(F.when(even, m).otherwise(pair["x"]).alias("x"), F.when(even, pair["y"]).otherwise(m).alias("y")))[0]

    start = F.struct(value.substr(F.lit(1), middle).alias("x"), value.substr(middle + 1, F.length(value)).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda p: F.concat(p["x"], p["y"]))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of a string's digits, those at an odd distance (``doubled`` = 1) or an even one (0) from the last place doubled."""
    n = F.length(digits)

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.pmod(n - 1 - i, F.lit(2)) == doubled
        return F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda s, x: s + x)


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(a: Column, c: Column) -> Column:
        is_digit = F.ascii(c).between(48, 57)
        return F.struct(F.concat(a["out"], F.when(is_digit, digits.substr(a["next"], F.lit(1))).otherwise(c)).alias("out"), (a["next"] + F.when(is_digit, 1).otherwise(0)).alias("next"))

    return F.aggregate(F.split(form, ""), start, step, lambda a: a["out"])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _card(key: str, hit: Column) -> Column:
    """The issuer's first digits stay, the account number is permuted, the check digit is made anew."""

    def made(d: Column) -> Column:
        kept = F.when(d.startswith("2"), 2).otherwise(1)
        account = _text_network(key, "card", d.substr(kept + 1, F.length(d) - 1 - kept))
        return _let(F.concat(d.substr(F.lit(1), kept), account), lambda p: F.concat(p, F.pmod(F.lit(10) - luhn_sum(p, 0) % 10, F.lit(10)).cast("string")))

    return _let(_let(_digits(hit), made), lambda x: _filled(hit, x))


def _phone(key: str, hit: Column) -> Column:
    """Numbers that can be assigned (area code and exchange from 200 on) are permuted among those, the others among the others."""
    prefix = F.regexp_extract(hit, r"^(\+1[ .-]?)?", 1)
    ten = lambda area, exchange, line: F.concat(*(F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (exchange, 3), (line, 4))))

    def assigned(area: Column, exchange: Column, line: Column) -> Column:
        made = _pair_network(key, "phone", ((area - 200) * 800 + exchange - 200) * 10000 + line, PHONE_SIDES)
        return _let(made, lambda v: ten(F.floor(v / 8_000_000) + 200, F.pmod(F.floor(v / 10000), F.lit(800)) + 200, F.pmod(v, F.lit(10000))))

    def free(area: Column, exchange: Column, line: Column) -> Column:
        pair = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        made = _pair_network(key, "free phone", pair * 10000 + line, FREE_PHONE_SIDES)

        def back(v: Column) -> Column:
            p = F.floor(v / 10000)
            low = p < 200_000
            return ten(F.when(low, F.floor(p / 1000)).otherwise(F.floor((p - 200_000) / 200) + 200), F.when(low, F.pmod(p, F.lit(1000))).otherwise(F.pmod(p - 200_000, F.lit(200))), F.pmod(v, F.lit(10000)))

        return _let(made, back)

    def made(d: Column) -> Column:
        parts = [d.substr(a, n).cast("bigint") for a, n in ((1, 3), (4, 3), (7, 4))]
        return F.when((parts[0] >= 200) & (parts[1] >= 200), assigned(*parts)).otherwise(free(*parts))

    return F.concat(prefix, _let(hit.substr(F.length(prefix) + 1, F.length(hit)), lambda h: _let(_let(_digits(h), made), lambda x: _filled(h, x))))


def _ip(key: str, hit: Column) -> Column:
    octets = F.transform(F.split(hit, r"\."), lambda x: x.cast("bigint"))
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    byte = lambda v, s: F.pmod(F.shiftright(v, s), F.lit(256)).cast("string")
    return _let(_pair_network(key, "ip", value, IP_SIDES), lambda v: F.concat_ws(".", byte(v, 24), byte(v, 16), byte(v, 8), byte(v, 0)))


def _ssn(key: str, hit: Column) -> Column:
    digits = _digits(hit)
    area = digits.substr(1, 3).cast("bigint")
    index = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + digits.substr(4, 2).cast("bigint") - 1) * 9999 + digits.substr(6, 4).cast("bigint") - 1

    def back(v: Column) -> Column:
        low = F.floor(v / (99 * 9999)) + 1
        fresh = low + F.when(low >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(fresh.cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(v / 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return _let(_pair_network(key, "ssn", index, SSN_SIDES), back)


#: Shapes of dates and how they are read, in turn. With slashes and the year behind, the month comes first if that is a day at all.
DATE_FORMS = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d\d/", "MM/dd/yyyy"), (r"^\d\d/", "dd/MM/yyyy"), (r"^\d\d\.", "dd.MM.yyyy"))


def _read(hit: Column, shape: str, form: str) -> Column:
    return F.when(hit.rlike(shape), F.try_to_timestamp(hit, F.lit(form)).cast("date"))


def _day(hit: Column) -> Column:
    """Days from 1900-01-01, or null if there is no such day."""
    return F.datediff(F.coalesce(*(_read(hit, *f) for f in DATE_FORMS)), F.lit("1900-01-01").cast("date")).cast("bigint")


def _date(key: str, hit: Column) -> Column:
    """Another day in the form that the original was read in."""

    def back(v: Column) -> Column:
        day = F.date_add(F.lit("1900-01-01").cast("date"), v.cast("int"))
        return F.coalesce(*(F.when(_read(hit, *f).isNotNull(), F.date_format(day, f[1])) for f in DATE_FORMS))

    return _let(_pair_network(key, "date", _day(hit), DATE_SIDES), back)


def _email(key: str, hit: Column) -> Column:
    """The case of a letter isn't part of the value: the name is permuted in lower case and takes the case of the original, letter by letter."""
    local = F.substring_index(hit, "@", 1)
    made = _text_network(key, "email", F.lower(local))
    cased = F.array_join(F.zip_with(F.split(local, ""), F.split(made, ""), lambda a, b: F.when(F.ascii(a).between(65, 90), F.upper(b)).otherwise(b)), "")
    return F.concat(F.when(local == F.lower(local), made).otherwise(cased), hit.substr(F.length(local) + 1, F.length(hit)))


def kind_of(hit: Column) -> Column:
    """The kind of a match, or null if it isn't valid."""
    digits = _digits(hit)
    octets = F.split(hit, r"\.")
    whole = lambda p: hit.rlike(f"^(?:{p})$")
    day = _day(hit)
    return (
        F.when(hit.contains("@"), "email")
        .when(whole(r"[\d]{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4}"), F.when((day >= 0) & (day < DATE_SIDES[0] * DATE_SIDES[1]), "date"))
        .when(whole(r"\d{3}-\d\d-\d{4}"), F.when(hit.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)"), "ssn"))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), F.when(F.forall(octets, lambda x: (x.cast("int") <= 255) & (x.cast("int").cast("string") == x)), "ip"))
        .when(whole(r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})"), "phone")
        .when(digits.rlike(r"^(?:3|4|5|6|2[2-7])\d{12,18}$") & (luhn_sum(digits, 1) % 10 == 0), "card")
    )


def pseudonym(key: str, hit: Column, kind: Column) -> Column:
    makers = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}
    out = hit
    for name, make in makers.items():
        out = F.when(kind == name, make(key, hit)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and a count ``n_<kind>`` of what was replaced for each kind.

    Null stays null with counts of 0; empty texts stay empty. Every row is judged by itself, a text of any length whole; repeated rows
    give the same. Existing columns named ``n_<kind>`` are replaced, others stay whatever their names. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    some = F.coalesce(text.rlike(ANY), F.lit(False))
    nothing = F.array().cast("array<string>")
    gaps, hits, new = (free_name(docs, c) for c in ("gaps", "hits", "new"))
    rows = docs.withColumns({
        gaps: F.when(some, F.split(text, ANY, -1)).otherwise(nothing),
        hits: F.when(some, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda h: F.struct(h.alias("hit"), kind_of(h).alias("kind")))),
    })
    rows = rows.withColumn(new, F.transform(hits, lambda x: pseudonym(key, x["hit"], x["kind"])))
    joined = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, h: F.array(g, h))), "")
    rows = rows.withColumn(text_col, F.when(F.col(hits).isNull(), text).otherwise(joined))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter(hits, lambda x: x["kind"] == kind)), F.lit(0)).cast("long")

    counts = {f"n_{k}": count(k) for k in KINDS}
    return rows.withColumns(counts).drop(gaps, hits, new)
