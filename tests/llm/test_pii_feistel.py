import datetime
import hashlib
import random
import re

from fieldtrace.llm import pii_feistel as P
from pyspark.sql import functions as F


def run(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in P.pseudonymise(docs, key).orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_values_change_within_their_format(spark):
    texts = [
        "card 4111 1111 1111 1111, again 4111-1111-1111-1111 and 4111111111111111.",
        "not a card: 4111111111111112 9807915762804490 1234",
        "call +1 (017) 555-7713 or (017) 555-7713 or 017-555-7713",
        "mail that.92@mail2.example.com THAT.92@mail2.example.com a@b",
        "ip 97.51.17.173 not 997.51.17.173 nor 1.2.3 nor 01.2.3.4. end 10.0.0.1.",
        "ssn 123-45-6789 not 666-45-6789 nor 123-00-6789",
        "born 1999-02-28, 02/28/1999, 28.02.1999, 1999/02/28; not 1999-02-30 nor 13/13/2000",
        None,
        "",
        "plain text 😀 with version 4.0. and 2.0.",
    ]
    out = run(spark, texts)
    for k in (1, 7, 8, 9):
        assert out[k].text == texts[k]
    cards = re.findall(r"\d[\d -]{14,}\d", out[0].text)
    assert out[0].n_card == 3 and all(map(luhn, cards)) and len({re.sub(r"\D", "", c) for c in cards}) == 1
    assert [re.sub(r"\d", "9", c) for c in cards] == ["9999 9999 9999 9999", "9999-9999-9999-9999", "9" * 16] and cards[2] != "4111111111111111" and cards[2][0] == "4"
    assert re.sub(r"\d", "9", out[2].text.replace("+1", "+")) == re.sub(r"\d", "9", texts[2].replace("+1", "+"))
    phones = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", out[2].text)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "7713" not in out[2].text and out[2].n_phone == 3
    a, b = re.findall(r"\S+@mail2\S+", out[3].text)
    assert a.upper() == b.upper().replace("MAIL2.EXAMPLE.COM", "MAIL2.EXAMPLE.COM") and re.fullmatch(r"[a-z]{4}\.\d\d@mail2.example.com", a) and a != "that.92@mail2.example.com" and out[3].n_email == 2
    assert out[4].n_ip == 2 and "997.51.17.173" in out[4].text and "97.51.17.173 not" not in out[4].text
    assert out[5].n_ssn == 1 and "666-45-6789" in out[5].text and re.match(r"ssn (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4} not", out[5].text)
    iso, us, dotted, slash = re.search(r"born (\S+), (\S+), (\S+), (\S+);", out[6].text).groups()
    day = datetime.date.fromisoformat(iso)
    assert day != datetime.date(1999, 2, 28) and out[6].n_date == 4
    assert [us, dotted, slash] == [day.strftime("%m/%d/%Y"), day.strftime("%d.%m.%Y"), day.strftime("%Y/%m/%d")]
    assert out[6].text.endswith("not 1999-02-30 nor 13/13/2000")


def test_keyed_and_one_to_one(spark):
    ids = spark.range(2000)
    kinds = {
        "ip": F.format_string("10.0.%d.%d", F.floor(F.col("id") / 256).cast("int"), (F.col("id") % 256).cast("int")),
        "phone": F.format_string("(200) 555-%04d", F.col("id")),
        "ssn": F.format_string("123-45-%04d", F.col("id") + 1),
        "date": F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"),
        "email": F.format_string("ab%04d@x.org", F.col("id")),
    }
    for kind, made in kinds.items():
        docs = ids.select(made.alias("text"))
        one = P.pseudonymise(docs, "k")
        assert one.where(f"n_{kind} = 1").count() == 2000
        assert one.select("text").distinct().count() == 2000
        assert P.pseudonymise(one.drop(f"n_{kind}"), "k").where(f"n_{kind} = 1").count() == 2000  # still valid
        assert one.join(P.pseudonymise(docs, "other").select("text"), "text", "left_semi").count() < 1900


def test_empty_table_clashing_columns_and_long_text(spark):
    docs = spark.createDataFrame([(1, "x" * 200_000 + " 4111111111111111", 5)], "doc_id long, text string, n_card int")
    out = P.pseudonymise(docs, "k").collect()[0]
    assert out.n_card == 1 and len(out.text) == 200_017 and out.text.startswith("x" * 200_000)
    assert P.pseudonymise(docs.where("false"), "k").count() == 0


def digest(key, *parts):
    return hashlib.sha512("|".join([key, *map(str, parts)]).encode()).hexdigest()


def slow_pair(key, kind, value, sides):
    x, y = divmod(value, sides[1])
    for turn in range(P.ROUNDS):
        noise = int(digest(key, kind, turn, y if turn % 2 == 0 else x)[:14], 16)
        x, y = ((x + noise) % sides[0], y) if turn % 2 == 0 else (x, (y + noise) % sides[1])
    return x * sides[1] + y


def slow_text(key, kind, value):
    half = len(value) // 2
    pair = [value[:half], value[half:]]
    for turn in range(P.ROUNDS):
        own, other = pair[turn % 2], pair[1 - turn % 2]
        out = ""
        for i, c in enumerate(own):
            noise = int(digest(key, kind, turn, i // P.BLOCK, len(own), other)[i % P.BLOCK * 4 :][:4], 16)
            low, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (0, 0)
            out += chr(low + (ord(c) - low + noise) % n) if n else c
        pair[turn % 2] = out
    return "".join(pair)


def test_networks_against_plain_python(spark):
    """Whole values of every kind, made anew without Spark."""
    rng = random.Random(4)
    first = datetime.date(1900, 1, 1)
    texts, want = [], []
    for _ in range(60):
        area, exchange, line = rng.randint(0, 999), rng.randint(0, 999), rng.randint(0, 9999)
        texts.append(f"({area:03}) {exchange:03}-{line:04}")
        if area >= 200 and exchange >= 200:
            v = slow_pair("k", "phone", ((area - 200) * 800 + exchange - 200) * 10000 + line, P.PHONE_SIDES)
            a, e = v // 8_000_000 + 200, v // 10000 % 800 + 200
            assert a >= 200 and e >= 200
        else:
            p = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
            v = slow_pair("k", "free phone", p * 10000 + line, P.FREE_PHONE_SIDES)
            p = v // 10000
            a, e = divmod(p, 1000) if p < 200_000 else (200 + (p - 200_000) // 200, (p - 200_000) % 200)
            assert a < 200 or e < 200
        want.append(f"({a:03}) {e:03}-{v % 10000:04}")
        day = rng.randint(0, P.DATE_SIDES[0] * P.DATE_SIDES[1] - 1)
        texts.append((first + datetime.timedelta(day)).isoformat())
        want.append((first + datetime.timedelta(slow_pair("k", "date", day, P.DATE_SIDES))).isoformat())
        octets = [rng.randint(0, 255) for _ in range(4)]
        v = slow_pair("k", "ip", int.from_bytes(bytes(octets), "big"), P.IP_SIDES)
        texts.append(".".join(map(str, octets)))
        want.append(".".join(map(str, v.to_bytes(4, "big"))))
        name = "".join(rng.choices("abcdefgh0123._", k=rng.randint(1, 9)))
        mixed = "".join(c.upper() if rng.random() < 0.3 else c for c in name)
        texts.append(f"{mixed}@x.org")
        made = slow_text("k", "email", name)
        want.append("".join(b.upper() if a.isupper() else b for a, b in zip(mixed, made, strict=True)) + "@x.org")
    assert [r.text for r in run(spark, texts)] == want


def test_day_first_dates_and_repeated_rows(spark):
    out = run(spark, ["on 25/12/2024 and 12/25/2024, 2024-12-25", "on 25/12/2024 and 12/25/2024, 2024-12-25", "no 31/31/2024"])
    assert out[0].text == out[1].text and out[0].n_date == 3 and out[2].n_date == 0 and out[2].text == "no 31/31/2024"
    a, b, c = re.search(r"on (\S+) and (\S+), (\S+)", out[0].text).groups()
    day = datetime.date.fromisoformat(c)
    assert (a, b) == (day.strftime("%d/%m/%Y"), day.strftime("%m/%d/%Y")) and day != datetime.date(2024, 12, 25)


def test_names_of_helper_columns_are_free(spark):
    docs = spark.createDataFrame([(1, "a@b.org", 1, 2, 3)], "doc_id long, text string, gaps int, hits int, new int")
    out = P.pseudonymise(docs, "k").collect()[0]
    assert (out.gaps, out.hits, out.new, out.n_email) == (1, 2, 3, 1)
