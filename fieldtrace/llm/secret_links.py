"""Secrets in texts, with multipart credential linking. DataFrame functions only.

Three kinds of strong span are always reported (``assign``, ``access``, ``hex``). Three weak kinds are parts of a credential that
mean little alone: ``ident`` (a named account or client), ``bare`` (a 40-character mixed token without a name) and ``endpoint`` (a URL
or a named host). A weak part is reported only if the parts that complete it lie in its scope, which is its own interval widened by
``reach`` code points on either side, in the same row: an identifier needs a secret, a bare secret needs an identifier, an endpoint
needs both. Strong spans count as parts: ``access`` as an identifier, ``assign`` and ``hex`` as secrets.

Spans are code points, end exclusive. Texts without any candidate never leave the first scan. For the others the lengths of gaps and
matches (not the texts) are exploded, positions are running sums, and scopes are joined on (row, block of ``reach`` code points), so
the pairs of a block are bounded by the reach whatever the length of a text or the number of its copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

#: Every assignment ends like this; the name in front decides what it assigns.
_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
#: Fixed values of the base: the names of secrets, and the forms of the three strong kinds.
_ASSIGN = rf"(?i)(password|passwd|secret|token|api_?key){_GIVEN}([A-Za-z0-9+/_.=-]+)"
_ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of [0-9a-f] of 32 or more. Greedy matches of that class are its maximal runs, so shorter ones need not be listed to be dropped.
_HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # what the least length holds for
    least: int
    role: str  # identifier, secret or endpoint
    weak: bool = False
    also: str | None = None  # a further pattern that the match must hold


KINDS = (
    Kind("assign", _ASSIGN, 2, 8, "secret"),
    Kind("access", _ACCESS, 0, 16, "identifier"),
    Kind("hex", _HEX, 0, 32, "secret"),
    Kind("ident", rf"(?i)\b(?:client_?id|user_?name|user_?id|user|login|account_?id|account|access_?key_?id){_GIVEN}([A-Za-z0-9@._+-]+)", 1, 3, "identifier", True),
    Kind("bare", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40, "secret", True, r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"),
    Kind("endpoint", rf"(?i)\b(?:(?:https?|ftp|amqps?|rediss?|mysql|postgres(?:ql)?|mongodb|s3)://[^\x00-\x20\x22'<>]+|(?:host|host_?name|endpoint|server){_GIVEN}[A-Za-z0-9.:-]+)", 0, 6, "endpoint", True),
)
NAMES = [k.name for k in KINDS]
STRONG = [k.name for k in KINDS if not k.weak]
#: An assignment to any of the names of strong and weak kinds.
_NAMED = (
    r"(?i:(?:password|passwd|secret|token|api_?key|client_?id|user_?name|user_?id|user|login|account_?id|account|access_?key_?id|host|host_?name|endpoint|server)"
    + _GIVEN
    + r"[a-z0-9+/_.=:@-])"
)
#: A run that may be a hexadecimal or a bare secret, looked for where runs begin.
_LONG = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}"


def candidate(text: Column) -> Column:
    """True of every text that has a span of any kind, and of few others. What is cheap to look for comes first; null is false."""
    assigned = (text.contains("=") | text.contains(":")) & text.rlike(_NAMED)
    return F.coalesce(text.contains("AKIA") | text.contains("://") | text.rlike(_LONG) | assigned, F.lit(False))


REACH = 200

_PART = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("turn", T.IntegerType()), T.StructField("gap", T.IntegerType()), T.StructField("hit", T.IntegerType()), T.StructField("fits", T.BooleanType())]))


def _with_parts(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``__parts``: kind, turn, length of the gap before, length of the match, whether the match fits, for every match; null without a candidate."""

    def lengths(kind: Kind) -> tuple[Column, Column, Column]:
        here = F.col("__some") & F.col(text).rlike(kind.pattern)
        hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        told = hits if kind.group == 0 else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
        fits = F.transform(told, lambda x: (F.length(x) >= kind.least) & (x.rlike(kind.also) if kind.also else F.lit(True)))
        return (
            F.when(here, F.transform(F.split(text, kind.pattern, -1), F.length)).otherwise(F.array().cast("array<int>")),
            F.when(here, F.transform(hits, F.length)).otherwise(F.array().cast("array<int>")),
            F.when(here, fits).otherwise(F.array().cast("array<boolean>")),
        )

    def listed(n: int) -> Column:
        zipped = F.arrays_zip(f"__gap{n}", f"__hit{n}", f"__fits{n}")
        made = F.transform(zipped, lambda x, i: F.struct(F.lit(n).alias("kind"), i.alias("turn"), x[f"__gap{n}"].alias("gap"), x[f"__hit{n}"].alias("hit"), x[f"__fits{n}"].alias("fits")))
        return F.filter(made, lambda x: x["hit"].isNotNull())

    out = rows.withColumn("__some", candidate(F.col(text)))
    for n, kind in enumerate(KINDS):
        out = out.withColumns(dict(zip((f"__gap{n}", f"__hit{n}", f"__fits{n}"), lengths(kind), strict=True)))
    made = F.when(F.col("__some"), F.concat(*map(listed, range(len(KINDS))))).cast(_PART)
    return out.withColumn("__parts", made).drop("__some", *(f"__{c}{n}" for n in range(len(KINDS)) for c in ("gap", "hit", "fits")))


def _positions(rows: DataFrame) -> DataFrame:
    """(__row, kind, first, last) of every match that fits, from the running sums of lengths; ``last`` is exclusive."""
    flat = rows.select("__row", F.inline("__parts"))
    run = Window.partitionBy("__row", "kind").orderBy("turn")
    placed = flat.withColumn("last", F.sum(F.col("gap") + F.col("hit")).over(run))
    return placed.where("fits").select("__row", "kind", (F.col("last") - F.col("hit")).alias("first"), "last")


def _of(column: Column, names: list[str]) -> Column:
    return column.isin([NAMES.index(k) for k in names])


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts whose complements lie in their scopes, by an interval join on blocks of ``reach`` code points."""
    role = F.element_at(F.array(*(F.lit(k.role) for k in KINDS)), F.col("kind") + 1)
    blocks = lambda low, high: F.sequence(F.floor(low / reach), F.floor(high / reach))
    weak = parts.where(_of(F.col("kind"), [k.name for k in KINDS if k.weak]))
    scopes = weak.select("__row", "kind", "first", "last", role.alias("role"), F.explode(blocks(F.col("first") - reach, F.col("last") + reach)).alias("block"))
    others = parts.select("__row", F.col("first").alias("from"), F.col("last").alias("to"), role.alias("other"), F.explode(blocks(F.col("first"), F.col("last"))).alias("block"))
    met = scopes.join(others, ["__row", "block"]).where("other <> role and other <> 'endpoint'").where((F.col("from") < F.col("last") + reach) & (F.col("to") > F.col("first") - reach))
    found = met.groupBy("__row", "kind", "first", "last", "role").agg(F.bool_or(F.col("other") == "identifier").alias("named"), F.bool_or(F.col("other") == "secret").alias("secret"))
    return found.where((F.col("role") != "endpoint") | (F.col("named") & F.col("secret"))).select("__row", "kind", "first", "last")


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """(__row, __doc, __text): a row number, all columns as one value, so that no name of theirs can clash, and the text."""
    return docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(f"`{text_col}`").cast("string").alias("__text"))


def _spans_by_row(rows: DataFrame, reach: int) -> DataFrame:
    """(__row, spans): all spans of a row by start, then kind."""
    parts = cut(_positions(rows))
    spans = parts.where(_of(F.col("kind"), STRONG)).union(_linked(parts, reach))
    return spans.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("first", "kind", "last"))).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["first"].cast("string"), s["last"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null and empty texts have no spans. Repeated ids and repeated rows are judged row by row. A text of any length is scanned whole in
    its own row; only the lengths of its matches are exploded. Other columns are ignored, whatever their names; an empty table gives an
    empty result. The texts are read and scanned once.
    """
    scanned = _numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    # one pass over the texts: what comes out of it has no text
    rows = cut(_with_parts(scanned, "__text").select("__row", F.col("__doc.id").alias("__id"), "__parts"))
    found = rows.where("__parts is not null")
    spanned = found.select("__row", "__id").join(_spans_by_row(found, reach), "__row", "left").select("__id", "spans")
    kind = "array<struct<first:bigint,kind:int,last:bigint>>"
    clean = rows.where("__parts is null").select("__id", F.lit(None).cast(kind).alias("spans"))
    everything = spanned.union(clean).withColumn("spans", F.coalesce("spans", F.array().cast(kind)))
    base = F.filter("spans", lambda s: _of(s["kind"], STRONG))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == NAMES.index(k))).cast("long")
    return everything.select(
        F.col("__id").alias(id_col),
        *(count(k).alias(f"n_{k}") for k in STRONG),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~_of(s["kind"], STRONG))).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span of ``text_col`` replaced by ``mask``; overlapping spans are replaced together.

    All rows stay, repeated ones too, and all columns, whatever their names. Null and empty texts and rows without a candidate pass
    through as they are, a text of any length whole. An empty table gives an empty result.
    """
    some = candidate(F.col(f"`{text_col}`").cast("string"))
    rows = cut(_with_parts(_numbered(docs.where(some), text_col), "__text"))
    found = rows.drop("__parts").join(_spans_by_row(rows.select("__row", "__parts").where("__parts is not null"), reach), "__row", "left")
    # spans are sorted by start: one begins a new masked stretch where it starts beyond all ends before it
    merged = F.aggregate(
        "spans",
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("end")),
        lambda a, s: F.struct(
            F.when(
                (s["first"] >= a["end"]) & ~((s["first"] == a["end"]) & (a["end"] > 0)),
                F.concat(a["out"], F.array(F.col("__text").substr((a["end"] + 1).cast("int"), (s["first"] - a["end"]).cast("int")), F.lit(mask))),
            ).otherwise(F.when(a["end"] == 0, F.array(F.lit(mask))).otherwise(a["out"])).alias("out"),
            F.greatest(a["end"], s["last"]).alias("end"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.col("__text").substr((a["end"] + 1).cast("int"), F.length("__text"))),
    )
    text = F.when(F.col("spans").isNull(), F.col("__text")).otherwise(merged)
    done = found.select(*((text if c == text_col else F.col("__doc")[c]).alias(c) for c in docs.columns))
    return done.union(docs.where(~some))
