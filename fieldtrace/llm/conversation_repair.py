"""Least-cost repair of the turn structure of conversations, by a recursive DuckDB query inside hash-partitioned batches.

A sound conversation's role initials read ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant (3), Delete (4; required for blank
and duplicate rows), Insert an empty user or assistant turn anywhere (3); a truncated row that isn't deleted adds 3. The cheapest edits' initials
in order are the audit; of audits that cost the same the ASCII-least is taken.

Spark deals conversations out by the hash of their id and sorts each partition by turn; faults are columns of windows over that partitioning.
A task streams its partition: some thousand rows at a time are one recursive query, each of whose recursions advances one turn for all
conversations of the batch and keeps the least cost and audit for each state of the grammar. A conversation longer than a batch goes on in the
next one from the costs it has for each state, so only its audit grows, which the result holds anyway; the hash of its text goes on likewise.
No two audits that reach a state at the same turn with the same cost begin with one another (an insertion more costs more), so least audits of parts are parts of least audits.

Nulls: a null role or text counts as one space. Rows without a conversation id are one conversation, whose id is null. Null turns come first; rows of
one turn are in order of role and text. A role's initial is its first character: a role that doesn't begin with s, u or a in lower case, or is empty, can't be kept. Repeated rows are
duplicates. An empty table gives no rows; other columns don't matter. Gaps beyond a long are cut to it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import small_batches

#: The grammar: 0 nothing yet, 1 after a system turn, 2 after a user's, 3 after an assistant's. Sound ends are 0 and 3.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a batch, rows of one conversation in a batch, and characters of a batch.
BATCH_ROWS, PART_ROWS, BATCH_CHARS = 4096, 512, 8 << 20

COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _inserted(state: int) -> Iterator[tuple[int, str]]:
    """(state, roles' initials) after no, one or two insertions: more are never cheaper."""
    yield state, ""
    roles = ""
    for _ in range(2):
        role = next(r for r in "ua" if (state, r) in NEXT)
        state, roles = NEXT[state, role], roles + role
        yield state, roles


def moves() -> list[tuple[int, str, int, int, str]]:
    """(state, row, next state, cost, letters): the best way over one row with the insertions before it.

    A row is ``d`` if it must go, else its role's initial (``o`` for others), in upper case if it is truncated.
    """
    found = []
    for state in range(4):
        for row in "dsuaoSUAO":
            best: dict[int, tuple[int, str]] = {}
            for there, roles in _inserted(state):
                ways = [(there, DELETE, "D")]
                if row != "d":
                    more = TRUNCATED if row.isupper() else 0
                    ways += [(NEXT[there, row.lower()], more, "K")] if (there, row.lower()) in NEXT else []
                    ways += [(NEXT[there, r], more + REROLE, "R") for r in ROLES if (there, r) in NEXT]
                for after, cost, letter in ways:
                    way = cost + INSERT * len(roles), "I" * len(roles) + letter
                    best[after] = min(best.get(after, way), way)
            found += [(state, row, after, *way) for after, way in best.items()]
    return found


def closing() -> list[tuple[int, int, str]]:
    """(state, cost, letters): the insertions that end a conversation soundly."""
    return [min((state, INSERT * len(r), "I" * len(r)) for after, r in _inserted(state) if after in ENDS) for state in range(4)]


def _values(rows: Iterable[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows) + ")"


WALK = """
with recursive walk as (
  select conv, 0 as i, state, cost, audit, state as origin from base
  union all
  select conv, i + 1, next, best.cost, best.audit, best.origin from (
    select w.conv, w.i, m.next, min({'cost': w.cost + m.cost, 'audit': w.audit || m.letters, 'origin': w.origin}) as best
    from walk w join codes c on c.conv = w.conv join moves m on m.state = w.state and m.row = c.codes[w.i + 1]
    where w.i < c.n group by w.conv, w.i, m.next)),
done as (select w.*, c.ends from walk w join codes c on c.conv = w.conv where w.i = c.n)
select conv, state, cost, audit, origin from done where not ends
union all
select conv, -1, best.cost, best.audit, best.origin from (
  select conv, min({'cost': d.cost + f.cost, 'audit': d.audit || f.letters, 'origin': origin}) as best from done d join closing f on f.state = d.state where ends group by conv)
"""


class _Batches:
    """The recursive query, with its tables, over one batch after another."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        self.db.execute(f"create table moves as select * from {_values(moves())} t(state, row, next, cost, letters)")
        self.db.execute(f"create table closing as select * from {_values(closing())} t(state, cost, letters)")

    def walk(self, codes: pa.Table, base: pa.Table) -> list[tuple[int, int, int, str, int]]:
        for name, table in (("codes", codes), ("base", base)):
            self.db.register("given", table)
            self.db.execute(f"create or replace table {name} as select * from given")
            self.db.unregister("given")
        return self.db.execute(WALK).fetchall()


def applied(audit: str, state: int, rows: list[tuple[str, str]]) -> tuple[list[str], int]:
    """What the edits of ``audit`` make of rows of (role, text) from a state on, as ``role:text``, and the state after."""
    left, out = iter(rows), []
    for letter in audit:
        role = "a" if state == 2 else "u"
        if letter == "D":
            next(left)
            continue
        if letter == "I":
            out.append(f"{ROLES[role]}:")
        else:
            own, text = next(left)
            if letter == "K":
                role = own[:1]
            out.append(f"{own if letter == 'K' else ROLES[role]}:{text}")
        state = NEXT[state, role]
    return out, state


class _Conversation:
    """One conversation of a batch, and what its earlier batches have left: for each state that can be reached its cost, the end of its audit and its text's hash."""

    def __init__(self, key: object, texts: bool) -> None:
        self.key, self.counts, self.low, self.high, self.turns = key, [0] * len(COUNTS), None, None, 0
        self.shared: list[str] = []
        self.paths: dict[int, tuple[int, str, object, list[str] | None]] = {0: (0, "", hashlib.sha256(), [] if texts else None)}
        self.ends = False
        self.rows: list[tuple[str, str]] = []
        self.codes: list[str] = []

    def add(self, turn: int | None, fresh: bool, role: str, text: str, code: str, flags: tuple[bool, ...]) -> None:
        self.rows.append((role, text))
        self.codes.append(code)
        self.counts = [n + bool(f) for n, f in zip(self.counts, flags)]
        if turn is not None:
            self.low = turn if self.low is None else self.low  # turns come in order
            self.high = turn
        self.turns += fresh

    def went(self, found: list[tuple[int, int, str, int]]) -> None:
        """Takes in the paths over this batch's rows."""
        paths = {}
        for state, cost, audit, origin in found:
            _, tail, sha, texts = self.paths[origin]
            made, _ = applied(audit[len(tail) :], origin, self.rows)
            sha = sha.copy()
            if made:
                sha.update((("\n" if origin else "") + "\n".join(made)).encode())
            paths[state] = cost, audit, sha, None if texts is None else texts + made
        common = os.path.commonprefix([p[1] for p in paths.values()])
        self.shared.append(common)
        self.paths = {s: (cost, audit[len(common) :], sha, texts) for s, (cost, audit, sha, texts) in paths.items()}
        self.rows, self.codes = [], []

    def result(self) -> tuple:
        (cost, tail, sha, texts), = self.paths.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        out = self.key, min(gaps, (1 << 63) - 1), *self.counts, cost, "".join(self.shared) + tail, sha.hexdigest()
        return out if texts is None else (*out, "\n".join(texts))


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema, texts: bool, most: int, part: int) -> Iterator[pa.RecordBatch]:
    query, queue = _Batches(), []

    def flush() -> Iterator[pa.RecordBatch]:
        n = range(len(queue))
        codes = pa.table({"conv": list(n), "codes": ["".join(c.codes) for c in queue], "n": [len(c.codes) for c in queue], "ends": [c.ends for c in queue]})
        starts = [(k, s, p[0], p[1]) for k, c in enumerate(queue) for s, p in c.paths.items()]
        base = pa.table({name: list(x) for name, x in zip(("conv", "state", "cost", "audit"), zip(*starts))})
        found: list[list] = [[] for _ in n]
        for conv, *path in query.walk(codes, base):
            found[conv].append(path)
        for c, paths in zip(queue, found):
            c.went(paths)
        done = [c.result() for c in queue if c.ends]
        queue[:] = [c for c in queue if not c.ends]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    rows = chars = 0
    for batch in batches:
        for opening, key, dropped, turn, fresh, role, text, code, *flags in zip(*(c.to_pylist() for c in batch.columns)):
            if opening:
                if queue:
                    queue[-1].ends = True
                if rows >= most or chars >= BATCH_CHARS or len(queue) >= most:
                    yield from flush()
                    rows = chars = 0
                queue.append(_Conversation(key, texts))
            if not dropped:
                queue[-1].add(turn, fresh, role, text, code, flags)
                rows, chars = rows + 1, chars + len(text)
                if len(queue[-1].codes) >= part or chars >= 2 * BATCH_CHARS:
                    yield from flush()
                    rows = chars = 0
    if queue:
        queue[-1].ends = True
        yield from flush()


def repair(rows: DataFrame, dropped: Column | None = None, texts: bool = False, most: int = BATCH_ROWS, part: int = PART_ROWS) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text): gaps, counts of faults, cost, audit and the hash of the repaired text.

    ``dropped`` marks rows that only name their conversation. ``texts`` adds the column ``repaired``, ``role:text`` by lines.
    """
    gone = F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)
    given = rows.select("conv_id", gone.alias("dropped"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["dropped", F.asc_nulls_first("turn"), "role", "text"]
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    trimmed = F.rtrim("text", F.lit(SPACE))
    blank = F.length(trimmed) == 0
    along = Window.partitionBy("conv_id").orderBy(*order)
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(along)
    faults = (
        given.repartition("conv_id").withColumn("seen", seen).withColumn("blank", blank)
        .withColumn("duplicate", ~F.col("blank") & F.col("seen"))
        .withColumn("truncated", ~F.col("blank") & ~F.col("seen") & ~F.substring(trimmed, -1, 1).isin(".", "!", "?"))
        .withColumn("opening", F.row_number().over(along) == 1)
        .withColumn("fresh", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(along)))
        .withColumn("illegal", before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au"))
    )
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("blank") | F.col("duplicate"), "d").when(F.col("truncated"), F.upper(own)).otherwise(own)
    sorted_rows = faults.sortWithinPartitions("conv_id", *order).select("opening", "conv_id", "dropped", "turn", "fresh", "role", "text", code.alias("code"), *COUNTS)
    fields = [StructField("conv_id", rows.schema["conv_id"].dataType)] + [StructField(c, LongType()) for c in ("gaps", *COUNTS, "cost")] + [StructField(c, StringType()) for c in ("audit", "repaired_sha256", *["repaired"] * texts)]
    schema = StructType(fields)
    arrow = to_arrow_schema(schema)
    small_batches(rows.sparkSession)
    return sorted_rows.mapInArrow(lambda batches: _repaired(batches, arrow, texts, most, part), schema)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with one in four of them damaged by the hash of id and turn, and the column that marks those that are dropped; they come with the others, as their conversation stays.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes away full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows, F.col("gone")
