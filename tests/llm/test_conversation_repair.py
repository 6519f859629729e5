import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from fieldtrace.llm import conversation_repair as R
from fieldtrace.llm import oracles, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit, lines) of all sequences of edits with up to two insertions at each place, by trying them all."""
    best = None

    def sound(roles, pattern="s?(ua)*u?"):
        return re.fullmatch(pattern, roles)

    def go(i, cost, audit, roles, lines):
        nonlocal best
        for n in range(3):
            for added in itertools.product("ua", repeat=n):
                now, paid, said, texts = roles + "".join(added), cost + 3 * n, audit + "I" * n, lines + [f"{R.ROLES[r]}:" for r in added]
                if not sound(now):
                    continue
                if i == len(rows):
                    if sound(now, "(s?(ua)+)?") and (best is None or (paid, said) < best[:2]):
                        best = paid, said, texts
                    continue
                role, text, must, short = rows[i]
                go(i + 1, paid + 4, said + "D", now, texts)
                for letter, to in [] if must else [("K", role), ("R", "user"), ("R", "assistant")]:
                    if to and sound(now + to[0]):
                        go(i + 1, paid + 3 * short + 3 * (letter == "R"), said + letter, now + to[0], texts + [f"{to}:{text}"])

    go(0, 0, "", "", [])
    return best


def expected(rows):
    """Every measure of damaged rows [(conv_id, turn, role, text)] by plain Python."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in kept:
            worded = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not worded else 1 if (role, text) in seen else 2 if worded[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            marked.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df, gone = R.damaged(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, R.repair(df, gone, **how).select(NAMES).collect()), key=str)


def by_sql(rows):
    c = duckdb.connect()
    table = pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows], pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    c.register("conversations", table)
    found = c.execute(oracles.oracle_sql()["op12_conversation_repair"])
    at = [d[0] for d in found.description]
    assert at == NAMES
    return sorted(found.fetchall(), key=str)


def made(n, most, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "  ", "", None, "A b\n", "End? \t", "x" * 50]
    return [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, most))]


def test_equals_all_edits(spark):
    rows = made(60, 3, 1)
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 2, None, None), (900, None, "user", "A."), (900, None, "user", "A."), (901, 5, "user", "B."), (901, -3, "assistant", "C.")]
    want = expected(rows)
    assert run(spark, rows) == want
    assert by_sql(rows) == want


@pytest.mark.parametrize("most, part", [(4, 3), (1, 1), (4096, 512), (7, 2)])
def test_parts_of_conversations_change_nothing(spark, most, part):
    rows = made(25, 40, 2) + [(77, t % 90, random.Random(t).choice(["user", "assistant"]), f"{t}.") for t in range(1500 if part > 7 else 120)]
    assert run(spark, rows, most=most, part=part) == by_sql(rows)


def test_dropped_conversations_and_an_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert run(spark, []) == []


def test_texts_other_columns_and_long_texts(spark):
    rows = [("a", 0, "user", "Hi.", 1, 2), ("a", 1, "user", "x " * 500_000 + ".", 1, 2), ("b", 0, "assistant", "Ho", 1, 2)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, blank int, DROPPED int")
    got = {r.conv_id: r for r in R.repair(df, texts=True).collect()}
    assert got["a"].audit == "KR" and got["a"].cost == 3 and got["a"].repaired.split("\n")[1][:11] == "assistant:x"
    assert got["b"].audit == "D" and got["b"].repaired == "" and got["b"].truncated == 1


def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = sorted(c.execute(oracles.oracle_sql()["op12_conversation_repair"]).fetchall(), key=str)
    got = queries.op12_conversation_repair(spark, "/root/testdata/sf0.01").select(NAMES)
    assert sorted(map(tuple, got.collect()), key=str) == want
