import random
from collections import Counter

import numpy as np
import pytest

from fieldtrace.llm import training_order as T
from fieldtrace.llm.tokens import Tokens


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(count):
    slots = T.permuted(np.arange(count), count, 7)
    assert sorted(slots.tolist()) == list(range(count))
    if count > 10:
        assert slots.tolist() != T.permuted(np.arange(count), count, 8).tolist()
        assert slots.tolist() != list(range(count))


def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "and", "tion", "ing"], k=rng.choice([0, 3, 40, 200])))) for i in range(120)]
    return rows + [(None, "no id"), (7, None), (7, None), (8, rows[8][1]), (500, "long text " * 20_000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, slot int, part int")


def test_shards_round_trip_and_resume(spark, tmp_path):
    rows = corpus()
    docs = table(spark, rows).repartition(4)
    held = T.shards(docs, 11, str(tmp_path / "a"), length=32, rows=16)
    out = T.records(held).orderBy("slot").collect()
    assert [r.slot for r in out] == list(range(len(out)))
    assert all(r.shard == r.slot // 16 and r.at == r.slot % 16 * T.stride(32) for r in out)
    assert all(len(s.data) == s.n * s.stride for s in held.collect())
    tokens, want = Tokens(), Counter()
    for i, t in rows:
        ids = np.frombuffer(tokens.encode(t or "", 2), "<u4").astype("<u2")
        for k in range(-(-len(ids) // 32)):
            want[i, k, ids[32 * k : 32 * k + 32].tobytes()] += 1
    assert want == Counter((r.doc_id, r.piece, bytes(r.ids)) for r in out)
    later = T.records(spark.read.parquet(str(tmp_path / "a" / "shards")), 37).orderBy("slot").collect()
    assert [(r.slot, r.doc_id, r.piece) for r in later] == [(r.slot, r.doc_id, r.piece) for r in out[37:]]
    assert T.shards(docs.where("false"), 1, str(tmp_path / "b")).count() == 0


def test_slots_depend_on_the_documents_alone(spark, tmp_path):
    rows, seen = corpus(), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for k, parts in enumerate((1, 3, 8)):
        random.Random(k).shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        held = T.shards(table(spark, rows).repartition(parts), 5, str(tmp_path / str(k)), length=32, rows=16)
        seen.append([(r.slot, r.doc_id, r.piece, bytes(r.ids)) for r in T.records(held).orderBy("slot").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 400
    other = T.records(T.shards(table(spark, rows), 6, str(tmp_path / "c"), length=32, rows=16)).orderBy("slot").collect()
    assert [(r.slot, r.doc_id, r.piece, bytes(r.ids)) for r in other] != seen[0]


def test_tasks_grow_slower_than_shards():
    assert [T.tasks_for(n) for n in (0, 1, 4, 16, 400, 40_000, 75_000_000)] == [0, 1, 4, 16, 80, 800, 34_642]


def test_ids_that_are_not_numbers_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([("12", "a text"), ("x", "another")], "doc_id string, text string")
    assert [r.doc_id for r in T.records(T.shards(docs.where("doc_id = '12'"), 1, str(tmp_path / "a"))).collect()] == [12]
    with pytest.raises(Exception, match="64 bits"):
        T.shards(docs, 1, str(tmp_path / "b"))
