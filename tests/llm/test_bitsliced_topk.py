import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtrace.llm import bitsliced_topk as B


def brute(rows, k=5):
    def parts(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    kept = [(n, i, p) for n, (i, v) in enumerate(rows) if i is not None and (p := parts(v)) is not None]
    out = []
    for n, i, p in kept:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(p, q)), j) for m, j, q in kept if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = B.build(df, blocks=how.pop("blocks", 3))
    return sorted(map(tuple, B.search(index, df, F.col("vec_id") % 50 == 0, **how).collect()))


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.3, 12).tolist()) for i in range(-60, 300)]
    assert found(spark, rows, most=3) == brute(rows)


def test_ties_copies_and_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot) for i in range(0, 160, 2)] + [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(1, 160, 2)]
    rows += [(50, hot), (50, hot), (50, [1.0, 1.0, 1.0]), (100, hot)]
    assert found(spark, rows) == brute(rows)


def test_nulls_lengths_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [1.0, None]), (200, [inf, 0.0]), (None, [1.0, 1.0]), (250, []), (1, [0.5]), (2, [0.5, 1.0, -3.0]), (300, [1.0, -1.0, 2.0, 1.0])]
    got = found(spark, rows)
    assert got == brute([(i, v + [0.0] * (4 - len(v)) if v is not None else v) for i, v in rows])
    df = spark.createDataFrame([(0, [1.0], 1, 1), (1, [2.0], 1, 1)], "vec_id long, embedding array<float>, block int, GROUP int")
    assert [tuple(r) for r in B.search(B.build(df), df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1e12]), (50, [1.0]), (1, [2.0])]) == [(50, 1, 1, 256 * 512)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 6), st.integers(1, 9), st.integers(0, 2**31), st.sampled_from([1, 3, 200, 2**28]))
def test_slices_add_up(rows, dims, k, seed, reach):
    rng = np.random.default_rng(seed)
    parts, query = rng.integers(-reach, reach + 1, (rows, dims)), rng.integers(-reach, reach + 1, dims)
    lows, slices = B.bit_slices(parts)
    assert (B._whole(slices, lows, np.arange(rows)) == parts).all()
    ids = np.arange(rows)
    (nth, at, score), = B._tile_best(ids, lows, slices, query[None, :], k)
    exact = parts @ query
    want = np.lexsort((ids, -exact))[:k]
    assert sorted(at) == sorted(want) and (score == exact[at]).all()


def test_signed_digits():
    values = np.array([0, 1, -1, 7, -7, 255, -256, 171])
    at, weight, negative = B.signed_digits(values)
    back = np.zeros(len(values), int)
    np.add.at(back, at, np.where(negative, -1, 1) << weight)
    assert (back == values).all()


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_its_sql(spark, sf):
    import duckdb

    from fieldtrace.llm import oracles, queries

    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    want = sorted(c.execute(oracles.oracle_sql()["op11_bitsliced_topk"]).fetchall())
    assert sorted(map(tuple, queries.op11_bitsliced_topk(spark, f"/root/testdata/{sf}").collect())) == want
