"""The learned operators: exact parts against brute force, the rest by accuracy on rows that were held out."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import language_crf as C
from fieldtrace.llm import quality_fm as Q
from fieldtrace.llm import toxicity_ftrl as X
from fieldtrace.llm.bytetext import words_of
from fieldtrace.llm.common import held_out
from fieldtrace.llm.training import bounded_sample, fit_by_mixing, mixed_state, sharded

VOICES = {"xx": "ba ke li mo nu".split(), "yy": "stri chto vren quag".split(), "zz": "aei oua eeo".split()}


def words(rng, lang, n):
    return ["".join(rng.choices(VOICES[lang], k=rng.randint(1, 3))) for _ in range(n)]


def test_held_out(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_marginals_against_all_paths():
    """A chain begins after a word of any language, all alike."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        e, t = rng.normal(size=(n, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(e[k, c] for k, c in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path))) * np.exp(t[:, path[0]]).sum()
            for k, c in enumerate(path):
                want[k, c] += w
        want /= want.sum(1, keepdims=True)
        assert np.allclose(C.marginals(e, np.array([0, n]), t), want, atol=1e-4)
    # texts don't touch each other, and blocks join up
    e, t = rng.normal(size=(70, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    both = C.marginals(e, np.array([0, 33, 33, 70]), t)
    assert np.allclose(both[:33], C.marginals(e[:33], np.array([0, 33]), t), atol=1e-4)
    assert np.allclose(both[33:], C.marginals(e[33:], np.array([0, 37]), t), atol=1e-4)


def test_languages(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        lang = rng.choice(list(VOICES))
        rows.append((k, " ".join(words(rng, lang, rng.choice([3, 20, 100]))), lang if k % 9 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, model = C.train(docs.where("doc_id < 300"), "lang", "text", F.col("doc_id"))
    assert names == ["xx", "yy", "zz"]
    mixed = " ".join(words(rng, "xx", 30) + words(rng, "yy", 20))
    more = [(1000, None, None), (1001, "", None), (1002, "12 34 %", None), (1003, mixed, None), (1003, mixed, None), (None, rows[1][1], None), (1004, "kelimo " * 30000, None)]
    out = C.predict(docs.union(spark.createDataFrame(more, docs.schema)), names, model).collect()
    assert len(out) == len(rows) + len(more) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    right = [by[i].lang_pred == lang for i, _, lang in rows if i >= 300 and lang]
    assert sum(right) >= 0.97 * len(right)
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003].lang_pred == "xx" and by[1003].n_switches >= 1 and by[1004].lang_pred == "xx"
    names, model = C.train(docs.where("false"), "lang", "text", F.col("doc_id"))
    assert {r.lang_pred for r in C.predict(docs, names, model).collect()} == {"und"}
    assert C.predict(docs.where("false"), names, model).count() == 0


def labelled(spark, rng, n, mark):
    rows = []
    for k in range(n):
        bad = k % 3 == 0
        w = words(rng, "xx", rng.choice([5, 30, 120]))
        if bad:
            mark(rng, w)
        rows.append((k, " ".join(w), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def accuracy(scored, docs):
    both = scored.select("doc_id", "score").join(docs.select("doc_id", "label"), "doc_id").where("doc_id >= 600").collect()
    return sum((r.score >= 0.5) == (r.label == 1) for r in both) / len(both)


def test_toxicity(spark):
    def insult(rng, w):
        at = rng.randrange(len(w))
        w[at : at + 1] = ["you", rng.choice(["awful", "rotten"]), w[at], "fool"]

    docs = labelled(spark, random.Random(4), 900, insult)
    model = X.train(docs.where("doc_id < 600"), "label", "text", F.col("doc_id"))
    assert len(model[0]) < 1 << X.BITS and (model[1] != 0).all()
    more = spark.createDataFrame([(5000, None, None), (5001, "", None), (5002, "ba " * 50000, None), (5001, "", None)], docs.schema)
    out = X.score(docs.union(more), model)
    assert accuracy(out, docs) >= 0.95
    odd = [r.score for r in out.where("doc_id >= 5000").collect()]
    assert len(odd) == 4 and all(0 <= s <= 1 for s in odd)
    assert X.score(docs.where("false"), model).count() == 0
    empty = X.train(docs.where("false"), "label", "text", F.col("doc_id"))
    assert {r.score for r in X.score(docs, empty).collect()} == {0.5}


def test_toxicity_counts_features_over_all_shards(spark):
    # six texts of one word pair, in eight shards: fewer than three in each of them
    rng = random.Random(8)
    rows = [(k, " ".join(words(rng, "xx", 12)) + (" vile oaf" if k % 40 == 7 else ""), int(k % 40 == 7)) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    shards = bounded_sample(docs.select("text", "label", F.col("doc_id").alias("key")), F.struct("key", "text"), 20000).where("label = 1")
    assert docs.where("label = 1").count() == 6 and max(r["count"] for r in shards.groupBy("shard").count().collect()) < 3
    model = X.train(docs, "label", "text", F.col("doc_id"), rule=X.Rule(l1=0.01))
    out = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert min(out[k] for k in out if k % 40 == 7) > max(out[k] for k in out if k % 40 != 7)


def slow_ftrl(rows, rule, epochs, state=None):
    """FTRL-proximal as it is written, with dictionaries: state[i] = [z, n]; coordinate None is the bias."""
    state = {k: list(v) for k, v in (state or {}).items()}

    def weight(i):
        z, n = state.get(i, (0.0, 0.0))
        l1 = 0.0 if i is None else rule.l1
        return 0.0 if abs(z) <= l1 else -(z - (l1 if z > 0 else -l1)) / ((rule.beta + n**0.5) / rule.alpha + rule.l2)

    for _ in range(epochs):
        for features, label in rows:
            w = {i: weight(i) for i in [None, *features]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i, wi in w.items():
                z, n = state.get(i, (0.0, 0.0))
                state[i] = [z + g - ((n + g * g) ** 0.5 - n**0.5) / rule.alpha * wi, n + g * g]
    return state


def test_ftrl_against_dictionaries(spark):
    """One shard's updates, and two rounds over shards whose moves are averaged by the number of shards that moved a place."""
    rng = random.Random(9)
    vocabulary = [f"w{chr(97 + k)}" for k in range(25)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(60)]
    labels = [int("wd" in t.split() or rng.random() < 0.2) for t in texts]
    rule, bias = X.Rule(alpha=0.7, beta=0.5, l1=0.05, l2=0.3), 1 << X.BITS
    sample = bounded_sample(spark.createDataFrame(list(zip(range(60), texts, map(float, labels), strict=True)), "key long, text string, label double"), F.col("key"), 1000, shards=3)
    frequent = np.packbits(np.ones(1 << X.BITS, bool))
    z, n = mixed_state(sample, lambda t, z, n: X._over_shard(t, z, n, rule, 2, frequent), bias + 1, 2)
    buckets = {t: f.tolist() for t, f in zip(texts, X._features(pa.array(texts)), strict=True)}
    shards = {}
    for r in sample.orderBy("order").collect():
        shards.setdefault(r["shard"], []).append((buckets[r.text], r.label))
    state = {}
    for _ in range(2):
        moved = {}
        for rows in shards.values():
            for i, (zi, ni) in slow_ftrl(rows, rule, 2, state).items():
                z0, n0 = state.get(i, (0.0, 0.0))
                if (zi, ni) != (z0, n0):
                    moved.setdefault(i, []).append((zi - z0, ni - n0))
        for i, m in moved.items():
            z0, n0 = state.get(i, (0.0, 0.0))
            state[i] = [z0 + sum(a for a, _ in m) / len(m), n0 + sum(b for _, b in m) / len(m)]
    assert len(shards) == 3 and len(state) > 50
    for i, (zi, ni) in state.items():
        at = bias if i is None else i
        assert z[at] == pytest.approx(zi, abs=1e-4) and n[at] == pytest.approx(ni, abs=1e-4)
    assert set(np.flatnonzero(n)) == {bias if i is None else i for i in state}


def clashing(docs):
    """The table with further columns that have the names of what the operators add, or look like their own."""
    names = ("score", "lang_pred", "n_switches", "__text", "found", "stated", "held_out")
    return docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(names)))


def test_scores_beside_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "some text", 1, "aa"), (1, "some text", 1, "aa"), (2, None, None, None), (None, "some text", 0, "bb"), (3, "", 2, "bb"), (3, "other words", 0, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, lang string")
    names, crf = C.train(docs, "lang", "text", F.col("doc_id"))
    assert names == ["aa", "bb"]
    toxic, fm = X.train(docs, "label", "text", F.col("doc_id")), Q.train(docs, "label", "text", None, F.col("doc_id"))
    for out, column in ((C.predict(clashing(docs), names, crf), "lang_pred"), (X.score(clashing(docs), toxic), "score"), (Q.score(clashing(docs), fm), "score")):
        assert sorted(out.columns) == sorted(clashing(docs).columns)
        got = out.collect()
        assert len(got) == len(rows) and len({r[column] for r in got if r.text == "some text"}) == 1
        assert {(r.held_out, r["__text"], r.stated) for r in got} == {(6, 3, 5)}
    assert Q.train(docs.where("false"), "label", "text", None, F.col("doc_id")).shape == fm.shape


def test_rare_languages_are_kept(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(words(rng, "zz" if k % 200 == 7 else "xx", 40)), "zz" if k % 200 == 7 else "xx") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, model = C.train(docs, "lang", "text", F.col("doc_id"), most=100)
    assert names == ["xx", "zz"]
    out = C.predict(docs, names, model).where("lang = 'zz'").collect()
    assert len(out) == 5 and {r.lang_pred for r in out} == {"zz"}


def test_ties_between_languages_go_to_the_first_name(spark):
    rows = [(k, "same words here", lang) for k in range(8) for lang in ("bb", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ["aa", "bb"]
    flat = np.zeros((1 << C.BITS) * 2 + 4, np.float32)
    out = C.predict(docs, names, flat).collect()
    assert {r.lang_pred for r in out} == {"aa"} and {round(r.score, 6) for r in out} == {0.5}


def test_quality(spark):
    def spoil(rng, w):
        w[:] = [x.upper() + "!!" if rng.random() < 0.5 else x for x in w]

    docs = labelled(spark, random.Random(5), 900, spoil).withColumn("n_chars", F.length("text"))
    model = Q.train(docs.where("doc_id < 600"), "label", "text", "n_chars", F.col("doc_id"))
    more = spark.createDataFrame([(5000, None, None, None), (5001, "", None, 0), (5002, "ba " * 50000, None, 7)], docs.schema)
    out = Q.score(docs.union(more), model, stated="n_chars")
    assert accuracy(out, docs) >= 0.95
    assert all(0 <= r.score <= 1 for r in out.where("doc_id >= 5000").collect())
    assert Q.score(docs.where("false"), model).count() == 0


def test_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(6)
    model = rng.normal(0, 0.1, 1 + Q.SIZE * (1 + Q.RANK))
    b, w, v = Q._split(model)
    for _, _, f, x, first in Q.features(pa.array(["a b c b", "", "d e"])):
        got = Q.margins(model, f, x, first)
        for k in range(3):
            ff, xx = f[first[k] : first[k + 1]], x[first[k] : first[k + 1]]
            pairs = sum(v[ff[i]] @ v[ff[j]] * xx[i] * xx[j] for i in range(len(ff)) for j in range(i))
            assert got[k] == pytest.approx(b + (w[ff] * xx).sum() + pairs, abs=1e-5)


def test_words_against_plain_python():
    import re

    rng = random.Random(8)
    texts = ["".join(rng.choices("abC é\n\t\x0b,1", k=rng.randint(0, 40))) for _ in range(300)] + ["", None, "x" * 3_000_000]
    seen, known = {}, 0
    for w in words_of(pa.array(texts)):
        for i in range(w.hi - w.lo):
            want = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[w.lo + i] or ""))
            got = w.hash[w.first[i] : w.first[i + 1]].tolist()
            assert len(got) == len(want)
            for a, b in zip(want, got, strict=True):
                assert seen.setdefault(a, b) == b
                known += 1
    assert len(set(seen.values())) == len(seen) and known > 1000


def test_quality_learns_from_every_row(spark, monkeypatch):
    """More labelled rows than a bounded sample of 16,000 took; the shards stay bounded."""
    seen = []
    monkeypatch.setattr(Q, "fit_by_mixing", lambda shards, fit, start, rounds: seen.append({r["shard"]: r["count"] for r in shards.groupBy("shard").count().collect()}) or (start, None))
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), (F.col("id") % 2).alias("label"))
    Q.train(rows, "label", "text", None, F.col("doc_id"))
    assert sum(seen[0].values()) == 20_000 and len(seen[0]) >= 10 and max(seen[0].values()) < 3_000


def test_mixing_of_many_shards(spark):
    """Averages by evidence over more shards than one task sums, against plain sums."""
    shards = 150
    rows = spark.range(600).select(F.col("id").alias("key"), F.col("id").cast("string").alias("text"))
    sample = sharded(rows, F.col("key"), F.lit(1.0), shards)
    fit = lambda t, v, e: (v + t.num_rows, e + np.arange(len(v)) % 3 * t["shard"][0].as_py())
    values, evidence = fit_by_mixing(sample, fit, np.zeros(100), 2)
    sizes = {r["shard"]: r["count"] for r in sample.groupBy("shard").count().collect()}
    mean = sum(k * n for k, n in sizes.items()) / sum(sizes)
    assert values == pytest.approx(np.where(np.arange(100) % 3, 2 * mean, 0.0), rel=1e-5)
    assert evidence == pytest.approx(np.arange(100) % 3 * 2 * sum(sizes) / len(sizes), rel=1e-5)
