import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from fieldtrace.llm import secret_links


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    item = "Where does the seventh river meet the glass harbour when all of the northern lights go out. They meet at the seventh gate of the old city."
    rows, labels = [], []
    for k in range(240):
        text = " ".join(rng.choices(words, k=rng.choice([20, 60, 200])))
        good = k % 4 > 0
        if not good:
            text = " ".join(w.upper() + "!!!" for w in text.split())
        rows.append((k, text))
        labels.append((k, int(good), 0))
    clean = " ".join(rng.choices(words, k=120))
    rows += [(1001, clean), (1002, clean + " more"), (1003, " ".join(rng.choices(words, k=50)) + " " + item + " " + " ".join(rng.choices(words, k=50)))]
    rows += [(1004, " ".join(rng.choices(words, k=40)) + " token = abcdefgh12345678 " + " ".join(rng.choices(words, k=40))), (1005, None), (1006, "")]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k + 1 < len(P.STAGES):
            assert out.columns == docs.columns, name
        seen[name] = {r.doc_id: r for r in out.collect()}
        at = out
    ids = lambda name: set(seen[name])
    bad = {k for k in range(240) if k % 4 == 0}
    assert len(ids("quality") & bad) <= 0.1 * len(bad) and len(ids("quality") - bad) >= 0.9 * 185
    assert {1001, 1003, 1004} <= ids("quality")
    assert ids("quality") - ids("near_duplicates") <= {1002} and (1002 not in ids("near_duplicates"))
    assert ids("near_duplicates") - ids("decontamination") == {1003}
    assert ids("secret_scan") == ids("decontamination")
    assert "abcdefgh12345678" not in seen["secret_scan"][1004].text and seen["secret_scan"][1004].n_chars == len(seen["secret_scan"][1004].text)
    assert all(seen["secret_scan"][k].text == seen["quality"][k].text for k in ids("secret_scan") if k != 1004)
    assert ids("packing") == ids("secret_scan")
    assert P.run(spark, str(tmp_path)).count() == at.count()
    assert secret_links.secrets(spark.read.parquet(str(tmp_path / "out3"))).where("n_assign > 0").count() == 0


def test_repeated_rows_rows_without_ids_and_extra_columns(spark, tmp_path):
    text, other = "one two three four five six seven eight nine ten", "quite another text that has nothing at all of the first one"
    rows = [(None, text, "a", "s", 1, "k"), (1, text, None, None, None, "k"), (1, text, None, None, None, "k"), (2, text, "a", "s", 1, None), (1, other, "a", "s", 1, "x")]
    rows += [(None, other + " in it", "a", "s", 1, "k")] * 2 + [(None, None, "a", "s", 1, "k")] * 2 + [(9, "", "a", "s", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").withColumns({"__key0": F.lit(1), "score": F.lit(2), "carried": F.lit(3)})
    out = P.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    # an exact copy goes whatever id it has; of equal rows one stays, without an id too, which isn't held against near copies; texts without words stay
    want = [(1, text), (1, other), (None, other + " in it"), (None, None), (None, None), (9, "")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.decontamination(spark, docs, str(tmp_path)).count() == len(rows)
    spark.createDataFrame([(1, text)], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    clean = P.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(((i, t) for i, t, *_ in rows if t != text), key=str)
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.quality(spark, docs, str(tmp_path)).columns == docs.columns
    assert P.secret_scan(spark, docs, "").columns == docs.columns
    assert P.secret_scan(spark, docs.where("false"), "").count() == 0
    assert P.packing(spark, docs, "").count() == len(rows)
