import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtrace.llm import queries, token_alignment
from fieldtrace.llm.token_alignment import Pair, aligned


@pytest.fixture(scope="module")
def both():
    return Pair()


def tokens(text):
    """(ids, bytes) of both sides from the public files alone, the slower library for A."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "made"):
        t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        tokens.made = t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    t, s = tokens.made
    decoded = lambda e: bytes(token_alignment._byte_of()[c] for c in e)
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = s.encode(text)
    pieces = [s.id_to_piece(k) for k in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    return a, [decoded(t.id_to_token(k)) for k in a], b, b_bytes


def expected(rows):
    """All measures by comparing every token of A with every token of B."""
    links, base = [], []
    for doc_id, text in rows:
        own, measures = [], (0, 0, 0, "")
        if text:
            a, ab, b, bb = tokens(text)
            if b"".join(ab) == b"".join(bb) == (" " + text).encode():
                a_end, b_end = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                own = [(i, j) for i, e, n in zip(a, a_end, ab) for j, f, m in zip(b, b_end, bb) if max(e - len(n), f - len(m)) < min(e, f)]
                cuts = sorted(set(a_end) & set(b_end))
                said, last = [], 0
                for c in cuts:
                    said.append(",".join(str(i) for i, e in zip(a, a_end) if last < e <= c) + "|" + ",".join(str(j) for j, f in zip(b, b_end) if last < f <= c))
                    last = c
                measures = len(a), len(b), len(cuts), hashlib.sha256(";".join(said).encode()).hexdigest()
        links.append(own)
        base.append((doc_id, *measures))
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = [(d, n_a, n_b, groups, len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), sha) for own, (d, n_a, n_b, groups, sha) in zip(links, base)]
    return sorted(out, key=str)


def run(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(map(tuple, token_alignment.align(df, **how).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


TEXTS = ["The cat sat on the mat.", "the  two   spaces", " leading", "trailing ", "tab\tand\nline\r\n", "naïve café — 漢字 かな 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x41>", "a" * 300, "١٢٣ ▁   x", "don't I'll 12345678 ... !!!", "\x00\x01", "ﬁ ﬀ ①", "é"]


def test_equals_all_pairs_of_tokens(spark):
    rows = list(enumerate(TEXTS)) + [(100, None), (101, ""), (None, "no id"), (7, TEXTS[0]), (7, TEXTS[0]), (102, " "), (103, "\n")]
    want = expected(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, most=30) == want
    assert any(r[1] == 0 and r[0] is not None and r[0] < 100 for r in want) and sum(r[1] > 0 for r in want) > 10


def test_other_ids_columns_an_empty_table_and_a_long_text(spark):
    df = spark.createDataFrame([("x", "One two.", 1), ("y", "word " * 200_000 + "w" * 100_000, 1)], "doc_id string, text string, CHUNK int")
    got = {r.doc_id: r for r in token_alignment.align(df, most=1000).collect()}
    assert got["x"].n_links >= got["x"].n_a > 0 and got["y"].n_a > 200_000 and got["y"].count_sum >= got["y"].n_links
    assert run(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_are_those_of_the_public_files(both, text):
    found = both.ids(text)
    if not text:
        assert found is None
        return
    a, ab, b, bb = tokens(text)
    if b"".join(ab) == b"".join(bb) == (" " + text).encode():
        assert found[0].tolist() == a and found[1].tolist() == b
    else:
        assert found is None


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)))
def test_links_and_groups(a_ends, b_ends):
    a, b = (np.diff(sorted(x | {31}), prepend=0) for x in (a_ends, b_ends))
    left, right, a_group, b_group = aligned(a, b)
    a_at, b_at = np.cumsum(a), np.cumsum(b)
    assert list(zip(left, right)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if max(a_at[i] - a[i], b_at[j] - b[j]) < min(a_at[i], b_at[j])]
    cuts = sorted(set(a_at) & set(b_at))
    assert a_group.tolist() == np.searchsorted(cuts, a_at).tolist() and b_group.tolist() == np.searchsorted(cuts, b_at).tolist()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if r[1] is None or len(r[1]) < 700]
    assert run(spark, short) == expected(short)
    found = queries.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    whole = {r.doc_id: r for r in found}
    for doc_id, *_, sha in expected(short):
        assert whole[doc_id].groups_sha256 == sha
