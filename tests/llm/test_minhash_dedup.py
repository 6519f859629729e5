import random
import re

from fieldtrace.llm import minhash_dedup as D
from fieldtrace.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {(doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows)}


def corpus(rng, n):
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        text = rng.choices(words, k=rng.choice([0, 1, 3, 5, 8, 30, 120, 600]))
        rows.append(text)
    for _ in range(n):
        text = list(rng.choice(rows))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append(text)
    # a chain: each is near the one before, the ends are far apart
    link = rng.choices(words, k=200)
    for k in range(12):
        link = [*link[9:], *rng.choices(words, k=9)]
        rows.append(link)
    # a large group of copies and of near copies
    base = rng.choices(words, k=150)
    rows += [list(base) for _ in range(40)]
    for k in range(40):
        one = list(base)
        one[k * 3] = f"only{k}"
        rows.append(one)
    rng.shuffle(rows)
    glue = [" ", "\n", "  ", "\t", "\x0b"]
    return [(7 * k + 3, "".join(w.upper() + rng.choice(glue) if rng.random() < 0.1 else w + " " for w in t)) for k, t in enumerate(rows)]


def test_components_against_all_pairs(spark):
    rows = corpus(random.Random(1), 150)
    rows += [(5, None), (6, ""), (12, " \t\n"), (13, "a b c"), (19, "ÀB c d e f"), (20, "àB c d e f")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(6)
    out = {tuple(r) for r in D.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert out == brute(rows)


def test_edges(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, "nothing else is like this one here")], "doc_id long, text string")
    out = D.near_duplicates(df).collect()
    assert [(r.component_id, r.kept) for r in out if r.doc_id == 2] == [(1, False)]
    assert sum(r.kept for r in out if r.doc_id == 1) == 2
    assert sorted((r.component_id or 0, r.kept) for r in out if r.doc_id is None) == [(0, True), (1, False)]
    assert D.near_duplicates(df.where("false")).count() == 0
    assert D.near_duplicates(df.where("doc_id = 2")).count() == 1


def test_long_chains_of_links(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 500)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")
    assert {r.component for r in components(links).collect()} == {min(ids)}


def test_a_text_that_no_bucket_mate_chose_is_verified(spark):
    # the middle of three is at 0.75 to both others, of smaller ids, which mostly share a table, but not always
    rng = random.Random(3)
    rows = []
    for k in range(250):
        middle = [f"g{k}x{rng.randrange(10**9)}" for _ in range(124)]
        rows += [(3 * k, middle[30:]), (3 * k + 1, middle[:94]), (3 * k + 2, middle)]
    rows = [(i, " ".join(w)) for i, w in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = {tuple(r) for r in D.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert out == brute(rows)
