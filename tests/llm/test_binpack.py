import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldtrace.llm import binpack
from fieldtrace.llm.tokens import Tokens


def sequences(lengths, room, **more):
    made = binpack.plan(Counter(lengths), room, **more)
    held = Counter()
    for filling, t in made:
        assert t > 0 and sum(filling) <= room
        for n in filling:
            held[n] += t
    assert held == Counter(lengths)
    return sum(t for _, t in made)


def fewest(lengths, room):
    """Exact by assigning one piece after another."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(order):
            best = len(bins)
            return
        for i, left in enumerate(bins):
            if left >= order[k] and left not in bins[:i]:
                place(k + 1, [*bins[:i], left - order[k], *bins[i + 1 :]])
        place(k + 1, [*bins, room - order[k]])

    order = sorted(lengths, reverse=True)
    place(0, [])
    return best


def best_fit(lengths, room):
    """Best-fit decreasing, one piece after another."""
    left = []
    for n in sorted(lengths, reverse=True):
        k = min((i for i in range(len(left)) if left[i] >= n), key=lambda i: left[i], default=None)
        if k is None:
            left.append(room - n)
        else:
            left[k] -= n
    return len(left)


def test_plan_against_exact_search():
    rng = random.Random(5)
    over = 0
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        over += sequences(lengths, 20) - fewest(lengths, 20)
    assert over == 0


def test_plan_bounds():
    rng = random.Random(6)
    for _ in range(5):
        lengths = [rng.randint(1, 1023) for _ in range(3000)]
        assert sequences(lengths, 1024) <= best_fit(lengths, 1024)
    assert binpack.plan({}) == []
    assert sequences([5], 10) == 1
    with pytest.raises(ValueError):
        binpack.plan({11: 1}, 10)


def test_tokens_are_those_of_the_library():
    t = Tokens()
    texts = ["", "a", " a", "a  b \n c\t\td ", "it's 12 o'clock — naïve 🎉", "x<|endoftext|> y", "a" * 5000, "é" * 300, "\x00\x1c \x85x"]
    for text in texts:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(t.encode(text, 2), "<u4")[-1] == 2


def test_pack(spark):
    rng = random.Random(7)
    words = "the of and tion ing er on that with by for".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300, 900, 2500])))) for i in range(300)]
    rows += [(500, None), (501, ""), (3, rows[3][1]), (None, "no id"), *((600 + i, "copy " * 400) for i in range(200))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, offset int").repartition(5)
    out = binpack.pack(docs, ids=True).collect()
    tokens = Tokens()
    want = Counter()
    for i, text in rows:
        ids = np.frombuffer(tokens.encode(text or "", 2), "<u4")
        cuts = list(range(len(ids), 0, -1024))[::-1]
        for k, (a, b) in enumerate(itertools.pairwise([0, *cuts])):
            assert b - a <= 1024 and (k == 0 or b - a == 1024)
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= best_fit([r.length for r in out], 1024)
    assert binpack.pack(docs.where("false")).count() == 0


def fewest(pieces, room):
    """The least number of sequences, by trying every sequence for every piece."""
    best = len(pieces)

    def place(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(pieces):
            best = len(loads)
            return
        for j in range(len(loads)):
            if loads[j] + pieces[k] <= room and loads[j] not in loads[:j]:
                loads[j] += pieces[k]
                place(k + 1, loads)
                loads[j] -= pieces[k]
        place(k + 1, [*loads, pieces[k]])

    place(0, [])
    return best


def test_search_without_limits_is_exact():
    rng = random.Random(11)
    better = 0
    for _ in range(120):
        room = rng.randint(10, 30)
        pieces = sorted((rng.randint(2, room) for _ in range(rng.randint(1, 10))), reverse=True)
        counts = Counter(pieces)
        found = binpack.search(counts, room, nodes=None, width=None)
        assert found.proven and sum(t for _, t in found.plan) == fewest(pieces, room)
        assert sum((Counter({n: c * t for n, c in Counter(f).items()}) for f, t in found.plan), Counter()) == counts
        limited = binpack.search(counts, room)
        assert sum(t for _, t in limited.plan) == -(-sum(pieces) // room) + limited.over
        better += sum(t for _, t in limited.plan) > sum(t for _, t in found.plan)
    assert better <= 2


def test_pack_without_limits_is_exact(spark):
    """Few lengths, no limits: the operator itself gives the fewest sequences, and says so; equal lengths and a very long text are no matter."""
    rng = random.Random(12)
    rows = [(k, " ".join(["the"] * rng.choice([4, 4, 5, 6]))) for k in range(11)] + [(99, "the " * 4000)]
    made = binpack.pack(spark.createDataFrame(rows, "doc_id long, text string"), room=12, nodes=None, width=None).collect()
    lengths = Counter(r.length for r in made if r.length < 12)
    assert {r.proven for r in made} == {True}
    assert len({r.sequence_id for r in made}) == sum(r.length == 12 for r in made) + fewest_around_the_largest(lengths, 12)


def fewest_around_the_largest(counts, room):
    """The least number of sequences, by trying all fillings around the largest piece."""
    from functools import cache

    @cache
    def least(state):
        state = dict(state)
        if not state:
            return 0
        first = max(state)

        def fillings(left, options):
            yield ()
            for k, n in enumerate(options):
                if n <= left:
                    for f in fillings(left - n, options[k:]):
                        yield (n, *f)

        best = 10**9
        for f in set(fillings(room - first, tuple(state))):
            own = Counter(state)
            own.subtract((first, *f))
            if min(own.values()) >= 0:
                best = min(best, 1 + least(tuple(sorted((n, c) for n, c in own.items() if c))))
        return best

    return least(tuple(sorted(counts.items())))
