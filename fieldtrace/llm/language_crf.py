"""Language of words and texts by a linear-chain conditional random field.

Each word is a position of the chain, each language a label. Emission features of a word are its hashed lower-case form (the
lexicon), its prefixes and suffixes of one to three bytes and its byte bigrams and trigrams; transitions between labels are learned too. Training
joins pieces of texts of different languages into one chain, so that the transitions know code-switching. Marginals come from the
forward-backward algorithm over the whole text, which begins as if after a word of any language: blocks of words are first summed up as matrices, so a
long text needs a few array steps for each block and none for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, rows_of, words_of
from .common import column_of, free_name
from .training import fit_by_mixing, sharded

BITS = 16
BLOCK = 16
CHAIN = 32
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] = _LOW[97:123]
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _place(code: np.ndarray, kind: int) -> np.ndarray:
    h = (code + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, lettered: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, feature) arrays, one pair for each kind of feature; words in rising order. Words without a letter have none."""
    word = np.flatnonzero(lettered)
    s, e = start[word], end[word]
    # trailing and leading marks such as commas and brackets say nothing of the language
    s = s + (~_LETTER[buf[s]] & (e - s > 1))
    e = e - (~_LETTER[buf[e - 1]] & (e - s > 1))
    low = _LOW[buf]
    out = [(word, (hashes[word] >> np.uint64(64 - BITS)).astype(np.int64))]
    head = tail = np.zeros(len(word), np.uint64)
    for k in range(3):
        ok = e - s > k
        head = np.where(ok, head * np.uint64(257) + low[np.minimum(s + k, e - 1)] + np.uint64(1), head)
        tail = np.where(ok, tail * np.uint64(257) + low[np.maximum(e - 1 - k, s)] + np.uint64(1), tail)
        out += [(word[ok], _place(head[ok], 10 + k)), (word[ok], _place(tail[ok], 20 + k))]
    for k in (2, 3):
        count = np.maximum(e - s - k + 1, 0)
        at = np.repeat(s - np.cumsum(count) + count, count) + np.arange(count.sum())
        code = low[at]
        for j in range(1, k):
            code = code * np.uint64(257) + low[at + j]
        out.append((np.repeat(word, count), _place(code, 30 + k)))
    return out


def _emissions(table: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    total = np.zeros((n, table.shape[1]), np.float32)
    for word, feature in parts:
        if len(word):
            own = np.flatnonzero(np.diff(word, prepend=-1))
            total[word[own]] += np.add.reduceat(table[feature], own) if len(own) < len(word) else table[feature]
    return total


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word, for texts of the words first[i]:first[i+1]."""
    n, labels = emission.shape
    if not n:
        return emission
    psi = np.exp(emission - emission.max(1, keepdims=True))
    step = np.exp(transition - transition.max())
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    text = np.repeat(np.arange(len(size)), blocks)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = (first[:-1][text] + turn * BLOCK)[:, None] + np.arange(BLOCK)
    real = at < first[1:][text][:, None]
    p = psi[np.where(real, at, 0)]
    whole = np.broadcast_to(np.eye(labels, dtype=np.float32), (len(text), labels, labels)).copy()
    for k in range(BLOCK):
        moved = (whole @ step) * p[:, k, None, :]
        moved /= moved.sum((1, 2), keepdims=True)
        whole = np.where(real[:, k, None, None], moved, whole)
    inward, outward = np.empty((len(text), labels), np.float32), np.empty((len(text), labels), np.float32)
    by_turn = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2))
    state = np.full((len(size), labels), 1 / labels, np.float32)
    for k in range(turn.max() + 1):
        b = by_turn[cuts[k] : cuts[k + 1]]
        inward[b] = state[text[b]]
        moved = np.einsum("bi,bij->bj", inward[b], whole[b])
        state[text[b]] = moved / moved.sum(1, keepdims=True)
    state[:] = 1 / labels
    for k in range(turn.max(), -1, -1):
        b = by_turn[cuts[k] : cuts[k + 1]]
        outward[b] = state[text[b]]
        moved = np.einsum("bij,bj->bi", whole[b], outward[b])
        state[text[b]] = moved / moved.sum(1, keepdims=True)
    forward = np.empty((BLOCK, len(text), labels), np.float32)
    for k in range(BLOCK):
        moved = (inward @ step) * p[:, k]
        moved /= moved.sum(1, keepdims=True)
        inward = np.where(real[:, k, None], moved, inward)
        forward[k] = inward
    out = np.empty_like(psi)
    for k in range(BLOCK - 1, -1, -1):
        both = forward[k] * outward
        both /= both.sum(1, keepdims=True)
        out[at[real[:, k], k]] = both[real[:, k]]
        moved = (outward * p[:, k]) @ step.T
        moved /= moved.sum(1, keepdims=True)
        outward = np.where(real[:, k, None], moved, outward)
    return out


def _lettered(w: Words) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTER[w.buf])])
    return seen[w.end] > seen[w.start]


def _fit(table: pa.Table, model: np.ndarray, evidence: np.ndarray, labels: int, epochs: int, chains: int = 128, rate: float = 0.2):
    """Stochastic gradient of the conditional log-likelihood over chains that join pieces of different texts."""
    emit = (1 << BITS) * labels
    y = np.asarray(table["label"])
    rng = np.random.default_rng(7)
    hashes, gold, parts, base = [], [], [], 0
    pieces = []
    for w in words_of(table["text"].combine_chunks()):
        has = _lettered(w)
        own, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        parts += [(word + base, f) for word, f in word_features(w.buf, w.start[at], w.end[at], own, has[at])]
        offset = sum(map(len, hashes))
        hashes.append(back + base)
        gold.append(y[w.lo : w.hi][w.doc])
        base += len(own)
        for i in range(w.hi - w.lo):
            k = w.first[i]
            while k < w.first[i + 1]:
                n = min(int(rng.integers(8, 25)), int(w.first[i + 1] - k))
                pieces.append((offset + k, n))
                k += n
    if not pieces:
        return model, evidence
    word_of, gold = np.concatenate(hashes), np.concatenate(gold)
    pieces = np.array(pieces)[rng.permutation(len(pieces))]
    stream = np.repeat(pieces[:, 0] - np.cumsum(pieces[:, 1]) + pieces[:, 1], pieces[:, 1]) + np.arange(pieces[:, 1].sum())
    stream = stream[: max(len(stream) // CHAIN, 1) * CHAIN]
    length = min(CHAIN, len(stream))
    seqs = stream.reshape(-1, length)
    # features of each distinct word, one after another
    word = np.concatenate([p[0] for p in parts])
    order = np.argsort(word, kind="stable")
    feature = np.concatenate([p[1] for p in parts])[order]
    start = np.searchsorted(word[order], np.arange(base + 1))
    grown = evidence.copy() + 1e-6
    for _ in range(epochs):
        for k in range(0, len(seqs), chains):
            chosen = seqs[rng.permutation(len(seqs))[:chains]] if len(seqs) > chains else seqs
            b = len(chosen)
            own, back = np.unique(word_of[chosen.ravel()], return_inverse=True)
            n = start[own + 1] - start[own]
            take = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            f, of = feature[take], np.repeat(np.arange(len(own)), n)
            table_e, t = model[:emit].reshape(-1, labels), model[emit:].reshape(labels, labels)
            e = np.stack([np.bincount(of, table_e[f, c], len(own)) for c in range(labels)], 1)[back].reshape(b, length, labels)
            psi, step, g = np.exp(e - e.max(2, keepdims=True)), np.exp(t), gold[chosen]
            alpha, beta = np.empty_like(psi), np.empty_like(psi)
            a = np.full((b, labels), 1 / labels)
            for i in range(length):
                a = (a @ step) * psi[:, i]
                a /= a.sum(1, keepdims=True)
                alpha[:, i] = a
            c = np.ones((b, labels))
            for i in range(length - 1, -1, -1):
                beta[:, i] = c
                c = (c * psi[:, i]) @ step.T
                c /= c.sum(1, keepdims=True)
            post = alpha * beta
            post /= post.sum(2, keepdims=True)
            moves = np.einsum("bli,ij,blj->blij", alpha[:, :-1], step, psi[:, 1:] * beta[:, 1:])
            moves /= moves.sum((2, 3), keepdims=True)
            g_t = moves.sum((0, 1)) - np.bincount((g[:, :-1] * labels + g[:, 1:]).ravel(), minlength=labels * labels).reshape(labels, labels)
            miss = post.reshape(-1, labels).copy()
            miss[np.arange(len(miss)), g.ravel()] -= 1
            per_word = np.stack([np.bincount(back, miss[:, c], len(own)) for c in range(labels)], 1)
            seen, where = np.unique(f, return_inverse=True)
            g_e = np.stack([np.bincount(where, per_word[of, c], len(seen)) for c in range(labels)], 1)
            index = np.concatenate([(seen[:, None] * labels + np.arange(labels)).ravel(), emit + np.arange(labels * labels)])
            gradient = np.concatenate([g_e.ravel(), g_t.ravel()]) + 1e-4 * model[index]
            grown[index] += gradient**2
            model[index] -= rate * gradient / np.sqrt(grown[index])
    return model, grown


def train(rows: DataFrame, label: str, text: str, key: Column, most: int = 4000, rounds: int = 2, epochs: int = 1) -> tuple[list[str], np.ndarray]:
    """(languages, model) fitted on a sample of the rows that have a language and a text.

    The languages are those of all such rows. Each brings about ``most`` by the number of languages to the sample, or all its rows if
    it has fewer, so a rare one doesn't vanish. The model has a column for each language; their number bounds it.
    """
    chosen = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("name"), key.alias("key"))
    sizes = {r.name: r.n for r in chosen.groupBy("name").agg(F.count("*").alias("n")).collect()}  # one row a language
    names = sorted(sizes)
    if not names:
        return [], np.zeros(0, np.float32)
    index = F.array_position(F.array(*map(F.lit, names)), F.col("name")).cast("long") - 1
    shares = F.array(*(F.lit(min(1.0, most / len(names) / sizes[k])) for k in names))
    labelled = chosen.withColumn("label", index)
    sample = sharded(labelled, F.struct("key", "text"), F.element_at(shares, (F.col("label") + 1).cast("int"))).select("text", "shard", "order", "label")
    model, _ = fit_by_mixing(sample, lambda t, m, e: _fit(t, m, e, len(names), epochs), np.zeros((1 << BITS) * len(names) + len(names) ** 2), rounds)
    return names, model


def predict(docs: DataFrame, names: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred, score and n_switches.

    ``lang_pred`` is the language with the largest mean marginal over the words that have letters (the first by name of equal ones),
    ``score`` that mean, and ``n_switches`` how often the likeliest label changes between such words. A text that is null or has no
    letter is ``und``, with score 0; so is every text if no language could be learned. A text of any length is labelled whole, with
    some hundred bytes a word at a time. Repeated rows are kept. Columns that already have one of the three names are replaced, other
    columns stay as they are. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    labels = len(names)
    kinds = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("n_switches", pa.int64())])

    def over(batch: pa.RecordBatch) -> pa.Array:
        texts = rows_of(batch, "text")
        has = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best, score, switches = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if labels:
            table, step = held.value[: (1 << BITS) * labels].reshape(-1, labels), held.value[(1 << BITS) * labels :].reshape(labels, labels)
            for w in words_of(texts):
                lettered = _lettered(w)
                own, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
                e = _emissions(table, word_features(w.buf, w.start[at], w.end[at], own, lettered[at]), len(own))[back]
                post = marginals(e, w.first, step)
                n = np.maximum(np.bincount(w.doc, lettered, w.hi - w.lo), 1)
                mean = np.stack([np.bincount(w.doc, post[:, c] * lettered, w.hi - w.lo) for c in range(labels)], 1) / n[:, None]
                best[w.lo : w.hi], score[w.lo : w.hi] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
                top, doc = post.argmax(1)[lettered], w.doc[lettered]
                switches[w.lo : w.hi] = np.bincount(doc[1:][(top[1:] != top[:-1]) & (doc[1:] == doc[:-1])], minlength=w.hi - w.lo)
        else:
            has = np.zeros(len(texts), bool)
        named = pa.array(np.array([*names, "und"], object)[np.where(has, best, labels)], pa.string())
        return pa.StructArray.from_arrays([named, pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, switches, 0))], fields=list(kinds))

    made = column_of(docs.sparkSession, over, "lang_pred string, score double, n_switches long", text=F.col(text).cast("string"))
    held_as = free_name(docs, "found")
    return docs.withColumn(held_as, made).withColumns({c: F.col(held_as)[c] for c in ("lang_pred", "score", "n_switches")}).drop(held_as)
