"""Near-duplicate documents by MinHash with tensored banding, each link verified on the full shingle sets.

A document's set is its distinct ``shingle``-word shingles (see ``bytetext.shingle_sets``). Two collections of ``codes`` hash
codes, each over ``rows`` minhashes, stand for a table each for every pair (one code of the first, one of the second). So
``codes**2`` tables of ``2 * rows`` minhashes cost ``2 * codes * rows`` minhashes, about the square root of what independent
tables take. With 2 x 12 codes of two rows, a pair at the threshold of 0.75 shares no table with probability 1e-4, one at 0.8 with 5e-6.

Steps:
 1. One pass gives each row its set size, a 128-bit hash of the set and its codes. Equal sets form a class; one stands for all.
 2. Codes that one class alone has cannot meet another, and are dropped before any table key is formed.
 3. Table keys are the pairs of what is left. Every class is verified against the smallest id of the bucket that it shares
    most keys with: one pair a class, whatever the buckets' sizes. Verified pairs give first components.
 4. Only pairs in different components remain of interest. A pair that shares a key is verified if it can still reach the
    threshold: by set sizes, by the shingles that no other component has (both bounds are exact), and by a 512-bit sketch
    with a margin of 4.5 standard deviations.
No bucket is capped and no pair is dropped but by these bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import mix, rows_of, shingle_sets
from .common import components, cut, map_arrow

SKETCH_WORDS = 8


def _hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhashes(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of a non-empty set for each function of the family; a few thousand shingles at a time."""
    odd, flip = family
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[k : k + 2048, None] ^ flip) * odd).min(0), out=low)
    return low >> np.uint64(24)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, codes: int, rows: int, carry: Column | None = None) -> DataFrame:
    """(node, carried, n_shingles, set_a, set_b, codes) of every row; ``codes`` is null for an empty set. The id keeps its type."""
    family = _hash_family(2 * codes * rows, 1)
    salt = mix(np.arange(1, 2 * codes + 1).astype(np.uint64))

    def over(batch: pa.RecordBatch):
        size, first, second, made = [], [], [], []
        for _, s in shingle_sets(rows_of(batch, "text"), shingle):
            size.append(len(s))
            if len(s):
                low = minhashes(s, family).reshape(2 * codes, rows)
                code = salt.copy()
                for k in range(rows):
                    code = mix(code + low[:, k])
                made.append(code.view(np.int64))
                first.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
            else:
                made.append(None)
                first.append(0)
                second.append(0)
        arrays = [rows_of(batch, "node"), rows_of(batch, "carried"), *(pa.array(x, pa.int64()) for x in (size, first, second)), pa.array(made, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "carried", "n_shingles", "set_a", "set_b", "codes"])

    carried = F.lit(None).cast("long") if carry is None else carry
    rows_in = docs.select(F.col(id_col).alias("node"), carried.alias("carried"), F.col(text_col).cast("string").alias("text"))
    kinds = dict(rows_in.dtypes)
    return map_arrow(rows_in, over, f"node {kinds['node']}, carried {kinds['carried']}, n_shingles long, set_a long, set_b long, codes array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, n, set, bits) with the whole set and a sketch of one bit for each of 512 further minhashes."""
    family = _hash_family(64 * SKETCH_WORDS, 2)
    names = ["node", "n", "set", *(f"b{k}" for k in range(SKETCH_WORDS))]

    def over(batch: pa.RecordBatch):
        sets, bits = [], []
        for _, s in shingle_sets(rows_of(batch, "text"), shingle):
            sets.append(s.view(np.int64))
            one = (minhashes(s, family) & np.uint64(1)).astype(np.uint8) if len(s) else np.zeros(64 * SKETCH_WORDS, np.uint8)
            bits.append(np.packbits(one).view(np.int64))
        bits = np.array(bits, np.int64).reshape(-1, SKETCH_WORDS)
        yield pa.RecordBatch.from_arrays([rows_of(batch, "node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64())), *(pa.array(bits[:, k].copy()) for k in range(SKETCH_WORDS))], names=names)

    return map_arrow(docs, over, f"node {dict(docs.dtypes)['node']}, n long, set array<long>, " + ", ".join(f"b{k} long" for k in range(SKETCH_WORDS)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, most: int = 500) -> DataFrame:
    """The pairs (src, dst) whose sets satisfy 100 * intersection >= percent * union.

    The set of a ``src`` that has more than ``most`` pairs is copied, one copy for each ``most`` of them, and its pairs are dealt to
    the copies, so that the centre of a large group isn't one key of the join.
    """
    fans = pairs.groupBy("src").agg(F.count("*").alias("many")).where(F.col("many") > most).select("src", F.ceil(F.col("many") / most).cast("int").alias("fan"))
    turn = F.pmod(F.xxhash64("dst"), F.coalesce("fan", F.lit(1))).cast("int")
    dealt = pairs.join(fans, "src", "left").select("src", "dst", turn.alias("turn"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1))
    left = sets.select(F.col("node").alias("src"), F.col("set").alias("set_s")).join(fans, "src", "left").select("src", "set_s", copies.alias("turn"))
    right = sets.select(F.col("node").alias("dst"), F.col("set").alias("set_d"))
    both = dealt.join(left.hint("merge"), ["src", "turn"]).join(right.hint("merge"), "dst")
    shared = F.size(F.array_intersect("set_s", "set_d")).cast("long")
    union = F.size("set_s") + F.size("set_d") - shared
    return both.where(100 * shared >= percent * union).select("src", "dst")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = 5, codes: int = 12, rows: int = 2, carry: Column | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Null and word-less texts have an empty set and link with nothing; their component is their id. Equal sets are in one
    component. Ids may be of any type that has an order and need not be unique: each row is judged by its own text, but classes of
    equal sets whose smallest id is the same count as one. A row with a null id takes the component of the rows of its set, or null
    (kept) if none of them has an id. A text of any length is taken whole, its set as one array. An empty table gives an empty
    result. Other columns are ignored, whatever their names; the value of ``carry`` comes out as the column ``carried``.
    """
    rows_sig = cut(signatures(docs, id_col, text_col, shingle, codes, rows, carry))
    same = ["n_shingles", "set_a", "set_b"]
    some = rows_sig.where("n_shingles > 0 and node is not null")
    classes = cut(some.groupBy(*same).agg(F.min("node").alias("node"), F.first("codes").alias("codes")))

    # step 2: codes that at least two classes have
    coded = classes.select("node", F.posexplode("codes").alias("pos", "code"))
    shared = coded.groupBy("code").agg(F.count("*").alias("many")).where("many > 1").select("code")
    alive = coded.join(shared.hint("merge"), "code", "left_semi")
    halves = cut(
        alive.groupBy("node")
        .agg(F.collect_list(F.when(F.col("pos") < codes, F.col("code"))).alias("a"), F.collect_list(F.when(F.col("pos") >= codes, F.col("code"))).alias("b"))
        .where((F.size("a") > 0) & (F.size("b") > 0))
    )

    # step 3: table keys, and one verified pair for each class
    keys = halves.select("node", F.explode("a").alias("code"), "b").select("node", F.explode(F.transform("b", lambda y: F.xxhash64("code", y))).alias("key"))
    least = cut(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low"), narrow=True)
    led = keys.join(least.hint("merge"), "key").where("node <> low")
    leads = cut(
        led.groupBy("node", "low").agg(F.count("*").alias("times"))
        .groupBy("node").agg(F.min_by("low", F.struct(-F.col("times"), "low")).alias("low")),
        narrow=True,
    )
    stars = leads.select(F.col("node").alias("dst"), F.col("low").alias("src"))
    # all that share a table: a class that is the least of its buckets has no lead, and needn't be anyone's
    wanted = leads.select("node").union(least.select("low")).distinct()
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    sets = cut(full_sets(texts.join(wanted, "node", "left_semi"), shingle).where("n > 0"))
    links = cut(_verified(stars, sets, percent), narrow=True)
    first = components(links)

    # step 4: pairs of different components that share a table and can still reach the threshold
    member = halves.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = member.join(sets, "node")
    own = (
        facts.select("node", "component", F.explode("set").alias("shingle"))
        .groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low = high").select("shingle")
    )
    alone = facts.select("node", F.explode("set").alias("shingle")).join(own.hint("merge"), "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("own"))
    able = cut(
        # a class whose own shingles leave too few for the threshold, whatever it meets, is linked to no other component
        facts.drop("set").join(alone, "node", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).where(100 * F.col("most") >= percent * F.col("n"))
    )
    more = _verified(cut(_cross_pairs(able, percent), narrow=True), sets, percent)
    # components that these links join: a graph whose nodes are the first components
    of = lambda end: first.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    ends = more.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(*(F.coalesce(f"{end}_component", end).alias(end) for end in ("src", "dst")))
    joined = components(cut(ends.distinct(), narrow=True)).select(F.col("node").alias("part"), F.col("component").alias("whole"))

    member = classes.select(*same, "node").join(first, "node", "left").select(*same, F.coalesce("component", "node").alias("part"))
    class_of = member.join(joined, "part", "left").select(*same, F.coalesce("whole", "part").alias("class_component"))
    result = rows_sig.drop("codes", *["carried"] * (carry is None)).join(class_of.hint("merge"), same, "left").withColumn("component_id", F.coalesce("class_component", "node"))
    kept = F.coalesce(F.col("node") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    return result.select(F.col("node").alias(id_col), "n_shingles", "component_id", kept, *["carried"] * (carry is not None))


def _reach(shared: Column, n_x: Column, n_y: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n_x + n_y - shared)


def _mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys under which rows of different components meet, and how many rows each has."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high"))
    return found.where("low < high").select(*keys, "many")


def _buckets(able: DataFrame, most: int) -> DataFrame:
    """(node, code, second): the buckets in which a class can meet one of another component.

    A bucket is a code of the first half (``second`` is 0), or, where more than ``most`` classes have it, a pair of a code of either half, which is a
    table key. A bucket within one component, as those of a large group of copies are, is dropped before any set or sketch is joined to it.
    """
    coded = able.select("node", "component", "b", F.explode("a").alias("code"))
    codes = cut(_mixed(coded, ["code"]), narrow=True)
    rows = coded.join(codes.hint("merge"), "code")
    few = rows.where(F.col("many") <= most).select("node", "code", F.lit(0).cast("long").alias("second"))
    split = rows.where(F.col("many") > most).select("node", "component", "code", F.explode("b").alias("second"))
    pairs = _mixed(split, ["code", "second"]).drop("many")
    return cut(few.union(split.join(pairs.hint("merge"), ["code", "second"], "left_semi").select("node", "code", "second")))


def _cross_pairs(able: DataFrame, percent: int, most: int = 200) -> DataFrame:
    """Distinct pairs (src < dst) of different components with a common table and no bound against the threshold.

    A common table is a common code in each half. One half's codes are the join key and the other half is a condition, but for a split
    bucket, whose key has both. A pair is taken at its least common codes only. Code, size and sketch bounds are part of the join condition.
    """
    keyed = _buckets(able, most).join(able.hint("merge"), "node")
    side = lambda p: keyed.select(*(F.col(c).alias(f"{p}_{c}") for c in able.columns), "code", "second")
    left, right = side("x"), side("y")
    shared = F.least("x_most", "y_most")
    differ = sum((F.bit_count(F.col(f"x_b{k}").bitwiseXOR(F.col(f"y_b{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    n = 64 * SKETCH_WORDS
    p = (1 - percent / 100) / 2
    limit = n * p + 4.5 * (n * p * (1 - p)) ** 0.5
    first_of = lambda half: F.array_min(F.array_intersect(f"x_{half}", f"y_{half}"))
    on = (
        (F.col("x_node") < F.col("y_node"))
        & (F.col("x_component") != F.col("y_component"))
        & _reach(shared, F.col("x_n"), F.col("y_n"), percent)
        & (differ <= limit)
        & F.when(left["second"] != 0, first_of("b") == left["second"]).otherwise(F.arrays_overlap("x_b", "y_b"))
    )
    joined = left.join(right.hint("merge"), (left["code"] == right["code"]) & (left["second"] == right["second"]) & on)
    # a code under which two components meet is kept for both, so the least common code of a pair is always among those that are joined
    return joined.where(first_of("a") == left["code"]).select(F.col("x_node").alias("src"), F.col("y_node").alias("dst"))
