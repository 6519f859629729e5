"""What several operators of this subpackage share: cut lineage, components, labels, document tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without one (tests) gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later jobs neither recompute it nor depend on an executor.

    A ``narrow`` table has a few numbers a row: it goes to an eighth of the shuffle partitions at most, as many small files cost more
    than their rows.
    """
    shared_folder(df.sparkSession)
    if narrow:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or what comes of putting underscores before it until no column has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when its result is there. The session's own setting comes back afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Up to so many labels, a key and a number each, texts needn't be dealt out to meet them.
LABELS = 250_000


def if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A narrow table that has been written, hinted for a broadcast if it has no more than ``rows`` rows; beyond that, as it is."""
    return F.broadcast(df) if df.count() <= rows else df


#: What Arrow moves between the JVM and Python at once, unless the session sets it: few enough bytes that long texts don't meet.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of an Arrow batch where they have their defaults."""
    for key, (default, own) in ARROW_LIMITS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that take one batch and give record batches. Batches come in slices of a few MB."""
    small_batches(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from fn(batch)

    return df.mapInArrow(over, schema)


def column_of(spark: SparkSession, fn: Callable[[pa.RecordBatch], pa.Array], kind: str, **inputs: Column) -> Column:
    """A column that ``fn`` works out from ``inputs``, in slices of a few MB. Only the inputs go to Python; the other columns stay in the JVM."""
    small_batches(spark)
    names = list(inputs)

    def over(arrays: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in arrays:
            if not isinstance(columns, tuple):
                columns = (columns,)
            batch = pa.RecordBatch.from_arrays(list(columns), names=names)
            if batch.num_rows:
                yield pa.concat_arrays([fn(part) for part in slices([batch])])
            else:
                yield fn(batch)

    # one input comes as arrays, several as tuples of arrays: the annotation tells which
    over.__annotations__ = {"arrays": Iterator[pa.Array] if len(names) == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(over, kind)(*inputs.values())


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about ``most`` bytes, so that what is made of many long rows doesn't meet in memory."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the id, written as text, leaves ``rest``. A null id counts as the empty string."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus) == rest


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected graph; the component is its smallest node. ``edges`` is read once a round, so it should be written.

    Rounds of minimum labels with pointer jumping, one written table each. A label only ever becomes a smaller node of the same
    component, so the loop ends; the driver sees one number a round. Hub nodes are no problem: minima are combined before the shuffle.
    """
    one_way = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    both = one_way.union(one_way.select("v", "u"))
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), narrow=True)
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("seen"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        # what the nodes of a label have seen, and the label's own node, goes to all nodes of the label, which moves whole trees at once
        told = hooked.select(F.col("label").alias("of"), "low").union(hooked.select("node", "low")).groupBy("of").agg(F.min("low").alias("told"))
        moved = cut(hooked.join(told, F.col("label") == F.col("of")).select("node", "label", F.least("low", "told").alias("new")), narrow=True)
        if moved.where("new < label").limit(1).count() == 0:
            return moved.select("node", F.col("new").alias("component"))
        labels = moved.select("node", F.col("new").alias("label"))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
