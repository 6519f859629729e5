"""Robust and directional aggregates as expressions over groups, and those that need an order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upper_median(x: str) -> Column:
    """The upper of the two middle values of an expression, as a double. Counts of equal values are combined before the shuffle."""
    return -F.expr(f"percentile_disc(0.5) within group (order by -({x}))")


def rank_percentile(x: str, share: float, low: float, high: float, least: int, default: float) -> Column:
    """The value at rank ceil(share * n) of an expression, held between bounds; ``default`` for fewer than ``least`` values."""
    value = F.expr(f"percentile_disc({share}) within group (order by {x})")
    return F.when(F.count(F.expr(x)) < least, F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def deviation(rows: DataFrame, keys: list[str], x: str, scale: float = 1.4826) -> DataFrame:
    """(keys, median, mad): the scaled median of distances from the median, as two aggregates."""
    mid = rows.groupBy(*keys).agg(F.median(x).alias("median"))
    off = rows.join(mid, keys).groupBy(*keys, "median").agg((F.median(F.abs(F.col(x) - F.col("median"))) * scale).alias("mad"))
    return off


def power_mean(rows: DataFrame, keys: list[str], dbm: str, least: int = 8, cap: float = 0.95) -> DataFrame:
    """(keys, level, n): the level of the mean power; from ``least`` values on, power above the 95 % point is cut down to it."""
    power = rows.select(*keys, F.pow(F.lit(10.0), F.col(dbm) / 10).alias("p"))
    top = power.groupBy(*keys).agg(F.percentile("p", cap).alias("top"), F.count("*").alias("n"))
    cut = power.join(top, keys).withColumn("p", F.when(F.col("n") >= least, F.least("p", "top")).otherwise(F.col("p")))
    share = F.when(F.col("n") >= least, cap).otherwise(1.0)
    return cut.groupBy(*keys, "n").agg(F.avg("p").alias("m")).select(*keys, (10 * F.log10(F.col("m") / share)).alias("level"), "n")


def weighted_centroid(weight: Column, lat: Column, lon: Column) -> Column:
    w = F.sum(weight)
    return F.struct((F.sum(weight * lat) / w).alias("lat"), (F.sum(weight * lon) / w).alias("lon"))


def kish(weight: Column) -> Column:
    """The effective number of weighted samples."""
    return F.sum(weight) * F.sum(weight) / F.sum(weight * weight)


def geometric_score(score: Column, weight: Column) -> Column:
    return F.exp(F.sum(weight * F.log(score)) / F.sum(weight))


def resultant(deg: Column) -> Column:
    """Length of the mean direction: 1 if all agree, 0 if they cancel."""
    c, s = F.avg(F.cos(F.radians(deg))), F.avg(F.sin(F.radians(deg)))
    return F.sqrt(c * c + s * s)


def largest_gap(rows: DataFrame, keys: list[str], deg: str) -> DataFrame:
    """(keys, gap): the widest arc without a bearing, around the circle."""
    w = Window.partitionBy(*keys).orderBy(deg)
    steps = rows.select(*keys, deg, (F.col(deg) - F.lag(deg).over(w)).alias("step"))
    ends = steps.groupBy(*keys).agg(F.max("step").alias("step"), F.min(deg).alias("low"), F.max(deg).alias("high"))
    return ends.select(*keys, F.greatest(F.coalesce("step", F.lit(0.0)), 360 - (F.col("high") - F.col("low"))).alias("gap"))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, rho): the correlation of average ranks."""

    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = rows.select(*keys, rank(x).alias("rx"), rank(y).alias("ry"))
    return ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"))


def allan_deviation(rows: DataFrame, keys: list[str], order: str, x: str, octaves: int) -> DataFrame:
    """(keys, m, deviation, n): of averages over 1, 2, 4, ... samples, from prefix sums and offsets by m and 2m."""
    w = Window.partitionBy(*keys).orderBy(order)
    sums = rows.select(*keys, F.row_number().over(w).alias("k"), F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    start = rows.select(*keys).distinct().select(*keys, F.lit(0).alias("k"), F.lit(0.0).alias("s"))
    sums = sums.union(start)
    steps = sums.withColumn("m", F.explode(F.array(*(F.lit(1 << j) for j in range(octaves)))))
    at = lambda n, name: steps.select(*keys, "m", (F.col("k") - n * F.col("m")).alias("k"), F.col("s").alias(name))
    three = at(0, "s0").join(at(1, "s1"), [*keys, "m", "k"]).join(at(2, "s2"), [*keys, "m", "k"])
    d = (F.col("s2") - 2 * F.col("s1") + F.col("s0")) / F.col("m")
    return three.groupBy(*keys, "m").agg(F.sqrt(F.sum(d * d) / (2 * F.count("*"))).alias("deviation"), F.count("*").alias("n"))


def correlation_time(rows: DataFrame, keys: list[str], order: str, x: str, window: float = 5.0, least: int = 16) -> DataFrame:
    """(keys, n, tau, converged): how many samples of a series hang together.

    1 + 2 times the sum of the autocorrelations up to the first lag of ``window`` times the sum so far. Series that are shorter than ``least`` or
    constant have no time. A key is one session, whose numbers (not its rows) are held at once.
    """
    kinds = dict(rows.dtypes)

    def over(table: pa.Table) -> pa.Table:
        v = table.sort_by(order)[x].to_numpy().astype(float)
        n, tau, done = len(v), None, False
        off = v - v.mean()
        var = float(off @ off) / n
        if n >= least and var > 1e-12:
            tau = 1.0
            for lag in range(1, n // 2):
                tau += 2 * float(off[:-lag] @ off[lag:]) / n / var
                if lag >= window * tau:
                    done = True
                    break
            tau = max(tau, 1.0)
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "n": pa.array([n], pa.int64()), "tau": pa.array([tau], pa.float64()), "converged": pa.array([done])})

    return rows.select(*keys, order, x).groupBy(*keys).applyInArrow(over, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, tau double, converged boolean")
