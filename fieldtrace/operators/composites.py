"""Composite operators as plans of joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fingerprint_locate(heard: DataFrame, epochs: DataFrame, epoch_keys: list[str], sigma: float = 6.0, penalty: float = 2.0, common: int = 3, best: int = 7) -> DataFrame:
    """(scan, lat, lon, n): the place of a scan from the ``best`` epochs that share ``common`` transmitters at least.

    ``heard`` has scan, bssid, dbm; ``epochs`` the keys, bssid, dbm, lat and lon. An epoch's score is the negative half of its mean squared
    difference by ``sigma``, less ``penalty`` for the share of the scan that it misses, plus half the log of what is shared.
    """
    size = heard.groupBy("scan").agg(F.count("*").alias("all"))
    other = epochs.select(*epoch_keys, "bssid", F.col("dbm").alias("e_dbm"), "lat", "lon")
    d = F.col("dbm") - F.col("e_dbm")
    met = heard.join(other, "bssid").groupBy("scan", *epoch_keys).agg(F.count("*").alias("n"), F.sum(d * d).alias("ss"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).where(F.col("n") >= common)
    score = -0.5 * F.col("ss") / (sigma * sigma * F.col("n")) - penalty * (F.col("all") - F.col("n")) / F.col("all") + 0.5 * F.log("n")
    ranked = met.join(size, "scan").withColumn("score", score)
    x = F.row_number().over(Window.partitionBy("scan").orderBy(F.floor(F.col("score") * 1e9).desc(), *epoch_keys))
    top = ranked.withColumn("x", x).where(F.col("x") <= best)
    w = F.exp("score")
    return top.groupBy("scan").agg((F.sum(w * F.col("lat")) / F.sum(w)).alias("lat"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("lon"), F.count("*").alias("n"))


def device_offsets(observations: DataFrame, host: str, least: int = 3) -> DataFrame:
    """(device, n, offset) against the host, over the transmitters that both hear."""
    mid = observations.groupBy("bssid", "device").agg(F.median("dbm").alias("mid"))
    own = mid.where(F.col("device") == host).select("bssid", F.col("mid").alias("host_mid"))
    both = mid.where(F.col("device") != host).join(own, "bssid")
    return both.groupBy("device").agg(F.count("*").alias("n"), F.median(F.col("mid") - F.col("host_mid")).alias("offset")).where(F.col("n") >= least)


def signatures(rows: DataFrame, key: str, prefix: Column, prefixes: DataFrame, patterns: list[tuple[str, int, Column]]) -> DataFrame:
    """(key, tier, rule, n_rules) of the rows that meet a rule: the highest tier, then the rule's name."""
    own = rows.withColumn("__prefix", prefix)
    by_prefix = own.join(prefixes, F.col("__prefix") == F.col("prefix")).select(key, F.col("tier").cast("int").alias("tier"), F.lit("prefix").alias("rule"))
    listed = F.filter(F.array(*(F.when(ok, F.struct(F.lit(tier).alias("tier"), F.lit(name).alias("rule"))) for name, tier, ok in patterns)), lambda x: x.isNotNull())
    by_pattern = rows.select(key, F.inline(listed))
    return by_prefix.union(by_pattern).groupBy(key).agg(F.max(F.struct("tier", "rule")).alias("b"), F.count("*").alias("n_rules")).select(key, "b.tier", "b.rule", "n_rules")


def path_loss_fit(rows: DataFrame, keys: list[str], p0: float, exponent: float, weight: float) -> DataFrame:
    """(keys, p0, exponent) of level y against log10 range x, with a prior worth ``weight`` samples on both, by the normal equations."""
    x, y = F.col("x"), F.col("y")
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    n, sy = F.col("n") + weight, F.col("sy") + weight * p0
    slope = (F.col("sxy") - F.col("sx") * sy / n + weight * -10 * exponent) / (F.col("sxx") - F.col("sx") * F.col("sx") / n + weight)
    return s.withColumn("b", slope).select(*keys, ((sy - F.col("b") * F.col("sx")) / n).alias("p0"), (-F.col("b") / 10).alias("exponent"))


def proximity(observations: DataFrame) -> DataFrame:
    """(a, b, shared, gain, rest) of every pair of devices: the median difference of levels and the median of what is left of it."""
    mid = observations.groupBy("device", "bssid").agg(F.median("dbm").alias("mid"))
    a, b = mid.select("bssid", F.col("device").alias("a"), F.col("mid").alias("ma")), mid.select("bssid", F.col("device").alias("b"), F.col("mid").alias("mb"))
    pairs = a.join(b, "bssid").where("a < b").withColumn("d", F.col("ma") - F.col("mb"))
    gain = pairs.groupBy("a", "b").agg(F.median("d").alias("gain"), F.count("*").alias("shared"))
    return pairs.join(gain, ["a", "b"]).groupBy("a", "b", "shared", "gain").agg(F.median(F.abs(F.col("d") - F.col("gain"))).alias("rest"))


def densest_window(rows: DataFrame, keys: list[str], x: str, width: float) -> DataFrame:
    """(keys, low, n, center): the window of ``width`` with most values, the lowest of equals, and the median of its values."""
    by = ", ".join(f"`{k}`" for k in keys)
    counted = rows.select(*keys, x).withColumn("n", F.expr(f"count(*) over (partition by {by} order by `{x}` range between current row and {float(width)}D following)"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(x).alias("low"))).alias("b")).select(*keys, "b.low")
    inside = rows.select(*keys, x).join(best, keys).where((F.col(x) >= F.col("low")) & (F.col(x) <= F.col("low") + width))
    return inside.groupBy(*keys, "low").agg(F.count("*").alias("n"), F.median(x).alias("center"))
