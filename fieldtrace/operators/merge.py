"""Merge-style writers: what a table becomes when new rows meet it. All are joins and windows; the caller writes the result."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine
from .graph import cut
from .joins import _grid, grid_join
from .windows import gap_runs, over_groups


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """All rows of both; ``rules`` give the merged value of a column from ``old.<c>`` and ``new.<c>``, other columns take the new value if there is one."""
    a, b = old.alias("old"), new.alias("new")
    both = a.join(b, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full")
    merged = [F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in keys]
    merged += [rules.get(c, F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).alias(c) for c in old.columns if c not in keys]
    return both.select(merged)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` and the new rows whose keys it lacks, the first by ``order`` of those with equal keys."""
    return old.unionByName(first_per_key(new, keys, order).join(old, keys, "left_anti").select(old.columns))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return last_n(rows, keys, order, 1)


def last_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def three_way(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status): added, updated, unchanged, or missing from the new list."""
    a, b = old.select(key, F.struct(*columns).alias("__a"), F.lit(True).alias("__o")), new.select(key, F.struct(*columns).alias("__b"), F.lit(True).alias("__n"))
    status = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "missing").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("updated")
    return a.join(b, key, "full").select(key, status.alias("status"))


def reconcile(old: DataFrame, new: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """(key, action) for rows that the new list lacks: stale if something refers to them, else delete."""
    gone = old.select(key).join(new.select(key), key, "left_anti")
    return gone.join(used.select(key).distinct().withColumn("__used", F.lit(True)), key, "left").select(key, F.when(F.col("__used"), "stale").otherwise("delete").alias("action"))


def newest_writer(rows: DataFrame, key: str, stamp: str, ours: str) -> DataFrame:
    """One row per key: the newest stamp; of equal stamps our own. Tombstones are rows like others."""
    return first_per_key(rows, [key], [F.desc(stamp), F.desc(ours)])


def bounded_queue(rows: DataFrame, order: str, size: str, most: int, keep: Column) -> DataFrame:
    """The newest rows that fit into ``most`` bytes together; those with ``keep`` stay in any case and count first.

    The running sum is taken over days first, and inside one day only where the border falls, so no single task sorts all rows.
    """
    day = F.floor(F.col(order) / 86_400_000)
    tagged = rows.withColumns({"__day": day, "__keep": keep})
    held = F.coalesce(F.sum(F.when(F.col("__keep"), F.col(size))), F.lit(0)).alias("held")
    budget = tagged.agg(held)
    by_day = tagged.where(~F.col("__keep")).groupBy("__day").agg(F.sum(size).alias("bytes"))
    after = by_day.select("__day", (F.sum("bytes").over(Window.orderBy(F.desc("__day"))) - F.col("bytes")).alias("later"))
    inside = F.sum(size).over(Window.partitionBy("__day").orderBy(F.desc(order), *[F.desc(c) for c in rows.columns if c != order]))
    loose = tagged.where(~F.col("__keep")).withColumn("__inside", inside).join(F.broadcast(after), "__day").crossJoin(F.broadcast(budget))
    fits = loose.where(F.col("held") + F.col("later") + F.col("__inside") <= most)
    return tagged.where("__keep").select(rows.columns).union(fits.select(rows.columns))


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Adds running numbers from 0 in the order of ``key``: inside ranges of the key, after the sizes of the ranges before."""
    dealt = cut(rows.repartitionByRange(F.col(key)).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__size"))  # one row a range
    before = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return dealt.withColumn("__own", own).join(before, "__range").withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__range", "__own", "__before")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str], seq: str, next_seq: int) -> DataFrame:
    """New values for the rows of ``old``; a row gets the next sequence number only if a value changes (null-safe).

    Only the keys of rows that change are ordered and numbered.
    """
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    both = old.join(n, key, "left")
    differs = F.col("__hit").isNotNull() & ~F.struct(*columns).eqNullSafe(F.struct(*(F.col(f"__{c}").alias(c) for c in columns)))
    both = both.withColumn("__differs", differs)
    both = both.join(numbered(both.where("__differs").select(key), key, "__number"), key, "left")
    values = {c: F.when(F.col("__differs"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return both.withColumns({seq: F.when(F.col("__differs"), F.lit(next_seq) + F.col("__number")).otherwise(F.col(seq)), **values}).select(old.columns)


def changed_in_place(rows: DataFrame, key: str, values: dict[str, Column], seq: str, next_seq: int) -> DataFrame:
    """``changed`` where each row's new ``values`` are worked out from the row itself: no row is looked up, only the keys of changed rows are ordered and numbered.

    Rows that don't change never leave their place. ``key`` may repeat; each changed row has a number of its own.
    """
    names = list(values)
    both = rows.withColumns({f"__{c}": v for c, v in values.items()})
    differs = ~F.struct(*names).eqNullSafe(F.struct(*(F.col(f"__{c}").alias(c) for c in names)))
    moved = numbered(both.where(differs), key, "__number")
    new = {c: F.col(f"__{c}") for c in names} | {seq: F.lit(next_seq) + F.col("__number")}
    return both.where(~differs).select(rows.columns).union(moved.withColumns(new).select(rows.columns))


def closed_aliases(aliases: DataFrame) -> DataFrame:
    """(uid, target) with every target followed to its end. Each round doubles how far a uid sees; a circle of aliases keeps one of its uids."""
    now = aliases.where("uid <> target").groupBy("uid").agg(F.min("target").alias("target"))
    while True:
        step = now.select(F.col("uid").alias("target"), F.col("target").alias("__next"))
        after = cut(now.join(step, "target", "left").select("uid", "target", F.coalesce("__next", "target").alias("__far")))
        if not after.where("__far <> target and __far <> uid").limit(1).count():
            return after.select("uid", "target")
        now = after.where("__far <> uid").select("uid", F.col("__far").alias("target"))


def _better(source_rank: str, confidence: str) -> Column:
    return F.struct(F.col(source_rank), F.col(confidence))


def merge_events(old: DataFrame, new: DataFrame, aliases: DataFrame, within_ms: int = 600_000) -> tuple[DataFrame, DataFrame]:
    """(events, aliases) after new events (uid, camera_id, t_ms, source_rank, confidence, note) have come in one by one, in the order of time and uid.

    An event first goes to the event of its uid, by way of ``aliases`` (uid, target). Else it goes to that of its camera that is nearest in time, at most ``within_ms`` away (the earlier, then
    the smaller uid, of two as near), whether that was there before or came just now; else it is added. Where two meet, a better one, by rank of source and
    then confidence, gives time, rank and confidence; a note is kept where there is one. A uid that was merged away becomes an alias.

    Events with a known uid are merged before the others. Only rows of a camera between gaps of more than ``within_ms`` can meet, so each such run is merged by itself, and
    only runs of several rows with a new one are; a run's rows are a few numbers each.
    """
    names = ["uid", "camera_id", "t_ms", "source_rank", "confidence", "note"]
    known = new.select(names).join(closed_aliases(aliases), "uid", "left").withColumn("to", F.coalesce("target", "uid"))
    same = known.join(old.select(F.col("uid").alias("to"), F.lit(True).alias("__same")), "to", "left")
    # events of a known uid: the best of all gives the numbers, the old one of equal ones, then the earlier
    meet = old.select(F.col("uid").alias("to"), *names, F.lit(1).alias("__old")).unionByName(same.where("__same").select("to", *names).withColumn("__old", F.lit(0)))
    w = Window.partitionBy("to").orderBy(F.desc(_better("source_rank", "confidence")), F.desc("__old"), "t_ms", "uid")
    earlier = Window.partitionBy("to").orderBy(F.desc("__old"), "t_ms", "uid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = meet.withColumns({"__r": F.row_number().over(w), "note": F.first("note", ignorenulls=True).over(earlier), "camera_id": F.first("camera_id").over(earlier)}).where("__r = 1")
    rows = best.select(F.col("to").alias("uid"), *names[1:], F.lit(True).alias("old"))
    free = same.where("__same is null").select(*names, F.lit(False).alias("old"))
    every = gap_runs(rows.unionByName(free), ["camera_id"], "t_ms", within_ms, "__run", tie="uid")
    run = Window.partitionBy("camera_id", "__run")
    every = cut(every.withColumn("__fold", (F.count("*").over(run) > 1) & F.bool_or(~F.col("old")).over(run)))
    kinds = dict(every.dtypes)

    def merged(rows: list[dict]) -> list[dict]:
        there = [r for r in rows if r["old"]]
        gone = []
        for e in sorted((r for r in rows if not r["old"]), key=lambda r: (r["t_ms"], r["uid"], -r["source_rank"], -r["confidence"], r["note"] or "")):
            same_uid = next((r for r in there if r["uid"] == e["uid"]), None)
            near = [r for r in there if abs(r["t_ms"] - e["t_ms"]) <= within_ms]
            to = same_uid or min(near, key=lambda r: (abs(r["t_ms"] - e["t_ms"]), r["t_ms"], r["uid"]), default=None)
            if to is None:
                there.append(e)
                continue
            if (e["source_rank"], e["confidence"]) > (to["source_rank"], to["confidence"]):
                to |= {c: e[c] for c in ("t_ms", "source_rank", "confidence")}
            to["note"] = to["note"] if to["note"] is not None else e["note"]
            if to["uid"] != e["uid"]:
                gone.append({**e, "target": to["uid"]})
        return [{**r, "target": None} for r in there] + gone

    def over(table: pa.Table, cuts: list[int]) -> pa.Table:
        rows = table.to_pylist()
        made = [r for a, b in zip(cuts, cuts[1:], strict=False) for r in merged(rows[a:b])]
        return pa.Table.from_pylist([{c: r[c] for c in (*names, "target")} for r in made], schema=pa.schema([*(table.schema.field(c) for c in names), pa.field("target", table.schema.field("uid").type)]))

    folded = cut(over_groups(every.where("__fold").drop("__fold"), ["camera_id", "__run"], ["t_ms", "uid"], over, ", ".join(f"{c} {kinds[c]}" for c in names) + f", target {kinds['uid']}"))
    kept = every.where("not __fold").select(names).unionByName(folded.where("target is null").select(names))
    gone = folded.where("target is not null").select("uid", "target").unionByName(same.where("__same and uid <> to").select("uid", F.col("to").alias("target")))
    return kept, aliases.select("uid", "target").unionByName(gone).dropDuplicates(["uid"])


def one_of_each_place(rows: DataFrame, metres: float) -> DataFrame:
    """Rows (id, key, lat, lon, score, phone) that have no better one of the same key within ``metres``: by score, then the smaller id.

    A row that stays without a phone takes the least phone of those near it. Rows of a key meet by grid cells, not all with all: first each with the best of its own cell, which
    leaves few, and only those with all around them.
    """
    of_points, _ = _grid(metres * 0.7, 1_000_000, "lat", "lon")
    dealt = of_points(rows)
    first = dealt.where("score is not null").groupBy("key", "__y", "__x").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "lat", "lon")).alias("__b"))
    b = F.col("__b")
    ahead = (-b["s"] > F.col("score")) | ((-b["s"] == F.col("score")) & (b["id"] < F.col("id")))
    close = haversine(F.col("lat"), F.col("lon"), b["lat"], b["lon"]) <= metres
    every, rows = rows, cut(dealt.join(first, ["key", "__y", "__x"], "left").where(~F.coalesce(ahead & close, F.lit(False))).select(rows.columns))
    others = every.select(F.col("id").alias("o_id"), "key", F.col("score").alias("o_score"), F.col("phone").alias("o_phone"), "lat", "lon")
    near = grid_join(rows.select("id", "key", "score", "lat", "lon"), others, metres, on=("key",)).where("id <> o_id")
    better = (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("o_id") < F.col("id")))
    seen = near.groupBy("id").agg(F.bool_or(better).alias("__beaten"), F.min("o_phone").alias("__phone"))
    return rows.join(seen, "id", "left").where("not coalesce(__beaten, false)").withColumn("phone", F.coalesce("phone", "__phone")).select(rows.columns)


def resolved(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """``key`` replaced by what it was merged into."""
    a = aliases.select(F.col("uid").alias(key), "target")
    return rows.join(a, key, "left").withColumn(key, F.coalesce("target", key)).select(rows.columns)
