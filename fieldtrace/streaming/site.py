"""Whether a device is at a surveyed site, from the neighbourhood that it hears there: learned and judged scan by scan."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .tracking import with_state_store

#: Scans after which the neighbourhood is known, the least level that counts, and how many neighbours are kept.
LEARNED, LEAST_DBM, NEIGHBOURS, NEWEST = 5, -85.0, 400, 30
#: To be on site: neighbours expected and heard, their share, and the root mean square of levels in dB; to leave: scans in a row below a share or above a deviation.
EXPECTED, ENTER_SHARE, ENTER_DB, LEAVE_SHARE, LEAVE_DB, LEAVE_SCANS = 3, 0.5, 12.0, 0.3, 15.0, 2


@dataclass
class Site:
    """What is known of a site: how many scans were learned, scans in a row that didn't match, whether the device is there, and (mean level, hits) of neighbours."""

    scans: int
    missed: int
    on: bool
    neighbours: dict[str, tuple[float, int]]

    def judge(self, heard: dict[str, float], placed: bool) -> tuple[bool, int, int, float]:
        """Takes in a scan; (whether on site, expected, common, rms). ``placed``: the site was set just now, or a precise fix is there, which decides while little is known."""
        often = {b: m for b, (m, hits) in self.neighbours.items() if m >= LEAST_DBM and (2 * hits >= self.scans if self.scans >= LEARNED else hits >= 1)}
        common = [b for b in often if b in heard]
        rms = math.sqrt(sum((heard[b] - often[b]) ** 2 for b in common) / len(common)) if common else 99.0
        share = len(common) / len(often) if often else 0.0
        if self.scans < LEARNED:
            on = placed or self.on
        elif self.on:
            bad = share < LEAVE_SHARE or (len(common) >= 3 and rms > LEAVE_DB)
            self.missed = self.missed + 1 if bad else 0
            on = self.missed < LEAVE_SCANS
        else:
            on = len(often) >= EXPECTED and len(common) >= 3 and share >= ENTER_SHARE and rms <= ENTER_DB
            self.missed = 0
        if on:
            self._learn(heard)
        self.on = on
        return on, len(often), len(common), rms

    def _learn(self, heard: dict[str, float]) -> None:
        self.scans += 1
        for b, level in heard.items():
            mean, hits = self.neighbours.get(b, (level, 0))
            self.neighbours[b] = (mean + (level - mean) / min(hits + 1, NEWEST), hits + 1)
        if len(self.neighbours) > NEIGHBOURS:
            kept = sorted(self.neighbours, key=lambda b: (-self.neighbours[b][1], b))[:NEIGHBOURS]
            self.neighbours = {b: self.neighbours[b] for b in kept}


def _take(heard: dict[str, tuple[float, bool]], bssid: str, dbm: float, placed: bool) -> None:
    """A scan holds each transmitter once, at its highest level."""
    level, was = heard.get(bssid, (dbm, False))
    heard[bssid] = (max(level, dbm), was or placed)


#: Rows that are brought together at a time, and the most that are held of what they make.
_AT_ONCE, _HELD = 200_000, 100_000


def strongest(scans: DataFrame) -> DataFrame:
    """``scans`` with few rows for each transmitter of a scan: the highest level, and whether any row was placed. A stream stays one; each task brings together what it reads."""
    keys = ["ts", "site", "scan_ms", "bssid"]
    rows = scans.select(*keys, F.col("dbm").cast("double").alias("dbm"), F.coalesce("placed", F.lit(False)).alias("placed"))
    names = rows.columns

    def together(tables: list[pa.Table]) -> pa.Table:
        one = pa.concat_tables(tables).group_by(keys).aggregate([("dbm", "max"), ("placed", "any")])
        return pa.table([one[{"dbm": "dbm_max", "placed": "placed_any"}.get(c, c)] for c in names], schema=tables[0].schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: list[pa.Table] = []
        held: list[pa.Table] = []
        for b in batches:
            new.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in new) >= _AT_ONCE:
                held, new = [together(held + new)], []
                if held[0].num_rows >= _HELD:
                    yield from held.pop().to_batches()
        if held or new:
            yield from together(held + new).to_batches()

    return rows.mapInArrow(over, rows.schema)


_JUDGED = Row("site", "scan_ms", "on", "changed", "expected", "common", "rms", "scans")


class SiteLock(StatefulProcessor):
    """Per site: scans that wait for the watermark, the neighbourhood by transmitter, and where things stand."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "scan_ms long", "heard array<struct<bssid: string, dbm: double, placed: boolean>>")
        self.neighbours = handle.getMapState("neighbours", "bssid string", "mean double, hits long")
        self.rest = handle.getValueState("rest", "scans long, missed long, on boolean, done_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, new = (tuple(self.rest.get())[3] if self.rest.exists() else -1), {}
        for r in rows:
            if r.scan_ms > done:
                _take(new.setdefault(r.scan_ms, {}), r.bssid, float(r.dbm), bool(r.placed))
        for ms, heard in new.items():
            if self.waiting.containsKey((ms,)):
                for h in self.waiting.getValue((ms,))[0]:
                    _take(heard, *h)
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), ([(b, *v) for b, v in heard.items()],))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        ready = sorted(k[0] for k in self.waiting.keys() if k[0] <= now)
        if not ready:
            return iter(())
        scans, missed, on, _ = tuple(self.rest.get()) if self.rest.exists() else (0, 0, False, -1)
        known = {k[0]: tuple(v) for k, v in self.neighbours.iterator()}
        site = Site(scans, missed, on, dict(known))
        for ms in ready:
            rows = [tuple(h) for h in self.waiting.getValue((ms,))[0]]
            heard: dict[str, float] = {}
            for b, dbm, _placed in rows:
                if dbm > -95:
                    heard[b] = max(dbm, heard.get(b, dbm))
            was = site.on
            judged, expected, common, rms = site.judge(heard, any(r[2] for r in rows))
            out.append(_JUDGED(key[0], ms, judged, judged != was, expected, common, rms, site.scans))
            self.waiting.removeKey((ms,))
        for b in known.keys() - site.neighbours.keys():
            self.neighbours.removeKey((b,))
        for b, v in site.neighbours.items():
            if known.get(b) != v:
                self.neighbours.updateValue((b,), v)
        self.rest.update((site.scans, site.missed, site.on, ready[-1]))
        return iter(out)

    def close(self) -> None:
        pass


def site_lock(scans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(site, scan_ms, on, changed, expected, common, rms, scans) of each scan of a stream, in the order of time.

    ``scans`` have ts (event time), site, scan_ms (the same in ms), bssid, dbm and placed (true where the site was set shortly before or a precise fix is near it). The first five scans
    at a site are learned; then it takes half of the expected neighbours at about their levels to be on site, and two scans in a row that don't match to leave it.
    Rows of a transmitter in one scan are brought together before they are dealt out and in the state, so the work by site follows scans and transmitters.
    """
    kind = dict(scans.dtypes)["site"]
    rows = strongest(with_state_store(scans)).withWatermark("ts", late).groupBy("site")
    return rows.transformWithState(SiteLock(), f"site {kind}, scan_ms long, on boolean, changed boolean, expected long, common long, rms double, scans long", "Append", "EventTime")
