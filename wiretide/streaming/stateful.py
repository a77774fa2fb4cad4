"""Fragments and beacons of packets that keep coming: state for each key, and timers of packet time.

Both need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider, as Spark asks of such operators.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decode import decode
from .live import timed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["capture_id", "src_ip", "dst_ip", "ip_id", "ip_version", "protocol"]
#: Milliseconds of packet time that fragments wait for each other.
WAIT = 60_000


class Fragments(StatefulProcessor):
    """Parts of one datagram by offset, 64 KB at most; of parts at one offset the first to arrive counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "off long", "more boolean, data binary")
        self.first = handle.getValueState("first", "number long, ms long")

    def _whole(self) -> bytes | None:
        out, ended, n = bytearray(), False, 0
        for (off,), (more, data) in sorted(self.parts.iterator(), key=lambda x: x[0][0]):
            if off > len(out):
                return None
            out += data[len(out) - off :]
            ended, n = ended or not more, n + 1
        return bytes(out) if ended and n > 1 else None

    def _end(self, key: tuple, state: str, data: bytes | None) -> Row:
        number, _ = self.first.get()
        kept = [bytes(v[1]) for _, v in self.parts.iterator()]
        row = Row(**dict(zip(KEY, key)), number=number, state=state, parts=len(kept), bytes=sum(map(len, kept)), data=data)
        self.parts.clear()
        self.first.clear()
        return row

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.number):
            if not self.first.exists():
                ms = int(r.ts * 1000) + WAIT
                self.first.update((r.number, ms))
                self.handle.registerTimer(ms)
            if not self.parts.containsKey((r.frag_offset,)):
                self.parts.updateValue((r.frag_offset,), (r.more, r.payload))
            whole = self._whole()
            if whole is not None:
                self.handle.deleteTimer(self.first.get()[1])
                yield self._end(key, "whole", whole)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.first.exists():
            yield self._end(key, "lost", None)

    def close(self) -> None:
        pass


def fragments(packets: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Each fragmented datagram once: ``whole`` with its bytes as soon as no part is missing, or ``lost``, with the parts and bytes
    that came, when the watermark is 60 seconds of packet time past its first part.  Parts that come later than that begin
    anew."""
    d = timed(decode(packets), late).where("is_fragment AND src_ip IS NOT NULL")
    d = d.select(*KEY, "number", "ts", "time", F.col("frag_offset").cast("long").alias("frag_offset"), (F.col("ip_flags").bitwiseAND(1) > 0).alias("more"), "payload")
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", number long, state string, parts long, bytes long, data binary"
    return d.groupBy(*KEY).transformWithState(Fragments(), schema, "Append", "EventTime")


class Beacons(StatefulProcessor):
    """Times of one key until it is quiet."""

    def __init__(self, keys: list[str], quiet_ms: int, least: int):
        self.keys, self.quiet_ms, self.least = keys, quiet_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us long")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [r.us for r in rows]
        self.times.appendList([(x,) for x in new])
        due = max(new) // 1000 + self.quiet_ms
        if self.due.exists():
            old = self.due.get()[0]
            if old >= due:
                return
            self.handle.deleteTimer(old)
        self.due.update((due,))
        self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        times = sorted({t for (t,) in self.times.get()})
        self.times.clear()
        self.due.clear()
        gaps = [b - a for a, b in zip(times, times[1:])]
        if len(gaps) >= self.least:
            mean, middle = statistics.fmean(gaps), float(statistics.median(gaps))
            deviation, mad = statistics.pstdev(gaps), float(statistics.median(abs(g - middle) for g in gaps))
            told = {"n_gaps": len(gaps), "mean_us": mean, "median_us": middle, "stdev_us": deviation, "min_us": min(gaps), "max_us": max(gaps), "mad_us": mad, "cv": deviation / mean, "mad_ratio": mad / middle}
            yield Row(**dict(zip(self.keys, key)), **told)

    def close(self) -> None:
        pass


def beacon_stats(events: DataFrame, keys: list[str], quiet: int = 3600, least: int = 3) -> DataFrame:
    """(keys, us, time behind a watermark) -> what ``intervals.interval_stats`` has of each key's events, once the watermark is
    ``quiet`` seconds past its last one.  A key's times are its state until then."""
    kinds = dict(events.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_gaps long, mean_us double, median_us double, stdev_us double, min_us long, max_us long, mad_us double, cv double, mad_ratio double"
    return events.select(*keys, "us", "time").groupBy(*keys).transformWithState(Beacons(keys, quiet * 1000, least), schema, "Append", "EventTime")


def openings(packets: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(capture_id, src, dst, dport, us, time) of each bare SYN."""
    d = timed(decode(packets), late).where("protocol = 6 AND (tcp_flags & 18) = 2")
    return d.select("capture_id", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.col("dst_port").alias("dport"), F.round(F.col("ts") * 1e6).cast("long").alias("us"), "time")
