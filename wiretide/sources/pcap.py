"""Packets from pcap and pcapng captures.

Two ways in, one parser:

* ``read_captures`` lists paths and sizes; tasks look for the first record of each byte range of a large file, count what
  begins in it, and read the ranges with the number of their first packet and the interfaces known there.  Files in stores
  that tasks can't open come in blocks through Spark's text reader (``blocks``).
* the ``pcap`` data source reads one file on a mounted path, where the driver hops over record headers once.

gzip, bzip2 and zstd captures are unpacked as they are read and are one range each.
"""

from __future__ import annotations

import bz2
import gzip
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import written

SCHEMA = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("caplen", T.LongType()),
        T.StructField("wirelen", T.LongType()),
        T.StructField("linktype", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
ARROW = pa.schema([("capture_id", pa.string()), ("number", pa.int64()), ("ts", pa.float64()), ("caplen", pa.int64()), ("wirelen", pa.int64()), ("linktype", pa.int32()), ("data", pa.binary())])

# First bytes of pcap files (byte order, ticks per second) and of a pcapng section.
PCAP_MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION = b"\x0a\x0d\x0d\x0a"
MOST_BYTES = 0x40000000


class CaptureError(ValueError):
    """Not a capture, or one that is damaged beyond its end."""


@dataclass
class State:
    """What reading on from a place needs."""

    kind: str
    order: str
    rate: int = 10**6
    linktype: int = 1
    interfaces: list = field(default_factory=list)  # (linktype, ticks per second, offset)
    number: int = 0
    at: int = 0  # where reading stopped
    sections: int = 0  # section heads met on the way
    rest: bytes = b""  # what stands behind the last whole record


def unpacked(stream: BinaryIO, head: bytes | None = None) -> BinaryIO:
    """The stream behind gzip, bzip2 or zstd, by its first bytes (``head``, where the stream can't go back)."""
    if head is None:
        head = stream.read(4)
        stream.seek(0)
    if head[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=stream)  # type: ignore[return-value]
    if head[:3] == b"BZh":
        return bz2.BZ2File(stream)  # type: ignore[return-value]
    if head == b"\x28\xb5\x2f\xfd":
        try:
            import zstandard
        except ImportError as e:
            raise CaptureError("zstandard is not installed") from e
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(stream))  # type: ignore[return-value]
    return stream


def opened(stream: BinaryIO) -> State:
    """Read the file's head; the stream then stands at the first record or block."""
    head = stream.read(4)
    if head in PCAP_MAGICS:
        order, rate = PCAP_MAGICS[head]
        rest = stream.read(20)
        if len(rest) < 20:
            raise CaptureError("truncated pcap header")
        return State("pcap", order, rate, struct.unpack(order + "I", rest[16:20])[0] & 0x0FFFFFFF)
    if head == SECTION:
        length, magic = stream.read(4), stream.read(4)
        if magic not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
            raise CaptureError("bad pcapng section")
        order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
        stream.read(struct.unpack(order + "I", length)[0] - 12)
        return State("pcapng", order)
    raise CaptureError("not a capture file")


def _options(body: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        out[code] = body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4
    return out


def _interface(body: bytes, order: str) -> tuple[int, int, int]:
    opts = _options(body[8:], order)
    res = opts.get(9, b"\x06")[0]
    rate = 2 ** min(res & 0x7F, 62) if res & 0x80 else 10 ** min(res, 18)
    offset = struct.unpack(order + "q", opts[14])[0] if len(opts.get(14, b"")) == 8 else 0
    return struct.unpack_from(order + "H", body)[0], rate, offset


def items(stream: BinaryIO, state: State, stop: int | None = None, at: int = 0, bodies: bool = True) -> Iterator[tuple[int, tuple]]:
    """(place, item) of what begins before ``stop``: ("packet", interface, seconds, ticks, length, length on the wire, data),
    ("interface", link type, ticks per second, offset) or ("section",).  A cut-off end is a clean end, and stays in ``state.rest``."""
    order, state.at, state.rest = state.order, at, b""
    while stop is None or at < stop:
        if state.kind == "pcap":
            head = stream.read(16)
            if len(head) < 16:
                state.rest = head
                return
            sec, sub, cap, wire = struct.unpack(order + "IIII", head)
            if cap > MOST_BYTES:
                raise CaptureError(f"packet of {cap} bytes")
            data = stream.read(cap) if bodies else (stream.seek(cap, 1), b"")[1]
            if bodies and len(data) < cap:
                state.rest = head + data
                return
            here, at = at, at + 16 + cap
            state.at = at
            yield here, ("packet", 0, sec, sub, cap, wire, data)
            continue
        head = stream.read(8)
        if len(head) < 8:
            state.rest = head
            return
        if head[:4] == SECTION:
            magic = stream.read(4)
            order = state.order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
            size = struct.unpack(order + "I", head[4:])[0]
            body = stream.read(size - 12)
            if len(body) < size - 12:
                state.rest = head + magic + body
                return
            at += size
            state.at = at
            yield at - size, ("section",)
            continue
        kind, size = struct.unpack(order + "II", head)
        if size < 12 or size % 4 or size > MOST_BYTES:
            raise CaptureError(f"block of {size} bytes")
        body = stream.read(size - 8)
        if len(body) < size - 8:
            state.rest = head + body
            return
        here, at, body = at, at + size, body[:-4]
        state.at = at
        if kind == 1:
            yield here, ("interface", *_interface(body, order))
        elif kind == 6 and len(body) >= 20:
            face, high, low, cap, wire = struct.unpack_from(order + "IIIII", body)
            yield here, ("packet", face, 0, min(high << 32 | low, (1 << 63) - 1), cap, wire, body[20 : 20 + cap])
        elif kind == 3 and len(body) >= 4:
            wire = struct.unpack_from(order + "I", body)[0]
            yield here, ("packet", 0, 0, -1, min(wire, len(body) - 4), wire, body[4 : 4 + wire])  # has no time


def records(stream: BinaryIO, state: State, stop: int | None = None, at: int = 0, bodies: bool = True) -> Iterator[tuple[int, tuple]]:
    """(place, packet) of each packet that begins before ``stop``; state follows."""
    for here, (kind, *x) in items(stream, state, stop, at, bodies):
        if kind == "section":
            state.interfaces = []
            state.sections += 1
        elif kind == "interface":
            state.interfaces.append(tuple(x))
        else:
            face, sec, ticks, cap, wire, data = x
            if state.kind == "pcap":
                link, rate, offset = state.linktype, state.rate, 0
            else:
                link, rate, offset = state.interfaces[face] if face < len(state.interfaces) else (1, 10**6, 0)
            state.number += 1
            yield here, (state.number, sec + ticks // rate + ticks % rate / rate + offset if ticks >= 0 else 0.0, cap, wire, link, data)


def batches(name: str, packets: Iterator[tuple], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for p in packets:
        held.append((name, *p))
        if len(held) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), ARROW.types)], schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), ARROW.types)], schema=ARROW)


def packets_of(content: bytes) -> Iterator[tuple]:
    """Packets of a capture file's bytes.  Raises CaptureError if they are none."""
    stream = unpacked(io.BytesIO(content))
    state = opened(stream)
    for _, p in records(stream, state):
        yield p


#: Stores that tasks open by themselves, to read a part of a file; files in others come in blocks through Spark.
OPENED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
#: Bytes of a file that one task reads, and records that must follow each other where one begins in the middle of a file.
SPLIT = 128 << 20
CHAIN = 8
LONGEST = 1 << 18


def open_path(path: str) -> BinaryIO:
    """A file of one of the OPENED stores, buffered."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    store, name = fs.FileSystem.from_uri(f"{OPENED[scheme]}:///{rest.lstrip('/')}" if scheme == "file" else f"{OPENED[scheme]}:{rest}")
    return io.BufferedReader(store.open_input_file(name), 1 << 20)  # type: ignore[arg-type]


def _is_record(data: bytes, at: int, state: State, last: int | None) -> tuple[int, int] | None:
    """(size, seconds) of what may be a record or block at a place."""
    if state.kind == "pcap":
        sec, sub, cap, wire = struct.unpack_from(state.order + "IIII", data, at)
        ok = sub < state.rate and 0 < cap <= LONGEST and cap <= wire <= LONGEST and (last is None or abs(sec - last) < 864_000)
        return (16 + cap, sec) if ok else None
    kind, size = struct.unpack_from(state.order + "II", data, at)
    ok = (kind in (1, 2, 3, 4, 5, 6, 10) or kind == 0x0A0D0D0A or kind >> 31) and 12 <= size <= LONGEST and size % 4 == 0 and at + size <= len(data) and data[at + size - 4 : at + size] == data[at + 4 : at + 8]
    return (size, 0) if ok else None


def first_record(f: BinaryIO, start: int, state: State) -> int | None:
    """The place of the first record at or after ``start`` from which CHAIN records follow each other; None if there is none."""
    f.seek(start)
    data = f.read((CHAIN + 1) * LONGEST)
    step = 4 if state.kind == "pcapng" else 1
    found = record_in(data, range(-start % step if step == 4 else 0, max(0, len(data) - 16), step), state)
    return None if found is None else start + found


def record_in(data: bytes, places: range, state: State) -> int | None:
    """The first of ``places`` from which CHAIN records follow each other, or as many as there are up to the end of data."""
    for begin in places:
        at, last = begin, None
        for n in range(CHAIN + 1):
            if n == CHAIN or (n and at == len(data)):
                return begin
            if at + 16 > len(data) or (found := _is_record(data, at, state, last)) is None:
                break
            at, last = at + found[0], found[1]
    return None


def _scanned(path: str, start: int, stop: int) -> tuple:
    """(begin, end, packets, reset, interfaces) of the records that begin in a range; begin is -1 where none is found, and
    end where the next range has to begin.  Compressed files are one range."""
    with open_path(path) as f:
        head = f.read(4)
        if head not in PCAP_MAGICS and head != SECTION:
            return (0, -1, 0, False, []) if start == 0 else (-1, -1, 0, False, [])
        f.seek(0)
        state = opened(f)
        begin = f.tell() if start == 0 else first_record(f, start, state)
        if begin is None or begin >= stop:
            return (-1, begin if begin is not None else -1, 0, False, [])
        f.seek(begin)
        order, end = state.order, begin
        for _ in records(f, state, stop, begin, bodies=state.kind != "pcap"):
            pass
        end = state.at
        return (begin, end, state.number, state.sections > 0 or state.order != order, [list(x) for x in state.interfaces])


def _ranges(files: DataFrame, split: int) -> DataFrame:
    """(path, begin, end, first, interfaces) of the parts that tasks read; end is -1 for a whole file.

    Tasks look for the first record of each range and count those that begin in it.  Where each range ends at the place that
    the next one found for itself, the ranges are right; a file in which they don't meet is one range.
    """
    from pyspark.sql import Window as W

    kind = T.ArrayType(T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("path", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "begin", "end", "n")], T.StructField("reset", T.BooleanType()), T.StructField("interfaces", kind)])
    large = files.where(F.col("length") > split).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"), "length")
    parts = large.select("path", "start", F.least(F.col("start") + split, F.col("length")).alias("stop"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, s, *_scanned(p, s, e)) for p, s, e in zip(*(c.to_pylist() for c in b.columns))]
            types = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(parts.repartition(tasks, "path", "start").mapInArrow(scan, schema), "ranges")
    order = W.partitionBy("path").orderBy("start")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    some = found.where("begin >= 0")
    some = some.withColumn("next", F.lead("begin").over(order)).withColumn("meets", F.coalesce(F.col("next") == F.col("end"), F.lit(True)))
    some = some.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("seen", F.collect_list(F.struct("reset", "interfaces")).over(before)).withColumn("right", F.min("meets").over(W.partitionBy("path")))
    known = F.aggregate("seen", F.array().cast(kind), lambda a, x: F.when(x["reset"], x["interfaces"]).otherwise(F.concat(a, x["interfaces"])))
    good = some.where("right").select("path", "begin", "end", "first", known.alias("interfaces"))
    none = F.array().cast(kind)
    whole = files.where(F.col("length") <= split).select("path").union(some.where("NOT right").select("path").distinct())
    return good.union(whole.select("path", F.lit(0).cast("long"), F.lit(-1).cast("long"), F.lit(0).cast("long"), none))


def _packets_between(path: str, begin: int, end: int, first: int, interfaces: list) -> Iterator[tuple]:
    with open_path(path) as f:
        if end < 0:
            stream = unpacked(f)
            state = opened(stream)
            yield from (p for _, p in records(stream, state))
            return
        state = opened(f)
        state.number = first
        if begin > f.tell():
            state.interfaces = [tuple(x) for x in interfaces]
        f.seek(begin)
        yield from (p for _, p in records(f, state, end, begin))


def read_captures(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The packets of all capture files under a path.

    Only paths and sizes are listed; tasks read the files, of which those over ``split`` bytes in ranges.  Files in stores that
    tasks can't open by themselves come in blocks through Spark's text reader.
    """
    listed = spark.read.format("binaryFile").load(path)
    files = listed.select("path", "length")
    some = files.first()
    if some is None or some.path.partition(":")[0] not in OPENED:
        from .blocks import read_blocks

        return read_blocks(spark, path)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for name, begin, end, first, interfaces in zip(*(c.to_pylist() for c in b.columns)):
                yield from batches(name, _packets_between(name, begin, end, first, interfaces))

    ranges = _ranges(files, split)
    return ranges.repartition(max(1, min(ranges.count(), 100_000)), "path", "begin").mapInArrow(read, SCHEMA)


#: Bytes of a file that is taken whole from a store that tasks can't open.
WHOLE_BYTES = 1 << 29
#: Texts that pcapng sections and interfaces have (option number, name).
SECTION_TEXTS = ((2, "hardware"), (3, "os"), (4, "application"))
PROBED = "capture_id string, format string, compression string, byte_order string, snaplen long, linktypes array<long>, interfaces array<string>, hardware string, os string, application string, drops long"


def probed(stream: BinaryIO, whole: bool) -> tuple:
    """What a capture's head says; with ``whole`` also the drops that its statistics blocks count."""
    head = stream.read(4)
    stream.seek(0)
    packed = {b"\x1f\x8b": "gzip", b"BZ": "bzip2", b"\x28\xb5": "zstd"}.get(head[:2])
    stream = unpacked(stream)
    first = stream.read(4)
    if first in PCAP_MAGICS:
        order, _ = PCAP_MAGICS[first]
        rest = stream.read(20)
        if len(rest) < 20:
            raise CaptureError("truncated pcap header")
        snap, link = struct.unpack(order + "II", rest[12:20])
        return ("pcap", packed, "little" if order == "<" else "big", snap, [link & 0x0FFFFFFF], [], None, None, None, 0)
    if first != SECTION:
        raise CaptureError("not a capture file")
    order, told, links, names, snap, drops = "<", {}, [], [], None, 0
    kind, head = first, stream.read(4)
    while len(head) == 4:
        if kind == SECTION:
            magic = stream.read(4)
            order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
            size = struct.unpack(order + "I", head)[0]
            body = stream.read(size - 12)
            for code, name in SECTION_TEXTS:
                told.setdefault(name, _options(body[12:-4], order).get(code, b"").decode("utf-8", "replace") or None)
            number = 0
        else:
            number, size = struct.unpack(order + "I", kind)[0], struct.unpack(order + "I", head)[0]
            if size < 12 or size % 4 or size > MOST_BYTES:
                raise CaptureError(f"block of {size} bytes")
            if number in (2, 3, 6) and not whole:
                break
            body = stream.read(size - 8)
        if number == 1 and len(body) >= 12:
            links.append(struct.unpack_from(order + "H", body)[0])
            snap = struct.unpack_from(order + "I", body, 4)[0]
            names.append(_options(body[8:-4], order).get(2, b"").decode("utf-8", "replace"))
        elif number == 5 and len(lost := _options(body[12:-4], order).get(5, b"")) >= 8:
            drops += struct.unpack(order + "Q", lost[:8])[0]
        kind, head = stream.read(4), stream.read(4)
    return ("pcapng", packed, "little" if order == "<" else "big", snap, sorted(set(links)), names, *(told.get(n) for _, n in SECTION_TEXTS), drops)


def probe(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One row for each capture under a path, from its head only: format, compression, byte order, snap length, link types, names
    of interfaces, what captured it.  With ``whole`` pcapng files are read to their end for the packets that were dropped; of
    files over WHOLE_BYTES in a store that tasks can't open the drops stay unknown (null)."""
    listed = spark.read.format("binaryFile").load(path)
    some = listed.select("path").first()
    local = some is not None and some.path.partition(":")[0] in OPENED
    if some is not None and not local and not listed.where(F.col("length") > WHOLE_BYTES).isEmpty():
        from .blocks import heads

        small = probe_rows(listed.where(F.col("length") <= WHOLE_BYTES).select("path", "content"), False, whole)
        return small.union(probe_rows(heads(spark, path).where(F.col("size") > WHOLE_BYTES).select("path", "head"), False, False).withColumn("drops", F.lit(None).cast("long")))
    return probe_rows(listed.select("path", *([] if local else ["content"])), local, whole)


def probe_rows(files: DataFrame, local: bool, whole: bool) -> DataFrame:
    """(path) or (path, bytes) -> what ``probe`` gives."""
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for i, name in enumerate(b.column(0).to_pylist()):
                with open_path(name) if local else io.BytesIO(b.column(1)[i].as_py()) as f:
                    rows.append((name, *probed(f, whole)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in PROBED.split(", ")])

    return files.mapInArrow(run, PROBED)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int | None
    state: State | None


class PcapReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        with open(self.path, "rb") as f:
            head = f.read(4)
            if head not in PCAP_MAGICS and head != SECTION:
                unpacked(f)  # a compressed capture, or an error at reading
                return [Range(self.path, 0, None, None)]
            f.seek(0)
            state = opened(f)
            first = f.tell()
            out: list[Range] = []
            begin = State(**{**vars(state), "interfaces": list(state.interfaces)})
            start = first
            for at, _ in records(f, state, at=first, bodies=state.kind != "pcap"):
                if at - start >= self.split:
                    out.append(Range(self.path, start, at, begin))
                    start = at
                    begin = State(**{**vars(state), "interfaces": list(state.interfaces), "number": state.number - 1})
            out.append(Range(self.path, start, None, begin))
            return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            if partition.state is None:
                stream = unpacked(f)
                state = opened(stream)
                yield from batches(partition.path, (p for _, p in records(stream, state)))
            else:
                f.seek(partition.start)
                yield from batches(partition.path, (p for _, p in records(f, partition.state, partition.stop, partition.start)))


class PcapSource(DataSource):
    """``spark.dataSource.register(PcapSource)``, then ``spark.read.format("pcap").load(path)``; option ``split`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PcapReader:
        return PcapReader(self.options["path"].removeprefix("file://"), int(self.options.get("split", 64 << 20)))


def capture_info(packets: DataFrame) -> DataFrame:
    """One row per capture: packets, bytes on the wire and captured, first and last time, cut packets, and the packets that the
    capturing host says it dropped (column ``drops`` of the packets, if they have one)."""
    drops = F.col("drops") if "drops" in packets.columns else F.lit(0).cast("long")

    return packets.groupBy("capture_id").agg(
        F.count("*").alias("packets"), F.sum("wirelen").alias("bytes_on_wire"), F.sum("caplen").alias("bytes_captured"),
        F.min(F.when(F.col("ts") != 0, F.col("ts"))).alias("first_ts"), F.max(F.when(F.col("ts") != 0, F.col("ts"))).alias("last_ts"),
        F.count_if(F.col("caplen") < F.col("wirelen")).alias("truncated_packets"), F.sort_array(F.collect_set("linktype")).alias("linktypes"),
        F.max(drops).alias("drops"),
    )
