"""Captures of any size in any store that Spark reads, in blocks.

Spark's own text reader cuts a file into blocks at line feeds and hands over their bytes as they are, so no task opens a file.  Each
block looks for its first record, and its records become rows.  What stands before the first and behind the last record of a
block is one row for each block, and these rows are gone through in order of a file: what two blocks share is put together, packets
get their numbers and interfaces, and each block's beginning is proved by where the one before it ends.  Blocks that took other
bytes for records are read again from the place that is now known.
"""

from __future__ import annotations

import io
import struct
import warnings
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pcap
from .pcap import CHAIN, LONGEST, PCAP_MAGICS, SCHEMA, SECTION, CaptureError, State
from .store import written

#: Bytes in which a block's first record is sought; blocks up to this may have none.
WINDOW = (CHAIN + 1) * LONGEST
#: Times that blocks are read again; files whose blocks don't meet then go through one task each.
ROUNDS = 4
NONE_FOUND = "no record found"
#: What stands for a section's head among interfaces.
RESET = [-1]
PACKED = (b"\x1f\x8b", b"BZ", b"\x28\xb5")

ROWS = "path string, block long, at long, segment int, face long, sec long, ticks long, caplen long, wirelen long, data binary, n long, prefix binary, rest binary, size long, bad string, segments array<array<array<long>>>, whole long, ends boolean"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
FACES = pa.list_(pa.list_(pa.list_(pa.int64())))
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string(), FACES, pa.int64(), pa.bool_()]


class Pieces(io.RawIOBase):
    """A stream of an iterator's bytes."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.size = iter(pieces), memoryview(b""), 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not len(self.held):
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.held = memoryview(piece)
            self.size += len(piece)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, size, value) of all files under a path; ``block`` is where the block begins and ``size`` the file's."""
    text = spark.read.option("lineSep", "\n").text(path)
    name = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "^file:///", "file:/")
    return text.select(name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[bytes]]]:
    """(path, block, file's size, pieces) of the lines that stream past, which come block after block, in order."""

    def parts() -> Iterator[tuple]:
        for b in batches:
            paths, starts, sizes = (c.to_pylist() for c in b.columns[:3])
            at = 0
            for key, same in groupby(zip(paths, starts, sizes)):
                n = sum(1 for _ in same)
                yield key, b"\n".join(b.column(3).slice(at, n).to_pylist()) + b"\n"
                at += n

    for key, same in groupby(parts(), lambda x: x[0]):
        yield *key, (piece for _, piece in same)


def heads(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """(path, size, head): the first bytes of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((p, size, io.BufferedReader(Pieces(pieces)).read(most)) for p, _, size, pieces in in_blocks(batches))
        return _batches(made, ["path", "size", "head"], [pa.string(), pa.int64(), pa.binary()])

    return lines(spark, path).where("block = 0").mapInArrow(run, "path string, size long, head binary")


def _guess(head: bytes) -> tuple[int, State] | None:
    """The first record of what is the middle of a file, whose kind isn't known here; of several, the one found first."""
    at, last = 0, max(0, len(head) - 16)
    for upto in (4096, 65_536, last):
        found = []
        for kind in ("pcap", "pcapng"):
            for order in "<>":
                state = State(kind, order, 10**9)
                begin = pcap.record_in(head, range(at, min(upto, last)), state)
                if begin is not None:
                    found.append((begin, state))
        if found:
            return min(found, key=lambda x: x[0])
        at = min(upto, last)
    return None


def _read_block(path: str, block: int, whole: int, pieces: Iterator[bytes], known: tuple[int, str, str] | None) -> Iterator[tuple]:
    """Rows of a block's packets, then one of the block."""
    source = Pieces(pieces)
    stream = io.BufferedReader(source, 1 << 20)
    head = stream.read(WINDOW)
    state, begin, bad = None, len(head), None
    if block == 0:
        if head[:4] in PCAP_MAGICS or head[:4] == SECTION:
            f = io.BytesIO(head)
            state = pcap.opened(f)
            begin = f.tell()
        else:
            bad = "packed" if head[:2] in PACKED else "not a capture"
    elif known is not None:
        begin, state = known[0], State(known[1], known[2], 10**9)
        if begin > len(head):
            begin, state, bad = len(head), None, "a record over a whole block" if len(head) == WINDOW else None
    elif guess := _guess(head):
        begin, state = guess
    elif len(head) == WINDOW:
        bad = NONE_FOUND
    n, segments, rest, prefix, ends = 0, [[]], b"", head[:begin], False
    if state is not None:
        try:
            for _, (kind, *x) in pcap.items(io.BufferedReader(Pieces(chain([head[begin:]], iter(lambda: stream.read(1 << 20), b""))), 1 << 20), state):
                ends = kind == "packet"
                if ends:
                    n += 1
                    yield (path, block, n, len(segments) - 1, *x, *[None] * 8)
                else:
                    segments.append([x] if kind == "interface" else [RESET])
            rest = state.rest
        except CaptureError as e:
            bad = str(e)
    elif bad:
        prefix = head[:16]
    while stream.read(1 << 20):  # to the block's end, for its size
        pass
    yield (path, block, *[None] * 8, n, prefix, rest, source.size, bad, segments, whole, ends)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 4096, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _blocks(rows: DataFrame, known: dict[tuple[str, int], tuple[int, str, str]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (r for path, block, whole, pieces in in_blocks(batches) for r in _read_block(path, block, whole, pieces, shared.value.get((path, block))))
        return _batches(made, NAMES, TYPES)

    return rows.mapInArrow(run, ROWS)


STITCHED = "path string, block long, kind string, first long, n long, begin long, order string, faces array<array<array<long>>>, at long, segment int, face long, sec long, ticks long, caplen long, wirelen long, data binary"
STITCHED_NAMES = [c.split()[0] for c in STITCHED.split(", ")]
STITCHED_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), FACES, pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]


def _stitch(path: str, blocks: Iterator[tuple]) -> Iterator[tuple]:
    """A file's blocks (block, n, prefix, rest, size, file's size, bad, segments, ends) in order -> rows of kind "block" (first number and
    interfaces), "packet" (of a border), "again" (a block to be read from ``begin``), "packed", or "bad" (``order`` says why).
    Behind a block that is to be read again nothing is final: it only tells of others that will be."""
    empty = [None] * 8
    state, carry, total, lost, unsure = None, b"", 0, False, False
    number, faces = 0, []

    def interfaces() -> list:
        return [[state.linktype, state.rate, 0]] if state.kind == "pcap" else faces

    for block, n, prefix, rest, size, whole, bad, segments, ends in blocks:
        total += size
        none = not bad and size == len(prefix)  # no record begins in it, as far as it can tell
        if total == whole + 1:  # the reader can't tell whether a line feed ends the file
            if rest:
                rest = rest[:-1]
            elif size == len(prefix):
                prefix = prefix[:-1]
            elif ends:  # its last packet was only made whole by it
                n -= 1
        if block == 0:
            if bad:
                yield (path, block, "packed" if bad == "packed" else "bad", 0, 0, 0, bad, None, *empty)
                return
            f = io.BytesIO(prefix)
            state = pcap.opened(f)
        elif not lost:
            # the records of the border: whole ones up to where this block began
            joined = carry + prefix
            border = State(state.kind, state.order, 10**9)
            try:
                for _, (kind, *x) in pcap.items(io.BytesIO(joined), border):
                    if kind == "packet":
                        number += 1
                        yield (path, block, "packet", number - 1, 0, 0, None, [interfaces()], 1, 0, *x)
                    else:
                        faces = [*faces, x] if kind == "interface" else []
            except CaptureError as e:
                if not unsure:
                    yield (path, block, "bad", 0, 0, 0, str(e), None, *empty)
                return
            state.order = border.order
            if none:
                carry = border.rest + rest
                yield (path, block, "block", number, 0, 0, None, [interfaces()], *empty)
                continue
            if border.rest or bad:
                # its first record begins where the one that reaches into it ends
                at = len(prefix) - len(border.rest)
                if at < 0:
                    need = _length(border.rest, state)
                    at = at + need if need is not None else -1
                if at < 0 or (bad and bad != NONE_FOUND and at == len(prefix)):
                    if not unsure:
                        yield (path, block, "bad", 0, 0, 0, bad or "records don't meet", None, *empty)
                    return
                yield (path, block, "again", 0, 0, at, state.kind + state.order, None, *empty)
                lost = unsure = True
                continue
        else:
            lost, carry = bool(bad), rest  # its own end is believed until the block before it is read again
            continue
        merged = [interfaces()]
        for s in segments[1:]:
            faces = s[1:] if s[0] == RESET else [*faces, *s]
            merged.append(faces)
        yield (path, block, "block", number, n, 0, None, merged, *empty)
        number += n
        carry = rest


def _length(head: bytes, state: State) -> int | None:
    """Bytes of the record or block that begins with ``head``; None if too few are there."""
    if state.kind == "pcap":
        return 16 + struct.unpack_from(state.order + "I", head, 8)[0] if len(head) >= 16 else None
    return struct.unpack_from(state.order + "I", head, 4)[0] if len(head) >= 8 else None


def _in_order(edges: DataFrame) -> DataFrame:
    """The rows of ``_stitch``.  Only the rows of blocks, one for each, go through one task a file, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        made = (r for path, same in groupby(rows, lambda r: r[0]) for r in _stitch(path, (x[1:] for x in same)))
        return _batches(made, STITCHED_NAMES, STITCHED_TYPES)

    cols = ["path", "block", "n", "prefix", "rest", "size", "whole", "bad", "segments", "ends"]
    return edges.select(*cols).repartition("path").sortWithinPartitions("path", "block").mapInArrow(run, STITCHED)


def _within(pieces: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The first ``size`` bytes."""
    for piece in pieces:
        yield piece[:size]
        size -= min(size, len(piece))


def _unpacked(rows: DataFrame) -> DataFrame:
    """Packets of compressed files: their bytes, in pieces, go through one task a file in order, as they can't be cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((path, block, i, size, piece) for path, block, size, pieces in in_blocks(batches) for i, piece in enumerate(pieces))
        return _batches(made, ["path", "block", "i", "size", "value"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, size, v) for b in batches for path, size, v in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()))
        for (path, size), same in groupby(rows, lambda r: r[:2]):
            stream = io.BufferedReader(Pieces(_within((v for *_, v in same), size)), 1 << 20)
            stream = pcap.unpacked(stream, stream.peek(4)[:4])
            state = pcap.opened(stream)
            yield from pcap.batches(path, (p for _, p in pcap.records(stream, state)))

    pieces = rows.mapInArrow(cut, "path string, block long, i long, size long, value binary")
    return pieces.repartition("path").sortWithinPartitions("path", "block", "i").mapInArrow(run, SCHEMA)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The packets of all capture files under a path, as ``read_captures`` gives them, by way of Spark's text reader.

    Records are written to the shared folder once.  A file may have any size; a block is ``spark.sql.files.maxPartitionBytes`` at
    most.  Compressed files go through one task each, as do those that hold so many captures in their packets that no block can tell
    its own records; a warning names them.  Raises CaptureError for what is no capture.
    """
    source = lines(spark, path)
    read = written(_blocks(source, {}), "blocks")
    known: dict[tuple[str, int], tuple[int, str, str]] = {}
    for i in range(ROUNDS + 1):
        order = written(_in_order(read.where("n IS NOT NULL")), "stitched")
        again = {(r.path, r.block): (r.begin, r.order[:-1], r.order[-1]) for r in order.where("kind = 'again'").select("path", "block", "begin", "order").collect()}
        wrong = order.where("kind = 'bad'").select("path", "block", "order").first()
        if wrong is not None:
            raise CaptureError(f"{wrong.path}, block at {wrong.block}: {wrong.order}")
        if not again or i == ROUNDS:
            break
        known |= again
        keys = spark.createDataFrame([(p, b) for p, b in again], "path string, block long")
        new = _blocks(source.join(F.broadcast(keys), ["path", "block"], "left_semi").select("path", "block", "size", "value"), known)
        read = read.join(F.broadcast(keys), ["path", "block"], "left_anti").select(*NAMES).union(written(new, "blocks"))
    slow = sorted({p for p, _ in again})
    if slow:
        warnings.warn(f"{len(slow)} captures go through one task each, as their blocks don't meet: {slow[:3]}", stacklevel=2)
        order = order.where(~F.col("path").isin(slow))
    packed = order.where("kind = 'packed'").select("path").distinct().union(spark.createDataFrame([(p,) for p in slow], "path string"))
    told = order.where("kind = 'block'").select("path", "block", "first", "faces", F.col("n").alias("upto"))
    inner = read.where("at IS NOT NULL").join(told, ["path", "block"]).where("at <= upto")
    border = order.where("kind = 'packet'")
    cols = ["path", (F.col("first") + F.col("at")).alias("number"), "sec", "ticks", "caplen", "wirelen", F.try_element_at(F.try_element_at("faces", F.col("segment") + 1), F.least("face", F.lit(1 << 30)).cast("int") + 1).alias("f"), "data"]
    both = inner.select(*cols).unionByName(border.select(*cols))
    link, rate, offset = (F.coalesce(F.try_element_at("f", F.lit(i + 1)), F.lit(x).cast("long")) for i, x in enumerate((1, 10**6, 0)))
    whole = F.expr("ticks div coalesce(try_element_at(f, 2), 1000000L)")
    part = F.expr("ticks % coalesce(try_element_at(f, 2), 1000000L)") / rate
    ts = F.when(F.col("ticks") < 0, F.lit(0.0)).otherwise(F.col("sec") + whole + part + offset)
    packets = both.select(F.col("path").alias("capture_id"), "number", ts.alias("ts"), "caplen", "wirelen", link.cast("int").alias("linktype"), "data")
    if packed.isEmpty():
        return packets
    names = packed.select(F.col("path").alias("packed"))
    return packets.union(_unpacked(source.join(names, F.col("path") == F.col("packed"), "left_semi")))
