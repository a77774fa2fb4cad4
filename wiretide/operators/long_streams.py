"""Files in streams of any length.

``reassembly.streams`` makes a row of each direction, which bounds it.  Here a direction is rows of ``CHUNK`` bytes, made in tasks of
their own from the segments that touch them, and a direction's rows stream past a parser in order.  What a parser holds between two
rows is the state of one message: a head that isn't whole yet, how much of a body is to come, and the running digests and the
first bytes of that body.  SMB transfers become parts by offset first, and these become rows and stream past in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .reassembly import CONVERSATION, MOST_HOLE, MOST_STREAM, described
from ..functions.columns import identified

CHUNK = 1 << 20
#: Bytes of a body that types and signatures are told by, of a head, and of an SMB message.
HEAD = 2 << 20
MOST_HEAD = 1 << 20
MOST_MESSAGE = 16 << 20
SIDE = ["capture_id", "src_ip", "src_port", "dst_ip", "dst_port"]


def long_conversations(streams_: DataFrame, most: int = MOST_STREAM) -> DataFrame:
    """Conversations of which a direction has more bytes than ``streams`` keeps."""
    cut = (F.col("lost") > 0) & (F.octet_length("data") >= most)
    return streams_.where(cut).select(*CONVERSATION).distinct()


def directions(streams_: DataFrame, long_: DataFrame) -> DataFrame:
    """SIDE, roles, first packet and time of each direction of these conversations."""
    s = streams_.drop("data").join(long_, CONVERSATION, "left_semi")
    end = lambda a, b: F.when(F.col("to_server"), F.col(a)).otherwise(F.col(b))
    side = [F.col("capture_id"), end("client", "server").alias("src_ip"), end("client_port", "server_port").alias("src_port"), end("server", "client").alias("dst_ip"), end("server_port", "client_port").alias("dst_port")]
    return s.select(*side, "client", "client_port", "server", "server_port", "to_server", "number", F.col("first_seen").alias("ts"))


def chunks(parts: DataFrame, keys: list[str], chunk: int = CHUNK, most_hole: int = MOST_HOLE) -> DataFrame:
    """(keys, off, number, data) -> (keys, at, data, cut): the bytes of each ``chunk`` from the first that is there, smaller holes
    filled with zeros; what lies behind a hole over ``most_hole`` is ``cut`` off.  Of parts at one offset the longest, then the first
    to arrive counts; where parts overlap, the one that begins first does."""
    size = F.octet_length("data").cast("long")
    p = parts.where(size > 0).withColumn("r", F.row_number().over(W.partitionBy(*keys, "off").orderBy(size.desc(), "number"))).where("r = 1")
    p = p.withColumn("chunk", F.explode(F.sequence(F.expr(f"off div {chunk}"), F.expr(f"(off + octet_length(data) - 1) div {chunk}"))))
    skip = F.greatest(F.col("chunk") * chunk - F.col("off"), F.lit(0))
    p = p.select(*keys, "chunk", "off", (F.col("off") + skip).alias("at"), F.substring("data", (skip + 1).cast("int"), F.least(F.lit(chunk), (F.col("chunk") + 1) * chunk - F.col("off") - skip).cast("int")).alias("data"))
    schema = T.StructType([parts.schema[k] for k in keys] + [T.StructField("at", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("cut", T.BooleanType())])

    def build(k: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("off", "ascending")])
        begin, out, cut = None, bytearray(), False
        for at, data in zip(t["at"].to_pylist(), t["data"].to_pylist()):
            begin = at if begin is None else begin
            hole = at - begin - len(out)
            if hole > most_hole:
                cut = True
                break
            if hole > 0:
                out += bytes(hole)
            out += data[max(0, -hole) :]
        return pa.table([*(pa.array([x.as_py()], x.type) for x in k[: len(keys)]), pa.array([begin], pa.int64()), pa.array([bytes(out)], pa.binary()), pa.array([cut])], names=schema.names)

    return p.groupBy(*keys, "chunk").applyInArrow(build, schema)


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "at", "data", "cut").repartition(*keys).sortWithinPartitions(*keys, "at")


def pieces(batches: Iterator[pa.RecordBatch], n: int, most_hole: int) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """(key, bytes in order) of the chunks that stream past; a key's bytes end at a hole over ``most_hole``."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                yield tuple(c[i].as_py() for c in b.columns[:n]), *(c[i].as_py() for c in b.columns[n:])

    def of(same: Iterator[tuple]) -> Iterator[bytes]:
        upto, over = 0, False
        for _, at, data, cut in same:
            if over or (over := at - upto > most_hole):
                continue  # the rest of the key goes by
            if at > upto:
                yield bytes(at - upto)
            yield data
            upto, over = at + len(data), cut

    for key, same in groupby(rows(), lambda r: r[0]):
        parts = of(same)
        yield key, parts
        for _ in parts:
            pass


class Digest:
    """What is told of a body that passes by."""

    def __init__(self) -> None:
        self.size, self.head = 0, bytearray()
        self.md5, self.sha1, self.sha256 = hashlib.md5(), hashlib.sha1(), hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if len(self.head) < HEAD:
            self.head += data[: HEAD - len(self.head)]
        for h in (self.md5, self.sha1, self.sha256):
            h.update(data)

    def row(self) -> tuple:
        return self.size, self.md5.hexdigest(), self.sha1.hexdigest(), self.sha256.hexdigest(), bytes(self.head)


TOLD = [("size", T.LongType()), ("md5", T.StringType()), ("sha1", T.StringType()), ("sha256", T.StringType()), ("data", T.BinaryType())]
TOLD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]


def http_bodies(parts: Iterator[bytes], responses: bool) -> Iterator[tuple[str, Digest]]:
    """(first line, digest of the body) of each message of one direction."""
    held, line, body = bytearray(), "", None
    left: int | None = 0  # bytes of the body or of its chunk that are to come; None for all
    chunked = False
    for part in parts:
        held += part
        while True:
            if body is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    if len(held) > MOST_HEAD:
                        return
                    break
                lines = bytes(held[:end]).split(b"\r\n")
                line = lines[0].decode("latin-1")
                if responses != line.startswith("HTTP/") or (not responses and " HTTP/" not in line):
                    return
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
                del held[: end + 4]
                body, chunked, left = Digest(), False, 0
                status = line.split(" ")[1] if responses and " " in line else ""
                if responses and (status.startswith("1") or status in ("204", "304")):
                    pass
                elif b"chunked" in head.get(b"transfer-encoding", b"").lower():
                    chunked = True
                elif head.get(b"content-length", b"").isdigit():
                    left = int(head[b"content-length"])
                elif responses:
                    left = None
            if left is None or left > 0:
                take = bytes(held if left is None else held[:left])
                del held[: len(take)]
                body.add(take)
                if left is None or len(take) < left:
                    left = left if left is None else left - len(take)
                    break
                left = -2 if chunked else 0  # the line feed behind a chunk
            if chunked:
                if left < 0:
                    if len(held) < -left:
                        break
                    del held[:-left]
                    left = 0
                eol = held.find(b"\r\n")
                if eol < 0:
                    break
                try:
                    left = int(bytes(held[:eol]).split(b";")[0], 16)
                except ValueError:
                    yield line, body
                    return
                del held[: eol + 2]
                if left:
                    continue
                if len(held) < 2:  # the empty line behind the last chunk
                    left = -2
                    chunked = False
                    break
                del held[:2]
            elif left < 0:
                if len(held) < -left:
                    break
                del held[:-left]
            yield line, body
            body, left = None, 0
    if body is not None:
        yield line, body


def smb_parts(parts: Iterator[bytes], to_server: bool) -> Iterator[tuple[str | None, int, bytes]]:
    """(name that is opened, 0, b"") or (None, offset, bytes written or read) of one direction."""
    held, at, read = bytearray(), 0, 0
    little = lambda m, i, n: int.from_bytes(m[i : i + n], "little")
    for part in parts:
        held += part
        while True:
            start = held.find(b"\xfeSMB", at)
            if start < 0:
                del held[: max(0, len(held) - 7)]
                at = 0
                break
            end = start + int.from_bytes(held[start - 3 : start]) if start >= 4 and held[start - 4] == 0 else None
            if end is None or end - start > MOST_MESSAGE:
                at = start + 4
                continue
            if end > len(held):
                del held[: start - 4]
                at = 0
                break
            while start + 64 <= end and held[start : start + 4] == b"\xfeSMB":
                step = little(held, start + 20, 4)
                m = bytes(held[start : start + step if step else end])
                command, response = little(m, 12, 2), bool(m[16] & 1)
                if command == 5 and not response and len(m) >= 112:
                    begin, size = little(m, 108, 2), little(m, 110, 2)
                    if size and begin + size <= len(m):
                        yield m[begin : begin + size].decode("utf-16-le", "replace"), 0, b""
                elif command == 9 and not response and to_server and len(m) >= 80:
                    yield None, little(m, 72, 8), m[little(m, 66, 2) :][: little(m, 68, 4)]
                elif command == 8 and response and not to_server and len(m) >= 72:
                    body = m[m[66] :][: little(m, 68, 4)]
                    yield None, read, body
                    read += len(body)
                if not step:
                    break
                start += step
            at = end


def _told(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for r in rows:  # a row may have two megabytes
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, types)], names=names)


SIDE_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def files(packets: DataFrame, streams_: DataFrame, long_: DataFrame, least: int = 64, most_hole: int = MOST_HOLE, chunk: int = CHUNK) -> DataFrame:
    """The files of long conversations as ``reassembly.described`` gives them, whatever their size.

    Offsets are sequence numbers less the direction's first, modulo 2 ** 32, so a direction's first 4 GB are read."""
    sides = directions(streams_, long_)
    p = packets.where("protocol = 6 AND octet_length(payload) > 0 AND src_ip IS NOT NULL").select(*SIDE, "number", "tcp_seq", F.col("payload").alias("data")).join(sides.select(*SIDE), SIDE, "left_semi")
    base = p.groupBy(*SIDE).agg(F.min_by("tcp_seq", "number").alias("base"))
    parts = p.join(base, SIDE).select(*SIDE, F.pmod(F.col("tcp_seq") - F.col("base"), F.lit(1 << 32)).alias("off"), "number", "data")
    rows = chunks(parts, SIDE, chunk, most_hole).join(sides.select(*SIDE, "to_server", "server_port", "client_port"), SIDE)
    side_fields = [parts.schema[k] for k in SIDE]
    first = F.substring("data", 1, 9).cast("string")
    http = rows.join(rows.where((F.col("at") == 0) & first.rlike("^(HTTP/|[A-Z]+ )")).select(*SIDE), SIDE, "left_semi")
    schema = T.StructType(side_fields + [T.StructField("up", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("line", T.StringType())] + [T.StructField(n, t) for n, t in TOLD])
    key = [*SIDE, "to_server"]

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((*k, i, line, *d.row()) for k, parts in pieces(batches, len(key), most_hole) for i, (line, d) in enumerate(http_bodies(parts, not k[-1])))
        return _told(made, schema.names, [*SIDE_TYPES, pa.bool_(), pa.int64(), pa.string(), *TOLD_TYPES])

    roles = sides.select(*SIDE, *[c for c in CONVERSATION if c != "capture_id"], "number", "ts")
    m = in_order(http, key).mapInArrow(messages, schema).join(roles, SIDE)
    asked = m.where("up").select(*CONVERSATION, "i", F.regexp_extract("line", r"^\S+ (.*) HTTP/", 1).alias("uri"))
    name = F.regexp_extract(F.regexp_replace("uri", r"[?#].*$", ""), r"([^/]*)$", 1)
    cols = [n for n, _ in TOLD]
    web = m.join(asked, [*CONVERSATION, "i"], "left").where(F.col("size") >= least).select(F.lit("HTTP").alias("protocol"), name.alias("name"), *SIDE, "ts", "number", *cols)

    # SMB: what is opened, written and read, then the files by offset
    opened = T.StructType(side_fields + [T.StructField("up", T.BooleanType()), T.StructField("number", T.LongType()), T.StructField("name", T.StringType()), T.StructField("off", T.LongType()), T.StructField("data", T.BinaryType())])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((*k, i, *x) for k, parts in pieces(batches, len(key), most_hole) for i, x in enumerate(smb_parts(parts, k[-1])))
        return _told(made, opened.names, [*SIDE_TYPES, pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.binary()])

    smb = in_order(rows.where("server_port IN (139, 445)"), key).mapInArrow(transfers, opened)
    leaf = F.regexp_extract(F.regexp_replace("name", r"\\", "/"), r"([^/]*)$", 1)
    names = smb.where(F.col("name").isNotNull() & leaf.contains(".")).join(roles.drop("number", "ts"), SIDE).groupBy(*CONVERSATION).agg(F.min_by(leaf, "number").alias("name"))
    placed = chunks(smb.where("name IS NULL").drop("name", "up"), SIDE, chunk, most_hole)
    raw = rows.where("server_port IN (20, 21, 69) OR client_port = 20").drop("to_server", "server_port", "client_port")
    whole = T.StructType([*side_fields, *[T.StructField(n, t) for n, t in TOLD]])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for k, parts in pieces(batches, len(SIDE), most_hole):
                d = Digest()
                for x in parts:
                    d.add(x)
                yield *k, *d.row()

        return _told(made(), whole.names, [*SIDE_TYPES, *TOLD_TYPES])

    shared = in_order(placed, SIDE).mapInArrow(digests, whole).join(roles, SIDE).join(names, CONVERSATION, "left").where(F.col("size") >= least)
    shared = shared.select(F.lit("SMB").alias("protocol"), "name", *SIDE, "ts", "number", *cols)
    sent = in_order(raw, SIDE).mapInArrow(digests, whole).join(roles, SIDE).where((F.col("size") >= least) & ~identified(F.col("data")).isin("bin", "txt"))
    kind = F.when(F.col("server_port") == 69, "TFTP").when(F.col("server_port") == 21, "FTP").otherwise("FTP-Data")
    sent = sent.select(kind.alias("protocol"), F.lit("").alias("name"), *SIDE, "ts", "number", *cols)
    found = web.unionByName(shared).unionByName(sent)
    told = {c: f"told_{c}" for c in ("size", "md5", "sha1", "sha256")}
    found = found.select("capture_id", "protocol", F.col("src_ip").alias("source"), F.col("dst_ip").alias("target"), "name", "ts", "number", "data", *[F.col(c).alias(t) for c, t in told.items()])
    out = described(found)
    return out.withColumns({c: F.col(t) for c, t in told.items()}).drop(*told.values())
