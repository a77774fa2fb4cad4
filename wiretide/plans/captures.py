"""A capture from bytes to findings, and the queries that show it on packets made from the driver's events."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..operators import credentials, facts, long_streams, programs, protocols, quic, reassembly
from ..operators.decode import decode
from ..sources.pcap import SCHEMA, capture_info, probe, read_captures
from ..sources.store import written
from . import report, rules
from .rules import detect


#: What is written once where tables are stored: all that several rules or reports read and that costs a parser or a shuffle.
STORED = (
    "decoded", "datagrams", "dns", "http_requests", "http_responses", "tls", "certificates", "icmp", "arp", "smb", "ntlm", "kerberos", "ics", "mqtt", "ssdp", "quic", "quic_hellos", "sip", "rtp_streams", "calls", "call_media", "wifi",
    "hosts", "flows", "connection_events", "streams", "long", "carved", "files", "programs", "credentials", "info",
)


class CaptureTables(dict):
    """Tables by name, each made when it is first asked for; ``store`` writes those of STORED once."""

    def __init__(self, makers: dict[str, Callable[[CaptureTables], DataFrame]], store: Callable[[DataFrame, str], DataFrame] | None = None):
        super().__init__()
        self.makers, self.store = makers, store

    def __missing__(self, name: str) -> DataFrame:
        made = self.makers[name](self)
        self[name] = self.store(made, name) if self.store and name in STORED else made
        return self[name]


def tables(packets: DataFrame, persist: bool = False) -> CaptureTables:
    """All tables of captures, made when they are asked for.

    Captures are decoded in one pass; fragmented datagrams are put together and decoded with the packets.  ``persist`` writes
    what several readers need as Parquet to the shared folder, so each parser and each shuffle runs once; only then are files of
    conversations over 6 MB a direction told whole.
    """
    raw = packets.withColumn("frame", F.when(F.col("linktype").isin(105, 127), F.col("data")))
    keep = ("capture_id", "number", "ts", "caplen", "wirelen", "linktype", "frame")
    makers: dict[str, Callable[[CaptureTables], DataFrame]] = {
        "decoded": lambda t: decode(raw, keep),
        "datagrams": lambda t: reassembly.datagrams(t["decoded"]),
        "packets": lambda t: t["decoded"].where("NOT is_fragment").drop("linktype", "frame").unionByName(t["datagrams"]),
        "info": lambda t: capture_info(t["decoded"]),
        "wifi": lambda t: protocols.wifi(t["decoded"].where("frame IS NOT NULL").select("capture_id", "number", "ts", "linktype", F.col("frame").alias("data"))),
        "arp_owners": lambda t: facts.arp_owners(t["arp"]),
        "calls": lambda t: facts.calls(t["sip"]),
        "rtp_streams": lambda t: facts.rtp_streams(t["rtp"]),
        "call_media": lambda t: facts.call_media(t["calls"], t["rtp_streams"]),
        "wifi_networks": lambda t: facts.wifi_networks(t["wifi"]),
        "connection_events": lambda t: facts.connection_events(t["packets"], t["flows"]),
        "protocol_counts": lambda t: facts.protocol_counts(t["packets"], t["datagrams"]),
        "encapsulations": lambda t: facts.encapsulations(t["decoded"]),
        "links": lambda t: facts.links(t["decoded"]),
        "smb_names": lambda t: protocols.smb_names(t["smb"]),
        "quic_hellos": lambda t: quic.hellos(t["packets"]),
        "carved": lambda t: carved(t, persist),
        "long": lambda t: long_streams.long_conversations(t["streams"]),
        "files": lambda t: reassembly.described(t["carved"]) if not persist or t["long"].isEmpty() else reassembly.described(t["carved"]).unionByName(long_streams.files(t["packets"], t["streams"], t["long"])),
        "programs": lambda t: programs.programs(t["carved"]),
        "credentials": lambda t: credentials.exposed(t["streams"]).unionByName(credentials.ntlm_exposed(t["ntlm"])).unionByName(credentials.sip_exposed(t["sip"])),
        "fragment_stats": lambda t: reassembly.fragment_stats(t["decoded"]),
        "web_evidence": lambda t: rules.web_evidence(t),
        "stream_summaries": lambda t: reassembly.summaries(t["streams"]),
        "profile": lambda t: facts.profile(t),
        "smb_summary": lambda t: facts.smb_summary(t["smb"]),
    }
    for f in (protocols.dns, protocols.http_requests, protocols.http_responses, protocols.tls, protocols.certificates, protocols.icmp, protocols.arp, protocols.dhcp, protocols.smb, protocols.ntlm, protocols.kerberos, protocols.ics, protocols.mqtt, protocols.coap, protocols.ssdp, protocols.quic, protocols.sip, protocols.rtp, facts.hosts, facts.flows, facts.timeline, reassembly.streams):
        makers[f.__name__] = lambda t, f=f: f(t["packets"])
    return CaptureTables(makers, written if persist else None)


def carved(t: CaptureTables, stored: bool) -> DataFrame:
    """Files of the conversations that ``streams`` holds whole; ``files`` has those of longer ones too.  Where tables aren't stored,
    longer ones are cut off, as looking for them would run all that makes the streams once more."""
    s, smb = t["streams"], t["smb"]
    if stored and not t["long"].isEmpty():
        s = s.join(t["long"], reassembly.CONVERSATION, "left_anti")
        one = t["long"].select("capture_id", F.col("client").alias("src_ip"), F.col("client_port").alias("src_port"), F.col("server").alias("dst_ip"), F.col("server_port").alias("dst_port"))
        smb = smb.join(one, one.columns, "left_anti")
    return reassembly.http_files(s).unionByName(reassembly.smb_files(s, smb)).unionByName(reassembly.raw_files(s))


def settled(df: DataFrame) -> DataFrame:
    return written(df, "settled")


def analyse(spark: SparkSession, path: str) -> tuple[CaptureTables, DataFrame]:
    """Tables and findings of the captures under a path.  Each table that rules or reports share is written once, and so are
    the rules' events and the findings."""
    t = tables(read_captures(spark, path), persist=True)
    t.makers["info"] = lambda t: capture_info(t["decoded"]).drop("drops").join(probe(spark, path, whole=True).drop("linktypes"), "capture_id", "left")
    return t, settled(detect(t, store=written))


def made_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made of the events table: each event is a DNS question over UDP from its user's address, at its time; errors ask
    for long names of hex digits."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", micros(F.col("ts")).alias("us"), "user_id", "event_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, us, user, kind in zip(*(c.to_pylist() for c in b.columns)):
                label = hashlib.md5(str(i).encode()).hexdigest()[:30] if kind == "error" else kind
                name = b"".join(bytes([len(x)]) + x for x in (label.encode(), b"user%d" % (user % 7), b"example", b"com")) + b"\0"
                body = struct.pack(">HHHHHH", i & 0xFFFF, 0x0100, 1, 0, 0, 0) + name + struct.pack(">HH", 16 if i % 3 == 0 else 1, 1)
                udp = struct.pack(">HHHH", 1024 + i % 60000, 53, 8 + len(body), 0) + body
                ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(udp), i & 0xFFFF, 0, 64, 17, 0) + bytes([10, 0, user >> 8 & 255, user & 255]) + bytes([8, 8, 8, i % 40])
                frame = bytes([2, 0, 0, 0, 0, 1, 2, 0, 0, 0, user >> 8 & 255, user & 255]) + b"\x08\x00" + ip + udp
                rows.append(("events", i, us / 1e6, len(frame), len(frame), 1, frame))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=SCHEMA.names)

    return e.mapInArrow(run, SCHEMA)


def capture_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode(made_packets(spark, sf_dir))
    return d.select("number", "src_ip", "dst_ip", "src_port", "dst_port", "ttl", "protocol", "ip_id", F.octet_length("payload").cast("long").alias("payload_len"))


def capture_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = protocols.dns(decode(made_packets(spark, sf_dir)))
    return d.select("number", "src_ip", F.col("queries")[0]["name"].alias("name"), F.col("queries")[0]["type"].alias("type"), "is_response")


def capture_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts.flows(decode(made_packets(spark, sf_dir)))
    return f.groupBy("src", "dst", "service").agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes_out").alias("bytes_out"))


def capture_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = facts.hosts(decode(made_packets(spark, sf_dir)))
    return h.select("ip", "packets_sent", "packets_received", "bytes_sent", "bytes_received", "n_peers", "is_private")


def capture_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over the made packets by the rules that packets of this kind can meet."""
    t = tables(made_packets(spark, sf_dir), persist=True)
    return detect(t, ["recon.network_sweep", "dns.tunneling", "dns.dga"]).select("id", "title", "severity", "count", F.size("hosts").cast("long").alias("n_hosts"))


def capture_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(made_packets(spark, sf_dir), persist=True)
    return report.capture_risk(detect(t, ["recon.network_sweep", "dns.tunneling"]))


CAPTURE_QUERIES = {f.__name__: f for f in (capture_decode, capture_dns, capture_flows, capture_hosts, capture_findings, capture_risk)}

_LABEL = "CASE WHEN event_type = 'error' THEN left(md5(CAST(event_id AS VARCHAR)), 30) ELSE event_type END"
_LEN = f"(14 + 20 + 8 + 12 + len({_LABEL}) + 1 + len(concat('user', user_id % 7)) + 1 + 8 + 4 + 1 + 4)"
_SRC = "concat('10.0.', (user_id // 256) % 256, '.', user_id % 256)"
_DST = "concat('8.8.8.', event_id % 40)"
CAPTURE_SQL = {
    "capture_decode": f"""SELECT event_id AS number, {_SRC} AS src_ip, {_DST} AS dst_ip, 1024 + event_id % 60000 AS src_port, CAST(53 AS BIGINT) AS dst_port, CAST(64 AS BIGINT) AS ttl, CAST(17 AS BIGINT) AS protocol,
  event_id % 65536 AS ip_id, CAST({_LEN} - 42 AS BIGINT) AS payload_len FROM events""",
    "capture_dns": f"""SELECT event_id AS number, {_SRC} AS src_ip, concat({_LABEL}, '.user', user_id % 7, '.example.com') AS name, CASE WHEN event_id % 3 = 0 THEN 'TXT' ELSE 'A' END AS type, false AS is_response FROM events""",
    "capture_flows": f"""WITH f AS (SELECT {_SRC} AS src, {_DST} AS dst, event_id % 60000 AS p, count(*) AS packets, sum({_LEN}) AS b FROM events GROUP BY ALL)
SELECT src, dst, 'DNS' AS service, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(b) AS BIGINT) AS bytes_out FROM f GROUP BY src, dst""",
    "capture_hosts": f"""WITH p AS (SELECT {_SRC} AS s, {_DST} AS d, {_LEN} AS n FROM events), b AS (SELECT s AS ip, d AS peer, 1 AS ps, 0 AS pr, n AS bs, 0 AS br FROM p UNION ALL SELECT d, s, 0, 1, 0, n FROM p)
SELECT ip, CAST(sum(ps) AS BIGINT) AS packets_sent, CAST(sum(pr) AS BIGINT) AS packets_received, CAST(sum(bs) AS BIGINT) AS bytes_sent, CAST(sum(br) AS BIGINT) AS bytes_received, count(DISTINCT peer) AS n_peers, ip LIKE '10.%' AS is_private FROM b GROUP BY ip""",
}
