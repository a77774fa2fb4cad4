"""Fact tables: hosts, flows, conversations, timelines, calls, media, networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import by_map, is_private, service_name
from . import intervals
from .protocols import RTP_CODECS

SYN, ACK, FIN, RST = 2, 16, 1, 4


def _flag(bit: int) -> Column:
    return F.coalesce(F.col("tcp_flags").bitwiseAND(bit) > 0, F.lit(False))


def hosts(packets: DataFrame) -> DataFrame:
    """Per capture and address: traffic, peers, ports served (by SYN-ACKs) and contacted, hardware addresses, times."""
    p = packets.where("src_ip IS NOT NULL")
    served = F.when(_flag(SYN) & _flag(ACK), F.col("src_port"))
    out = p.select("capture_id", F.col("src_ip").alias("ip"), F.col("dst_ip").alias("peer"), F.col("src_mac").alias("mac"), "ts", "ttl", F.col("wirelen").alias("sent"), F.lit(0).cast("long").alias("received"), served.alias("served"), F.when(_flag(SYN) & ~_flag(ACK), F.col("dst_port")).alias("contacted"), F.lit(1).cast("long").alias("psent"))
    into = p.select("capture_id", "dst_ip", "src_ip", "dst_mac", "ts", F.lit(None).cast("long"), F.lit(0).cast("long"), "wirelen", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0).cast("long"))
    both = out.union(into)
    some = lambda c: F.sort_array(F.collect_set(c))
    # ports and peers are counted by distinct pairs, so a busy host's rows are folded before they meet
    return both.groupBy("capture_id", "ip").agg(
        F.sum("psent").alias("packets_sent"), F.sum("sent").alias("bytes_sent"), (F.count("*") - F.sum("psent")).alias("packets_received"), F.sum("received").alias("bytes_received"),
        F.count_distinct("peer").alias("n_peers"), some("served").alias("ports_served"), F.count_distinct("contacted").alias("n_ports_contacted"), some("mac").alias("macs"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("ttl").alias("ttl"),
    ).withColumn("is_private", is_private(F.col("ip")))


def flows(packets: DataFrame) -> DataFrame:
    """Per capture and order-free 5-tuple: the initiator's view.

    The initiator sent the last bare SYN, or else the first packet.  Everything is a mergeable aggregate, so partial
    sums are made before the shuffle and a busy flow is no burden to one task.
    """
    p = packets.where("src_ip IS NOT NULL AND protocol IS NOT NULL").withColumns({"sp": F.coalesce("src_port", F.lit(0)), "dp": F.coalesce("dst_port", F.lit(0))})
    forward = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("sp") <= F.col("dp")))
    p = p.withColumn("fwd", forward).withColumns({
        "a_ip": F.when(F.col("fwd"), F.col("src_ip")).otherwise(F.col("dst_ip")), "b_ip": F.when(F.col("fwd"), F.col("dst_ip")).otherwise(F.col("src_ip")),
        "a_port": F.when(F.col("fwd"), F.col("sp")).otherwise(F.col("dp")), "b_port": F.when(F.col("fwd"), F.col("dp")).otherwise(F.col("sp")),
    })
    bare = _flag(SYN) & ~_flag(ACK)
    size = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("wirelen"))), F.lit(0)).cast("long")
    f = p.groupBy("capture_id", "a_ip", "a_port", "b_ip", "b_port", "protocol").agg(
        F.count("*").alias("packets"), size(F.col("fwd")).alias("bytes_ab"), size(~F.col("fwd")).alias("bytes_ba"), F.min_by("fwd", "number").alias("first_fwd"), F.max_by("fwd", F.when(bare, F.col("number"))).alias("syn_fwd"),
        F.count_if(bare).alias("syns"), F.count_if(_flag(SYN) & _flag(ACK)).alias("synacks"), F.count_if(_flag(RST)).alias("rsts"), F.count_if(_flag(FIN)).alias("fins"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("number").alias("number"),
    )
    ab = F.coalesce("syn_fwd", "first_fwd")
    pick = lambda x, y: F.when(ab, F.col(x)).otherwise(F.col(y))
    f = f.select(
        "capture_id", "number", pick("a_ip", "b_ip").alias("src"), pick("a_port", "b_port").alias("sport"), pick("b_ip", "a_ip").alias("dst"), pick("b_port", "a_port").alias("dport"), "protocol", "packets",
        pick("bytes_ab", "bytes_ba").alias("bytes_out"), pick("bytes_ba", "bytes_ab").alias("bytes_in"), "syns", "synacks", "rsts", "fins", "first_seen", "last_seen",
    )
    return f.withColumns({"duration": F.col("last_seen") - F.col("first_seen"), "service": service_name(F.least("sport", "dport"), F.col("protocol") == 17), "src_private": is_private(F.col("src")), "dst_private": is_private(F.col("dst"))})


def connection_events(packets: DataFrame, flows_: DataFrame) -> DataFrame:
    """(capture_id, src, dst, dport, us): when each conversation over TCP or UDP was opened.

    A TCP conversation is opened by each bare SYN.  One without any is opened by its first packet and by each that comes
    over two seconds after the last such one, so three packets of one check-in are one event.
    """
    p = packets.where("src_ip IS NOT NULL AND protocol IN (6, 17) AND ts > 0").withColumn("us", F.round(F.col("ts") * 1e6).cast("long"))
    opened = p.where(_flag(SYN) & ~_flag(ACK) & (F.col("protocol") == 6)).select("capture_id", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.coalesce("dst_port", F.lit(0).cast("long")).alias("dport"), "us")
    end = lambda ip, port: F.struct(F.col(ip).alias("ip"), F.coalesce(port, F.lit(0).cast("long")).alias("port"))
    low = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    silent = flows_.where("protocol IN (6, 17) AND syns = 0").select("capture_id", "protocol", *low(end("src", "sport"), end("dst", "dport")), "src", "dst", "dport")
    text = lambda c: F.concat_ws(" ", f"{c}.ip", F.col(f"{c}.port").cast("string")).alias(c)
    silent = silent.select("capture_id", "protocol", text("a"), text("b"), "src", "dst", "dport")
    times = p.where("protocol = 17 OR tcp_flags & 18 <> 2").select("capture_id", "protocol", *low(end("src_ip", "src_port"), end("dst_ip", "dst_port")), "us").select("capture_id", "protocol", text("a"), text("b"), "us")
    held = intervals.kept(times, ["capture_id", "protocol", "a", "b"], "us", 2_000_000).join(silent, ["capture_id", "protocol", "a", "b"])
    return opened.union(held.select("capture_id", "src", "dst", "dport", "us"))


# Names of transport protocols.
TRANSPORTS = {1: "ICMP", 2: "IGMP", 4: "IP-in-IP", 6: "TCP", 17: "UDP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 88: "EIGRP", 89: "OSPF", 103: "PIM", 112: "VRRP", 132: "SCTP"}


def protocol_counts(packets: DataFrame, datagrams: DataFrame | None = None) -> DataFrame:
    """(capture_id, name, packets, bytes): packets by transport, beside ARP, what isn't IP, name service messages (NBNS) and
    datagrams put together from fragments (Reassembled)."""
    transport = F.coalesce(by_map(F.col("protocol"), TRANSPORTS), F.concat(F.lit("IP proto "), F.col("protocol").cast("string")))
    name = F.when(F.col("arp_op").isNotNull(), "ARP").when(F.col("src_ip").isNull() | F.col("dst_ip").isNull(), "Non-IP").otherwise(transport)
    count = lambda df, what: df.groupBy("capture_id", what.alias("name")).agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"))
    names = packets.where("protocol = 17 AND (src_port = 137 OR dst_port = 137) AND octet_length(payload) > 0")
    out = count(packets, name).union(count(names, F.lit("NBNS")))
    return out if datagrams is None else out.union(count(datagrams, F.lit("Reassembled")))


def encapsulations(packets: DataFrame) -> DataFrame:
    """(capture_id, name, packets): what encloses packets, by the first word of its name."""
    return packets.select("capture_id", F.explode("encapsulation").alias("e")).groupBy("capture_id", F.split("e", " ")[0].alias("name")).agg(F.count("*").alias("packets"))


def links(packets: DataFrame) -> DataFrame:
    """(capture_id, linktype, ethertype, packets)."""
    return packets.groupBy("capture_id", "linktype", "ethertype").agg(F.count("*").alias("packets"))


def timeline(packets: DataFrame) -> DataFrame:
    """Packets and bytes of each second; packets without a time are left out."""
    return packets.where("ts > 0").groupBy("capture_id", F.floor("ts").alias("second")).agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"))


def arp_owners(arp: DataFrame) -> DataFrame:
    return arp.groupBy("capture_id", F.col("arp_sender_ip").alias("ip")).agg(F.sort_array(F.collect_set("arp_sender_mac")).alias("macs"))


def calls(sip: DataFrame) -> DataFrame:
    """Per call id: who called whom, how far it came and when."""
    at = lambda cond: F.min(F.when(cond, F.col("ts")))
    invite = F.col("is_request") & (F.col("method") == "INVITE")
    done = F.col("is_request") & F.col("method").isin("BYE", "CANCEL")
    ok = F.col("status").between(200, 299) & (F.col("method") == "INVITE")
    c = sip.where("call_id IS NOT NULL").groupBy("capture_id", "call_id").agg(
        F.min_by(F.struct("from_uri", "to_uri", "src_ip", "dst_ip"), F.when(invite, F.col("number"))).alias("f"), at(invite).alias("invited"), F.max(F.when(F.col("status").isin(180, 183), F.col("ts"))).alias("ringing"),
        at(ok).alias("answered"), F.max(F.when(done, F.col("ts"))).alias("ended"), F.max_by("status", F.when(F.col("status") >= 200, F.col("number"))).alias("final_status"), F.count("*").alias("messages"),
        F.collect_set(F.when(F.col("media_port").isNotNull(), F.struct(F.col("media_ip").alias("ip"), F.col("media_port").alias("port")))).alias("endpoints"), F.bool_or("srtp").alias("srtp"), F.count_if(F.col("auth_user") != "").alias("auth_attempts"),
    )
    state = F.when(F.col("answered").isNotNull() & F.col("ended").isNotNull(), "completed").when(F.col("answered").isNotNull(), "answered").when(F.col("final_status") >= 400, "failed").when(F.col("ringing").isNotNull(), "ringing").otherwise("attempted")
    return c.select("capture_id", "call_id", F.col("f.from_uri").alias("caller"), F.col("f.to_uri").alias("callee"), "invited", "ringing", "answered", "ended", "final_status", "messages", "endpoints", "srtp", "auth_attempts", state.alias("state"), (F.col("ended") - F.col("answered")).alias("duration"))


def rtp_streams(rtp: DataFrame) -> DataFrame:
    """Per source, target and SSRC: packets, and what the sequence numbers say is missing."""
    s = rtp.groupBy("capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "ssrc").agg(
        F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("sequence", "number").alias("first_sequence"), F.max_by("sequence", "number").alias("last_sequence"), F.min_by("payload_type", "number").alias("payload_type"),
    )
    want = F.greatest(F.col("last_sequence") - F.col("first_sequence") + 1, F.col("packets"))
    s = s.where("packets >= 4").withColumn("expected_packets", want).withColumn("lost_packets", want - F.col("packets"))
    codec = F.coalesce(by_map(F.col("payload_type"), RTP_CODECS), F.concat(F.lit("dynamic "), F.col("payload_type").cast("string")))
    return s.withColumns({"loss_percent": F.round(F.col("lost_packets") * 100.0 / F.col("expected_packets"), 2), "codec": codec, "duration": F.col("last_seen") - F.col("first_seen")})


def call_media(calls_: DataFrame, streams: DataFrame) -> DataFrame:
    """Media streams of each call, by either end's announced address and port."""
    ends = calls_.select("capture_id", "call_id", "srtp", F.explode("endpoints").alias("e")).select("capture_id", "call_id", "srtp", F.col("e.ip").alias("ip"), F.col("e.port").alias("port"))
    s = streams.select("capture_id", "ssrc", "packets", "codec", F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")))).alias("e"))
    s = s.select("capture_id", "ssrc", "packets", "codec", F.col("e.ip").alias("ip"), F.col("e.port").alias("port"))
    return ends.join(s, ["capture_id", "ip", "port"]).select("capture_id", "call_id", "srtp", "ssrc", "packets", "codec").distinct()


def wifi_networks(wifi: DataFrame) -> DataFrame:
    b = wifi.where("subtype IN ('beacon', 'probe response') AND ssid IS NOT NULL")
    return b.groupBy("capture_id", "ssid").agg(F.sort_array(F.collect_set("bssid")).alias("bssids"), F.sort_array(F.collect_set("security")).alias("security"), F.count("*").alias("beacons"))


def host_roles(hosts_: DataFrame) -> DataFrame:
    """Server (serves a low port), external, hub (over 20 peers) or client."""
    role = F.when(F.exists("ports_served", lambda p: p < 1024), "server").when(~F.col("is_private"), "external").when(F.col("n_peers") > 20, "hub").otherwise("client")
    return hosts_.withColumn("role", role)


def hardware(macs: DataFrame, vendors: DataFrame, mac: str = "mac") -> DataFrame:
    """Vendor of each hardware address by its first three bytes (``vendors``: prefix as six hex digits, vendor), or what kind of
    address it is."""
    clean = F.lower(F.regexp_replace(mac, "[:.-]", ""))
    kind = F.when(clean.startswith("ffffff"), "Broadcast").when(clean.startswith("01005e") | clean.startswith("3333"), "Multicast")
    local = F.when(F.conv(F.substring(clean, 1, 2), 16, 10).cast("int").bitwiseAND(2) > 0, "Locally administered")
    m = macs.withColumn("prefix", F.substring(clean, 1, 6))
    return m.join(vendors.select(F.lower("prefix").alias("prefix"), "vendor"), "prefix", "left").withColumn("vendor", F.coalesce(kind, "vendor", local)).drop("prefix")


def statistics(tables: dict[str, DataFrame], findings: DataFrame | None = None) -> DataFrame:
    """(capture_id, name, value): how much of each kind of record a capture has; questions (dns_questions), different names asked for
    in questions and answers (domains) and different server names of TLS (server_names); with findings their number, whole
    (findings) and by severity (findings_high and so on).  What a capture has none of has no row."""
    one = F.count("*")

    def rows(df: DataFrame, name: Column, value: Column = one) -> DataFrame:
        return df.groupBy("capture_id", name.alias("name")).agg(value.alias("value"))

    kinds = ("hosts", "flows", "dns", "http_requests", "tls", "certificates", "smb", "ntlm", "kerberos", "ics", "mqtt", "sip", "quic", "files", "credentials")
    parts = [rows(tables[k].select("capture_id"), F.lit(k)) for k in kinds]
    names = tables["dns"].select("capture_id", "is_response", F.explode("queries.name").alias("n"))
    parts.append(rows(names.where("NOT is_response"), F.lit("dns_questions")))
    different = lambda df, c: df.select("capture_id", F.lower(c).alias("n")).where("n <> ''").distinct()
    parts += [rows(different(names, "n"), F.lit("domains")), rows(different(tables["tls"], "sni"), F.lit("server_names"))]
    if findings is not None:
        parts += [rows(findings, F.lit("findings")), rows(findings, F.concat(F.lit("findings_"), "severity"))]
    return reduce(DataFrame.union, parts)


def smb_summary(smb: DataFrame, commands: int = 12, pairs: int = 50) -> DataFrame:
    """(capture_id, kind, name, messages): messages of each version, the ``commands`` most frequent requests and the ``pairs`` of
    client and server with most messages."""

    def top(df: DataFrame, kind: str, name: Column, most: int) -> DataFrame:
        n = df.groupBy("capture_id", name.alias("name")).agg(F.count("*").alias("messages"))
        place = F.row_number().over(W.partitionBy("capture_id").orderBy(F.col("messages").desc(), "name"))
        return n.withColumn("r", place).where(F.col("r") <= most).select("capture_id", F.lit(kind).alias("kind"), "name", "messages")

    whole = top(smb, "version", F.col("version"), 10).union(top(smb.where("NOT is_response"), "command", F.col("command"), commands))
    return whole.union(top(smb, "pair", F.concat_ws(" > ", "src_ip", "dst_ip"), pairs))


def profile(t: dict[str, DataFrame]) -> DataFrame:
    """One row for each capture: its traits, how many hosts are inside, outside and on IPv6, its ten most frequent services, the
    twelve largest shares of protocols, and a sentence that says what kind of traffic it is."""
    by = ["capture_id"]
    ranked = lambda df, value, n, name: df.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.col(value).desc(), "name"))).where(F.col("r") <= n).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "name", value))).alias(name))
    strip = lambda c, value: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x[value].alias(value)))
    v6 = F.col("ip").contains(":")
    h = t["hosts"].groupBy(*by).agg(F.count_if("is_private").alias("inside"), F.count_if(~F.col("is_private")).alias("outside"), F.count_if(v6).alias("ipv6"), F.count_if(~v6).alias("ipv4"))
    services = t["flows"].where("service <> ''").groupBy(*by, F.col("service").alias("name")).agg(F.count("*").alias("flows"))
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.col("flows"))), F.lit(0))
    s = services.groupBy(*by).agg(of("SMB", "Kerberos").alias("windows"), of("HTTP").alias("http"), of("HTTPS").alias("https"))
    counts = t["protocol_counts"].groupBy(*by, "name").agg(F.sum("packets").alias("n"))
    shares = counts.join(counts.groupBy(*by).agg(F.sum("n").alias("all")), by).select(*by, "name", F.round(F.col("n") / F.col("all"), 6).alias("share"))
    icmp = shares.where("name = 'ICMP'").select(*by, F.col("share").alias("icmp"))
    dns = t["dns"].groupBy(*by).agg(F.count("*").alias("dns"))
    vlan = t["encapsulations"].where("name = 'VLAN'").select(*by, F.lit(True).alias("vlan")).distinct()
    rows = t["info"].select(*by, "packets", (F.col("last_ts") - F.col("first_ts")).alias("span"))
    for part in (h, s, icmp, dns, vlan, ranked(services, "flows", 10, "top_services"), ranked(shares, "share", 12, "protocol_share")):
        rows = rows.join(part, by, "left")
    rows = rows.fillna(0, ["inside", "outside", "ipv6", "ipv4", "windows", "http", "https", "dns", "icmp", "span"]).fillna(False, ["vlan"])
    tests = {
        "windows-domain": "windows > 0", "web-traffic": "http > 20", "encrypted-web": "https > 20", "dns-heavy": "dns > 0.15 * packets", "internet-facing": "outside > 3 * inside AND outside > 0", "internal-only": "inside > 0 AND outside = 0",
        "icmp-heavy": "icmp > 0.2", "vlan-tagged": "vlan", "dual-stack": "ipv6 > 0 AND ipv4 > 0", "ipv6-only": "ipv6 > 0 AND ipv4 = 0",
    }
    rows = rows.withColumn("traits", F.filter(F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in tests.items()]), lambda x: x.isNotNull()))
    has = lambda n: F.array_contains("traits", n)
    shape = F.when(has("windows-domain"), "a Windows domain").when(has("dns-heavy"), "name look-ups").when(has("encrypted-web") & ~has("web-traffic"), "encrypted web pages").when(has("web-traffic"), "web pages").when(has("icmp-heavy"), "ICMP").otherwise("traffic of many kinds")
    scope = F.when(has("internet-facing"), "that crosses the network's edge").when((F.col("inside") > 0) & (F.col("outside") > 0), "between inside hosts and outside services").otherwise("inside one network")
    span = F.col("span")
    length = F.when(span >= 3600, F.format_string("%.1f hours", span / 3600)).when(span >= 60, F.format_string("%.1f minutes", span / 60)).otherwise(F.format_string("%.1f seconds", span))
    said = F.concat(F.format_string("%d packets in ", F.col("packets")), length, F.format_string(", %d inside and %d outside hosts: mostly ", F.col("inside"), F.col("outside")), shape, F.lit(" "), scope, F.lit("."))
    return rows.select(*by, "traits", F.col("inside").alias("internal_hosts"), F.col("outside").alias("external_hosts"), F.col("ipv6").alias("ipv6_hosts"), strip("top_services", "flows").alias("top_services"), strip("protocol_share", "share").alias("protocol_share"), said.alias("summary"))
