"""Detections: each rule is a function of the capture's tables to findings of one schema.

A finding has the capture, rule id, title, severity, category, confidence, the hosts it names (twenty at most), how many
events it rests on, when they began and ended, and up to twelve pieces of evidence as JSON.  Those two limits are the
report's format.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.columns import by_map, entropy, ip4_number, first_range, is_private, registered_domain, url_decoded
from ..operators import intervals, patterns

Tables = dict[str, DataFrame]
#: Rules as findings, and as the events that findings are folded of.
RULES: dict[str, Callable[[Tables], DataFrame]] = {}
EVENTS: dict[str, Callable[[Tables], DataFrame]] = {}
MOST_EVIDENCE = 12
MOST_HOSTS = 20
SEVERITIES = ("info", "low", "medium", "high", "critical")


def rule(name: str) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        EVENTS[name] = f
        RULES[name] = lambda t: folded(f(t))
        return f

    return add


def rank_of(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def findings(
    rows: DataFrame, name: Column | str, title: Column | str, severity: Column | str, category: str, host: Column, evidence: list[str], first: str = "ts", last: str | None = None, by: list[str] | None = None, confidence: str = "high", least: int = 1
) -> DataFrame:
    """Events of one schema: rows that make one finding for each capture, id and title (and ``by``) if there are ``least``."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    apart = F.to_json(F.struct(*by)) if by else F.lit("")
    return rows.select(
        "capture_id", col(name).alias("id"), col(title).alias("title"), apart.alias("apart"), rank_of(col(severity)).alias("rank"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(least).alias("least"),
        host.cast("string").alias("host"), F.to_json(F.struct(*evidence)).alias("evidence"), F.col(first).cast("double").alias("first"), F.col(last or first).cast("double").alias("last"),
    )


KEYS = ["capture_id", "id", "title", "apart"]
#: How a finding's columns come of its events' (Arrow's names of functions); ``count`` is how many events a row stands for.
MEASURES = {"rank": "max", "category": "min", "confidence": "min", "least": "max", "first": "min", "last": "max", "count": "sum"}
#: Values of a finding that the report keeps, least first.
KEPT = {"host": MOST_HOSTS, "evidence": MOST_EVIDENCE}
#: Rows that a task holds before it folds them.
HELD = 1 << 16


def _shrunk(t: pa.Table) -> pa.Table:
    """A finding's measures, and its least hosts and pieces of evidence one below the other: never more rows than ``t`` has."""
    code = np.zeros(t.num_rows, np.int64)
    for k in KEYS:
        coded = t[k].combine_chunks().dictionary_encode("encode")
        code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
    firsts = np.unique(code, return_index=True)[1]
    sums = t.select(list(MEASURES)).append_column("code", pa.array(code)).group_by("code").aggregate(list(MEASURES.items())).sort_by("code")
    most = max(KEPT.values())
    places, values = [np.arange(len(firsts)) * most], []
    for c, n in KEPT.items():
        coded = t[c].combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        some = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        of, at = np.divmod(np.unique(code[some] * len(order) + rank[coded.indices.drop_null().to_numpy()]), max(len(order), 1))
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        places.append((of * most + nth)[nth < n])
        values.append(coded.dictionary.take(order[at[nth < n]]))
    place = np.unique(np.concatenate(places))
    out = dict(zip(KEYS, t.select(KEYS).take(firsts[place // most]).columns))
    for at, c, value in [(places[0], c, sums[f"{c}_{f}"]) for c, f in MEASURES.items()] + list(zip(places[1:], KEPT, values)):
        index = np.full(len(place), -1)
        index[np.searchsorted(place, at)] = np.arange(len(at))
        out[c] = value.take(pa.array(index, mask=index < 0)).cast(t.schema.field(c).type)
    return pa.table([out[c] for c in t.column_names], schema=t.schema)


def _fold_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_arrays(b.columns, schema=pa.schema([f.with_nullable(True) for f in b.schema])))
        if sum(x.num_rows for x in held) >= HELD:
            held = [_shrunk(pa.concat_tables(held))]
            if held[0].num_rows >= HELD // 2:  # many findings
                yield from held.pop().to_batches()
    if held:
        yield from _shrunk(pa.concat_tables(held)).to_batches()


def folded(events: DataFrame) -> DataFrame:
    """Findings of events, with the least hosts and pieces of evidence by value.  Events are read once: each task folds its own
    as they come, so what is shuffled, and collected for a finding, is a few rows of each task."""
    rows = events.withColumn("count", F.lit(1).cast("long"))
    few = rows.mapInArrow(_fold_task, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
    some = lambda c, n: F.slice(F.array_sort(F.collect_set(c)), 1, n).alias(c)
    out = few.groupBy(*KEYS).agg(
        F.sum("count").alias("count"), F.max("rank").alias("rank"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.min("category").alias("category"), F.min("confidence").alias("confidence"), F.max("least").alias("least"),
        *[some(c, n) for c, n in KEPT.items()],
    ).where("count >= least")
    return out.select(
        "capture_id", "id", "title", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank") + 1).alias("severity"), "category", "confidence",
        F.col("host").alias("hosts"), "count", "first_seen", "last_seen", "evidence",
    )


def no_group_address(ip: str) -> Column:
    first = F.split(F.col(ip), r"\.")[0].try_cast("int")
    return ~(F.coalesce(first.between(224, 239), F.lit(False)) | F.col(ip).endswith(".255") | F.lower(F.col(ip)).startswith("ff"))


# scanning -----------------------------------------------------------------------------------------------------


@rule("recon.port_scan")
def port_scan(t: Tables) -> DataFrame:
    f = t["flows"].where(F.col("protocol").isin(6, 17))
    hit = patterns.fan_out(f, ["capture_id", "src", "dst"], "dport", 25, "ports").join(f.groupBy("capture_id", "src", "dst").agg(F.min("first_seen").alias("ts"), F.max("last_seen").alias("end")), ["capture_id", "src", "dst"])
    return findings(hit, "recon.port_scan", "Port scan", F.when(F.col("ports") >= 100, "high").otherwise("medium"), "Reconnaissance", F.col("src"), ["src", "dst", "ports"], last="end")


@rule("recon.network_sweep")
def network_sweep(t: Tables) -> DataFrame:
    f = t["flows"].where(F.col("protocol").isin(6, 17))
    hit = patterns.fan_out(f, ["capture_id", "src", "dport"], "dst", 20, "targets").join(f.groupBy("capture_id", "src", "dport").agg(F.min("first_seen").alias("ts"), F.max("last_seen").alias("end")), ["capture_id", "src", "dport"])
    return findings(hit, "recon.network_sweep", "Network sweep", "high", "Reconnaissance", F.col("src"), ["src", "dport", "targets"], last="end")


@rule("recon.syn_unanswered")
def syn_unanswered(t: Tables) -> DataFrame:
    f = t["flows"].where("protocol = 6 AND syns > 0")
    hit = patterns.share(f, ["capture_id", "src"], F.col("synacks") == 0, 40, 0.85).join(f.groupBy("capture_id", "src").agg(F.min("first_seen").alias("ts")), ["capture_id", "src"])
    return findings(hit, "recon.syn_unanswered", "Connections that nobody answers", "medium", "Reconnaissance", F.col("src"), ["src", "total", "hits"], by=["src"])


# beaconing ----------------------------------------------------------------------------------------------------


def beacons(t: Tables) -> DataFrame:
    """Scored periodic connections of each source, target and port, by their connection events."""
    key = ["capture_id", "src", "dst", "dport"]
    e = t["connection_events"].where(no_group_address("dst"))
    stats = intervals.interval_stats(e, key, "us")
    times = e.groupBy(*key).agg(F.count("*").alias("n_events"), (F.min("us") / 1e6).alias("ts"), (F.max("us") / 1e6).alias("end"))
    size = t["flows"].where(F.col("protocol").isin(6, 17)).groupBy(*key).agg(F.sum(F.col("bytes_out") + F.col("bytes_in")).alias("bytes"), F.bool_or(~F.col("dst_private")).alias("external"))
    rows = stats.join(times.where("n_events >= 8"), key).join(size, key)
    rows = rows.where(intervals.periodic(rows))
    score = intervals.periodicity(F.col("n_gaps"), F.col("bytes") / F.col("n_events"), F.col("external"), F.col("cv"), F.col("mad_ratio"))
    return rows.withColumn("score", score).withColumn("median_s", F.round(F.col("median_us") / 1e6, 2)).where("score >= 55")


@rule("c2.beacon")
def beacon(t: Tables) -> DataFrame:
    return findings(beacons(t).where("score >= 75 AND external"), "c2.beacon", "Regular call-backs to an outside host", "critical", "Command and control", F.col("src"), ["src", "dst", "dport", "n_events", "median_s", "score"], last="end")


@rule("c2.periodic_traffic")
def periodic_traffic(t: Tables) -> DataFrame:
    rest = beacons(t).where("NOT (score >= 75 AND external)")
    return findings(rest, "c2.periodic_traffic", "Periodic traffic", F.when(F.col("external"), "medium").otherwise("low"), "Command and control", F.col("src"), ["src", "dst", "dport", "n_events", "median_s", "score"], last="end", confidence="medium")


# DNS ----------------------------------------------------------------------------------------------------------


@rule("dns.tunneling")
def dns_tunneling(t: Tables) -> DataFrame:
    q = t["dns"].where("NOT is_response").select("capture_id", "ts", "src_ip", F.explode("queries").alias("q")).select("capture_id", "ts", "src_ip", F.lower("q.name").alias("name"), F.col("q.type").alias("type"))
    q = q.withColumn("domain", registered_domain(F.col("name"))).withColumn("sub", F.expr("CASE WHEN name = domain THEN '' ELSE left(name, length(name) - length(domain) - 1) END"))
    key = ["capture_id", "domain"]
    subs = q.select(*key, "sub").distinct()
    longest = F.array_max(F.transform(F.split("sub", r"\."), lambda x: F.length(x)))
    per = subs.groupBy(*key).agg(F.count("*").alias("subdomains"), F.avg(F.length("sub")).alias("avg_length"), F.avg(F.when(longest >= 12, entropy(F.col("sub")))).alias("avg_bits"))
    kinds = q.groupBy(*key).agg(F.avg(F.col("type").isin("TXT", "NULL", "MX").cast("int")).alias("odd"), F.count("*").alias("queries"), F.min("ts").alias("ts"), F.max("ts").alias("end"), F.min("src_ip").alias("client"))
    n, length, bits = F.col("subdomains"), F.col("avg_length"), F.coalesce("avg_bits", F.lit(0.0))
    score = (
        F.when(n >= 200, 35).when(n >= 80, 25).otherwise(12) + F.when(length >= 40, 30).when(length >= 25, 20).when(length >= 18, 10).otherwise(0)
        + F.when(bits >= 3.8, 25).when(bits >= 3.2, 15).otherwise(0) + F.when(F.col("odd") > 0.3, 20).otherwise(0)
    )
    hit = per.where("subdomains >= 25").join(kinds, key).withColumn("score", score).where("score >= 55")
    return findings(hit, "dns.tunneling", "Data in DNS names", F.when(F.col("score") >= 80, "critical").otherwise("high"), "Command and control", F.col("client"), ["domain", "client", "subdomains", "queries", "score"], last="end")


@rule("dns.dga")
def dns_dga(t: Tables) -> DataFrame:
    who = F.when(F.col("is_response"), F.col("dst_ip")).otherwise(F.col("src_ip"))
    d = t["dns"].withColumn("client", who).groupBy("capture_id", "client").agg(F.count_if(F.col("is_response") & (F.col("rcode") == 3)).alias("missing"), F.count_if(~F.col("is_response")).alias("queries"), F.min("ts").alias("ts"), F.max("ts").alias("end"))
    return findings(d.where("missing >= 40 AND missing > 0.4 * queries"), "dns.dga", "Many names that don't exist", "high", "Command and control", F.col("client"), ["client", "missing", "queries"], last="end")


@rule("dns.random_domains")
def random_domains(t: Tables) -> DataFrame:
    q = t["dns"].where("NOT is_response").select("capture_id", "ts", "src_ip", F.explode("queries.name").alias("name")).withColumn("domain", registered_domain(F.lower("name"))).withColumn("label", F.split("domain", r"\.")[0])
    d = q.groupBy("capture_id", "domain", "label").agg(F.min("ts").alias("ts"), F.min("src_ip").alias("client"))
    vowels = F.regexp_count("label", F.lit("[aeiou]"))
    hit = d.where((F.length("label") >= 10) & (entropy(F.col("label")) > 3.6) & (vowels < 0.25 * F.length("label")))
    return findings(hit, "dns.random_domains", "Domains of random letters", "medium", "Command and control", F.col("client"), ["domain", "client"], confidence="medium", least=3)


# web ----------------------------------------------------------------------------------------------------------


@rule("web.attack")
def web_attacks(t: Tables) -> DataFrame:
    """A finding for each pattern; the response is the next packet's, as captures of single exchanges have it."""
    # a column of its own, as a generator works out again what it names twice
    r = t["http_requests"].withColumn("seen", url_decoded(F.concat_ws(" ", "uri", "body", "user_agent", "referer", "cookie")))
    r = r.withColumn("hit", F.explode(patterns.matched(F.col("seen"))))
    answer = t["http_responses"].select("capture_id", (F.col("number") - 1).alias("number"), "status")
    r = r.join(answer, ["capture_id", "number"], "left")
    weight = by_map(F.col("hit"), {title: w for title, _, w, _ in fixed.WEB_PATTERNS})
    kind = by_map(F.col("hit"), {title: c for title, c, _, _ in fixed.WEB_PATTERNS})
    return findings(r, F.concat(F.lit("web."), kind), F.col("hit"), F.when(weight >= 50, "critical").when(weight >= 40, "high").otherwise("medium"), "Web attack", F.col("src_ip"), ["number", "src_ip", "dst_ip", "host", "uri", "status"])


def web_evidence(t: Tables, around: int = 60) -> DataFrame:
    """Each pattern that a request meets: the text that matched (200 characters), ``around`` characters on both sides of it, where it
    stands (URI, request body or header), all after URL decoding, and the answer's status."""
    r = t["http_requests"]
    part = lambda *c: url_decoded(F.concat_ws(" ", *c))
    r = r.withColumns({"in_uri": part("uri"), "in_body": part("body"), "seen": F.concat_ws(" ", part("uri"), part("body"), part("user_agent", "referer", "cookie"))})
    every = [F.struct(F.lit(title).alias("title"), F.lit(kind).alias("kind"), F.lit(w).alias("weight"), F.regexp_extract("seen", p, 0).alias("matched"), F.regexp_instr("seen", F.lit(p)).alias("at")) for title, kind, w, p in fixed.WEB_PATTERNS]
    hits = F.array(*[F.when(F.col("seen").rlike(p), s) for s, (_, _, _, p) in zip(every, fixed.WEB_PATTERNS)])
    r = r.withColumn("h", F.explode(F.filter(hits, lambda x: x.isNotNull())))
    answer = t["http_responses"].select("capture_id", (F.col("number") - 1).alias("number"), "status")
    first = F.greatest(F.col("h.at") - around, F.lit(1))
    place = F.when(F.instr("in_uri", F.col("h.matched")) > 0, "URI").when(F.instr("in_body", F.col("h.matched")) > 0, "request body").otherwise("header")
    return r.join(answer, ["capture_id", "number"], "left").select(
        "capture_id", "number", "ts", "src_ip", "dst_ip", "method", "host", F.substring("uri", 1, 200).alias("uri"), "h.title", "h.kind", "h.weight", F.substring("h.matched", 1, 200).alias("matched"), place.alias("location"),
        F.substring("seen", first, F.col("h.at") + F.length("h.matched") + around - first).alias("context"), "status",
    )


@rule("web.scanner")
def web_scanner(t: Tables) -> DataFrame:
    return findings(t["http_requests"].where(F.col("user_agent").rlike(fixed.SCANNER_AGENTS)), "web.scanner", "Scanner's user agent", "high", "Web attack", F.col("src_ip"), ["src_ip", "dst_ip", "user_agent"])


@rule("web.dirbust")
def web_dirbust(t: Tables) -> DataFrame:
    r = t["http_responses"]
    hit = patterns.share(r, ["capture_id", "dst_ip"], F.col("status") == 404, 1, 0.6).where("hits >= 50").join(r.groupBy("capture_id", "dst_ip").agg(F.min("ts").alias("ts")), ["capture_id", "dst_ip"])
    return findings(hit, "web.dirbust", "Search for hidden pages", "medium", "Web attack", F.col("dst_ip"), ["dst_ip", "hits", "total"])


# cleartext, exfiltration, movement, tunnels -------------------------------------------------------------------

CRED_PARAM = r"(?i)[?&\s]?(pass(?:word|wd)?|pwd|secret|token|api_?key)=([^&\s]+)"


@rule("cleartext.service")
def cleartext(t: Tables) -> DataFrame:
    name = by_map(F.col("dport").cast("int"), fixed.CLEARTEXT_SERVICES)
    f = t["flows"].withColumn("name", name).where("name IS NOT NULL AND name <> 'HTTP' AND packets > 2")
    return findings(f, F.concat(F.lit("cleartext."), F.lower("name")), F.concat("name", F.lit(" in the clear")), F.when(F.col("name").isin("Telnet", "FTP", "POP3", "IMAP"), "high").otherwise("medium"), "Cleartext", F.col("src"), ["src", "dst", "dport", "packets"], first="first_seen", last="last_seen")


@rule("cleartext.http_credentials")
def http_credentials(t: Tables) -> DataFrame:
    r = t["http_requests"]
    said = F.concat_ws(" ", "uri", "body")
    basic = r.where(F.lower("authorization").startswith("basic ")).select("capture_id", "ts", "src_ip", "dst_ip", F.lit("Authorization").alias("parameter"))
    form = r.where(said.rlike(CRED_PARAM) & ~F.col("dst_port").isin(443, 8443)).select("capture_id", "ts", "src_ip", "dst_ip", F.lower(F.regexp_extract(said, CRED_PARAM, 1)))
    return findings(basic.union(form), "cleartext.http_credentials", "Credentials over plain HTTP", "critical", "Cleartext", F.col("src_ip"), ["src_ip", "dst_ip", "parameter"])


@rule("exfil.large_upload")
def large_upload(t: Tables) -> DataFrame:
    f = t["flows"].where("src_private AND NOT dst_private AND bytes_out >= 5000000 AND bytes_out >= 4 * greatest(1, bytes_in)")
    f = f.join(f.groupBy("capture_id").agg(F.sum("bytes_out").alias("total")), "capture_id")
    return findings(f, "exfil.large_upload", "Large upload to an outside host", F.when(F.col("total") > 100_000_000, "high").otherwise("medium"), "Data exfiltration", F.col("src"), ["src", "dst", "dport", "bytes_out", "bytes_in"], first="first_seen", last="last_seen")


@rule("lateral.service")
def lateral(t: Tables) -> DataFrame:
    f = t["flows"].where("src_private AND dst_private").withColumn("name", by_map(F.col("dport").cast("int"), fixed.LATERAL_SERVICES)).where("name IS NOT NULL")
    hit = patterns.fan_out(f, ["capture_id", "name", "src"], "dst", 5, "peers").join(f.groupBy("capture_id", "name", "src").agg(F.min("first_seen").alias("ts"), F.max("last_seen").alias("end")), ["capture_id", "name", "src"])
    return findings(hit, F.concat(F.lit("lateral."), F.lower("name")), F.concat("name", F.lit(" to many inside hosts")), F.when(F.col("peers") >= 10, "high").otherwise("medium"), "Lateral movement", F.col("src"), ["src", "peers"], last="end")


@rule("tunnel.icmp")
def icmp_tunnel(t: Tables) -> DataFrame:
    i = t["icmp"].where("type IN (0, 8, 128, 129) AND payload_len > 100 AND entropy > 5.5")
    return findings(i, "tunnel.icmp", "Data in ICMP echoes", "high", "Tunnelling", F.col("src_ip"), ["src_ip", "dst_ip", "payload_len"], least=10)


@rule("tunnel.tls_nonstandard_port")
def tls_port(t: Tables) -> DataFrame:
    return findings(t["tls"].where(F.col("sni").isNotNull() & ~F.col("dst_port").isin(*fixed.TLS_PORTS)), "tunnel.tls_nonstandard_port", "TLS on an unusual port", "medium", "Tunnelling", F.col("src_ip"), ["src_ip", "dst_ip", "dst_port", "sni"])


@rule("abuse.mining")
def mining(t: Tables) -> DataFrame:
    return findings(t["flows"].where(F.col("dport").isin(*fixed.MINING_PORTS) & (F.col("packets") > 20)), "abuse.mining", "Traffic to mining pools' ports", "medium", "Resource abuse", F.col("src"), ["src", "dst", "dport", "packets"], first="first_seen", last="last_seen", confidence="medium")


# TLS, spoofing, infrastructure --------------------------------------------------------------------------------


@rule("tls.self_signed")
def self_signed(t: Tables) -> DataFrame:
    return findings(t["certificates"].where("self_signed"), "tls.self_signed", "Self-signed certificate", "medium", "TLS", F.col("src_ip"), ["src_ip", "subject_cn"])


@rule("tls.rare_fingerprint")
def rare_fingerprint(t: Tables) -> DataFrame:
    rows = t["tls"]
    per = rows.groupBy("capture_id", "ja3").agg(F.count("*").alias("n"), F.min_by(F.struct("ts", "src_ip", "sni"), "number").alias("s"))
    whole = per.groupBy("capture_id").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum(F.when(F.col("n") <= 2, F.col("n")).otherwise(0)).alias("few"))
    hit = per.where("n <= 2").join(whole, "capture_id").where("kinds > 5 AND few < 0.5 * all").select("capture_id", "ja3", "n", "s.*")
    return findings(hit, "tls.rare_fingerprint", "Rare TLS client", "low", "TLS", F.col("src_ip"), ["ja3", "n", "src_ip", "sni"], confidence="low")


@rule("tls.obsolete_version")
def obsolete_tls(t: Tables) -> DataFrame:
    return findings(t["tls"].where(F.col("version").isin("SSL 3.0", "TLS 1.0", "TLS 1.1")), "tls.obsolete_version", "Obsolete TLS version", "medium", "TLS", F.col("src_ip"), ["src_ip", "dst_ip", "version"])


@rule("spoof.arp")
def arp_spoof(t: Tables) -> DataFrame:
    a = t["arp"].where(no_group_address("arp_sender_ip"))
    hit = patterns.fan_out(a, ["capture_id", "arp_sender_ip"], "arp_sender_mac", 2, "owners").join(a.groupBy("capture_id", "arp_sender_ip").agg(F.min("ts").alias("ts"), F.max("ts").alias("end")), ["capture_id", "arp_sender_ip"])
    return findings(hit, "spoof.arp", "One address, several hardware addresses", "high", "Spoofing", F.col("arp_sender_ip"), ["arp_sender_ip", "owners"], last="end")


@rule("ipv6.rogue_ra")
def rogue_ra(t: Tables) -> DataFrame:
    r = t["icmp"].where("is_v6 AND type = 134")
    hit = r.groupBy("capture_id").agg(F.count_distinct("src_ip").alias("routers"), F.min("ts").alias("ts"), F.min("src_ip").alias("src_ip")).where("routers > 1")
    return findings(hit, "ipv6.rogue_ra", "Several IPv6 routers announce themselves", "high", "Spoofing", F.col("src_ip"), ["routers"])


@rule("ipv6.tunnelled")
def ipv6_tunnelled(t: Tables) -> DataFrame:
    p = t["packets"].where(F.arrays_overlap("encapsulation", F.array(F.lit("6in4"), F.lit("IP-in-IP"))))
    return findings(p, "ipv6.tunnelled", "IP inside IP", "medium", "Tunnelling", F.col("src_ip"), ["src_ip", "dst_ip"], least=20)


@rule("infra.ip_literal_http")
def ip_literal(t: Tables) -> DataFrame:
    return findings(t["http_requests"].where(F.col("host").rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[[0-9a-fA-F:]+\])(:\d+)?$")), "infra.ip_literal_http", "HTTP to a bare address", "medium", "Infrastructure", F.col("src_ip"), ["src_ip", "host", "uri"])


@rule("infra.rare_user_agent")
def rare_agent(t: Tables) -> DataFrame:
    r = t["http_requests"].where("user_agent IS NOT NULL")
    per = r.groupBy("capture_id", "user_agent").agg(F.count("*").alias("n"), F.min_by(F.struct("ts", "src_ip"), "number").alias("s"))
    kinds = per.groupBy("capture_id").agg(F.count("*").alias("kinds"))
    hit = per.join(kinds, "capture_id").where((F.col("kinds") > 3) & (F.col("n") <= 3) & ~F.col("user_agent").rlike(fixed.SCANNER_AGENTS)).select("capture_id", "user_agent", "n", "s.*")
    return findings(hit, "infra.rare_user_agent", "Rare user agent", "low", "Infrastructure", F.col("src_ip"), ["user_agent", "n", "src_ip"], confidence="low")


@rule("malware.executable_download")
def executable_download(t: Tables) -> DataFrame:
    return findings(t["http_requests"].where(F.col("uri").rlike(fixed.EXECUTABLE_EXTENSIONS)), "malware.executable_download", "Download of a program", "high", "Malware", F.col("src_ip"), ["src_ip", "dst_ip", "host", "uri"])


@rule("malware.content_type_mismatch")
def type_mismatch(t: Tables) -> DataFrame:
    r = t["http_responses"].where((F.col("body").startswith("MZ") | F.col("body").startswith("\x7fELF")) & ~F.lower(F.coalesce("content_type", F.lit(""))).rlike("octet-stream|x-msdownload|x-executable|x-dosexec|x-elf|application/x-ms|binary"))
    return findings(r, "malware.content_type_mismatch", "A program under another content type", "high", "Malware", F.col("src_ip"), ["src_ip", "dst_ip", "content_type"])


@rule("anonymity.tor")
def tor(t: Tables) -> DataFrame:
    range_ = first_range(ip4_number(F.col("dst")), [(c, o) for c, o, k in fixed.KNOWN_NETWORKS if k == "anonymity"], F.lit(None))
    why = F.when(F.col("dst").isin(*fixed.TOR_AUTHORITIES), "directory authority").otherwise(F.coalesce(range_, F.when(F.col("dport").isin(*fixed.TOR_PORTS) & (F.col("packets") > 20), "port")))
    return findings(t["flows"].where("NOT dst_private").withColumn("why", why).where("why IS NOT NULL"), "anonymity.tor", "Tor", "high", "Anonymity", F.col("src"), ["src", "dst", "dport", "why"], first="first_seen", last="last_seen")


@rule("anonymity.vpn")
def vpn(t: Tables) -> DataFrame:
    f = t["flows"].where("NOT dst_private AND packets > 10").withColumn("vpn", by_map(F.col("dport").cast("int"), fixed.VPN_PORTS)).where("vpn IS NOT NULL")
    return findings(f, "anonymity.vpn", "VPN", "medium", "Anonymity", F.col("src"), ["src", "dst", "vpn"], first="first_seen", last="last_seen")


# Windows ------------------------------------------------------------------------------------------------------


@rule("ntlm.v1_in_use")
def ntlm_v1(t: Tables) -> DataFrame:
    return findings(t["ntlm"].where("message_type = 3 AND nt_response_length = 24"), "ntlm.v1_in_use", "NTLMv1", "high", "Windows", F.col("src_ip"), ["src_ip", "dst_ip", "domain", "user"])


@rule("ntlm.null_session")
def ntlm_null(t: Tables) -> DataFrame:
    return findings(t["ntlm"].where("message_type = 3 AND anonymous"), "ntlm.null_session", "Null session", "medium", "Windows", F.col("src_ip"), ["src_ip", "dst_ip"])


def _spread(t: Tables, keys: list[str], target: str, least: int) -> DataFrame:
    n = t["ntlm"].where("message_type = 3 AND user <> ''").withColumn("account", F.concat_ws("\\", "domain", "user"))
    return patterns.fan_out(n, ["capture_id", *keys], target, least).join(n.groupBy("capture_id", *keys).agg(F.min("ts").alias("ts"), F.max("ts").alias("end"), F.min("src_ip").alias("who")), ["capture_id", *keys])


@rule("ntlm.credential_spread")
def credential_spread(t: Tables) -> DataFrame:
    return findings(_spread(t, ["account"], "dst_ip", 6), "ntlm.credential_spread", "One account on many hosts", "high", "Windows", F.col("who"), ["account", "n_targets"], last="end")


@rule("ntlm.password_spraying")
def password_spraying(t: Tables) -> DataFrame:
    return findings(_spread(t, ["src_ip"], "account", 8), "ntlm.password_spraying", "One host tries many accounts", "high", "Windows", F.col("src_ip"), ["src_ip", "n_targets"], last="end")


@rule("kerberos.activity")
def kerberos_activity(t: Tables) -> DataFrame:
    return findings(t["kerberos"], "kerberos.activity", "Kerberos in use", "info", "Windows", F.col("src_ip"), ["message_type", "realm"])


@rule("kerberos.rc4_offered")
def rc4_offered(t: Tables) -> DataFrame:
    k = t["kerberos"].where(F.size("etypes") > 0)
    whole = k.groupBy("capture_id").agg(F.bool_and(F.array_contains("etypes", 23)).alias("always"), F.count("*").alias("n"), F.min("ts").alias("ts"), F.min("src_ip").alias("src_ip")).where("always")
    return findings(whole, "kerberos.rc4_offered", "RC4 everywhere in Kerberos", "low", "Windows", F.col("src_ip"), ["n"])


@rule("kerberos.kerberoasting")
def kerberoasting(t: Tables) -> DataFrame:
    k = t["kerberos"].where(F.col("message_type") == "TGS-REQ").where(F.array_contains("etypes", 23))
    per = k.groupBy("capture_id", "src_ip").agg(F.count("*").alias("requests"), F.min("ts").alias("ts"), F.max("ts").alias("end"))
    return findings(per, "kerberos.kerberoasting", "Service tickets asked for with RC4", F.when(F.col("requests") >= 5, "high").otherwise("medium"), "Windows", F.col("src_ip"), ["src_ip", "requests"], last="end")


@rule("kerberos.asrep_roasting")
def asrep(t: Tables) -> DataFrame:
    return findings(t["kerberos"].where("message_type = 'AS-REP' AND weak_etype"), "kerberos.asrep_roasting", "Weakly encrypted AS replies", "medium", "Windows", F.col("dst_ip"), ["dst_ip", "principals"], least=3)


@rule("smb.v1_in_use")
def smb_v1(t: Tables) -> DataFrame:
    return findings(t["smb"].where("version = 'SMB1'"), "smb.v1_in_use", "SMB 1", "high", "Windows", F.col("src_ip"), ["src_ip", "dst_ip"])


@rule("smb.unsigned_sessions")
def smb_unsigned(t: Tables) -> DataFrame:
    return findings(t["smb"].where("version = 'SMB2' AND command = 'SessionSetup' AND NOT signed"), "smb.unsigned_sessions", "Unsigned SMB sessions", "medium", "Windows", F.col("src_ip"), ["src_ip", "dst_ip"], least=5)


@rule("ransomware.mass_file_operations")
def mass_files(t: Tables) -> DataFrame:
    s = t["smb"].where(F.col("command").isin("Write", "Create", "SetInfo") & ~F.col("is_response")).withColumn("us", F.round(F.col("ts") * 1e6).cast("long"))
    hit = patterns.burst(s, ["capture_id", "src_ip"], "us", 200, 3.0).join(patterns.fan_out(s, ["capture_id", "src_ip"], "dst_ip", 2, "targets"), ["capture_id", "src_ip"]).withColumn("ts", F.col("first_us") / 1e6).withColumn("end", F.col("last_us") / 1e6)
    return findings(hit, "ransomware.mass_file_operations", "Mass changes of shared files", "critical", "Ransomware", F.col("src_ip"), ["src_ip", "n", "targets"], last="end")


@rule("ransomware.artefacts")
def ransom_files(t: Tables) -> DataFrame:
    named = t["files"].select("capture_id", "ts", "source", F.lower("name").alias("name")).unionByName(t["smb_names"].select("capture_id", "ts", F.col("src_ip").alias("source"), F.lower("filename").alias("name")))
    test = patterns.any_of([F.col("name").contains(x) for x in fixed.RANSOM_NOTES] + [F.col("name").endswith(x) for x in fixed.RANSOM_ENDINGS])
    return findings(named.where(test), "ransomware.artefacts", "Ransomware's file names", "critical", "Ransomware", F.col("source"), ["name", "source"])


# industry, things, wireless, QUIC -----------------------------------------------------------------------------


@rule("ics.traffic_present")
def ics_present(t: Tables) -> DataFrame:
    return findings(t["ics"], "ics.traffic_present", "Industrial protocols", "info", "Industrial control", F.col("dst_ip"), ["protocol", "dst_ip"])


@rule("ics.control_commands")
def ics_control(t: Tables) -> DataFrame:
    return findings(t["ics"].where("dangerous"), "ics.control_commands", "Commands that change a process", "high", "Industrial control", F.col("src_ip"), ["protocol", "function", "src_ip", "dst_ip"])


@rule("ics.external_access")
def ics_external(t: Tables) -> DataFrame:
    return findings(t["ics"].where(~is_private(F.col("src_ip"))), "ics.external_access", "Industrial device reached from outside", "critical", "Industrial control", F.col("src_ip"), ["protocol", "src_ip", "dst_ip"])


@rule("iot.mqtt_anonymous")
def mqtt_anonymous(t: Tables) -> DataFrame:
    return findings(t["mqtt"].where("type = 'CONNECT' AND username IS NULL"), "iot.mqtt_anonymous", "MQTT without a user", "high", "Things", F.col("src_ip"), ["src_ip", "dst_ip", "client_id"])


@rule("iot.mqtt_cleartext_credentials")
def mqtt_cleartext(t: Tables) -> DataFrame:
    return findings(t["mqtt"].where("type = 'CONNECT' AND has_password"), "iot.mqtt_cleartext_credentials", "MQTT password in the clear", "critical", "Things", F.col("src_ip"), ["src_ip", "dst_ip", "username"])


@rule("iot.device_discovery")
def discovery(t: Tables) -> DataFrame:
    s = t["ssdp"].where("server IS NOT NULL").groupBy("capture_id", "src_ip").agg(F.max_by("server", "number").alias("server"), F.max("ts").alias("ts"))
    return findings(s, "iot.device_discovery", "Devices that announce themselves", "low", "Things", F.col("src_ip"), ["src_ip", "server"])


@rule("wifi.deauth_flood")
def deauth(t: Tables) -> DataFrame:
    return findings(t["wifi"].where("subtype IN ('deauthentication', 'disassociation')"), "wifi.deauth_flood", "Flood of disconnections", "high", "Wireless", F.col("bssid"), ["bssid", "destination", "reason_code"], least=20)


@rule("wifi.evil_twin")
def evil_twin(t: Tables) -> DataFrame:
    b = t["wifi"].where("subtype IN ('beacon', 'probe response') AND ssid IS NOT NULL AND ssid <> ''")
    n = b.groupBy("capture_id", "ssid").agg(F.count_distinct("bssid").alias("stations"), F.count_distinct("security").alias("kinds"), F.min("bssid").alias("bssid"), F.min("ts").alias("ts"))
    return findings(n.where("stations > 1"), "wifi.evil_twin", "One network name, several stations", F.when(F.col("kinds") > 1, "high").otherwise("medium"), "Wireless", F.col("bssid"), ["ssid", "stations", "kinds"])


@rule("wifi.handshake_captured")
def handshake(t: Tables) -> DataFrame:
    """Messages 1 and 2 between one station and one access point."""
    e = t["wifi"].where("handshake_message IN (1, 2)").withColumn("pair", F.concat_ws("-", F.least("source", "destination"), F.greatest("source", "destination")))
    hit = patterns.fan_out(e, ["capture_id", "pair"], "handshake_message", 2, "messages").join(e.groupBy("capture_id", "pair").agg(F.min("ts").alias("ts"), F.min("bssid").alias("bssid")), ["capture_id", "pair"])
    return findings(hit, "wifi.handshake_captured", "Key exchange captured", "high", "Wireless", F.col("bssid"), ["pair"])


@rule("quic.in_use")
def quic_in_use(t: Tables) -> DataFrame:
    return findings(t["quic"].where("is_initial"), "quic.in_use", "QUIC", "low", "QUIC", F.col("src_ip"), ["src_ip", "dst_ip", "version_name"])


@rule("quic.unknown_version")
def quic_unknown(t: Tables) -> DataFrame:
    return findings(t["quic"].where("NOT is_known_version"), "quic.unknown_version", "Unknown QUIC version", "medium", "QUIC", F.col("src_ip"), ["src_ip", "dst_ip", "version"])


# files, telephony, names --------------------------------------------------------------------------------------


@rule("file.signature")
def file_signatures(t: Tables) -> DataFrame:
    f = t["files"].withColumn("s", F.explode("signatures"))
    name = F.concat(F.lit("file.signature."), F.substring(F.regexp_replace(F.lower("s.name"), " ", "_"), 1, 40))
    return findings(f, name, F.col("s.name"), F.col("s.severity"), "Malware", F.col("source"), ["name", "sha256", "size", "source", "target"])


@rule("file.executable_transfer")
def executable_transfer(t: Tables) -> DataFrame:
    return findings(t["files"].where("category = 'executable' AND protocol IN ('HTTP', 'FTP', 'TFTP', 'FTP-Data')"), "file.executable_transfer", "A program was transferred", "high", "Malware", F.col("target"), ["name", "kind", "sha256", "source", "target"])


@rule("file.suspicious_imports")
def suspicious_imports(t: Tables) -> DataFrame:
    return findings(t["programs"].where(F.size("suspicious") >= 3), "file.suspicious_imports", "A program that reaches into others", "high", "Malware", F.col("source"), ["name", "sha256", "imphash", "suspicious"])


def _credentials(t: Tables, where: str, name: str, title: str, severity: str) -> DataFrame:
    return findings(t["credentials"].where(where), name, title, severity, "Credentials", F.col("client"), ["protocol", "method", "username", "client", "server"])


@rule("credentials.cleartext")
def credentials_cleartext(t: Tables) -> DataFrame:
    return _credentials(t, "secret_kind = 'password'", "credentials.cleartext", "Passwords in the clear", "critical")


@rule("credentials.crackable_hashes")
def credentials_crackable(t: Tables) -> DataFrame:
    return _credentials(t, "secret_kind IN ('hash', 'challenge-response') AND crackable", "credentials.crackable_hashes", "Log-ins that can be guessed offline", "high")


@rule("credentials.tokens")
def credentials_tokens(t: Tables) -> DataFrame:
    bearer = t["http_requests"].where(F.lower("authorization").startswith("bearer ") & ~F.col("dst_port").isin(443, 8443)).select("capture_id", "ts", F.col("src_ip").alias("client"), F.col("dst_ip").alias("server"), F.lit("Bearer").alias("method"))
    kept = t["credentials"].where("secret_kind = 'token'").select("capture_id", "ts", "client", "server", "method")
    return findings(bearer.union(kept), "credentials.tokens", "Access tokens in the clear", "medium", "Credentials", F.col("client"), ["client", "server", "method"])


@rule("voip.activity")
def voip_activity(t: Tables) -> DataFrame:
    calls = t["sip"].select("capture_id", "ts", "method", "src_ip", "dst_ip")
    media = t["rtp_streams"].select("capture_id", F.col("first_seen").alias("ts"), F.lit("RTP").alias("method"), "src_ip", "dst_ip")
    return findings(calls.union(media), "voip.activity", "Telephony", "info", "Telephony", F.col("src_ip"), ["method", "src_ip", "dst_ip"])


@rule("voip.unencrypted_media")
def open_media(t: Tables) -> DataFrame:
    """Streams of over 20 packets that no call set up as SRTP."""
    safe = t["call_media"].where("srtp").select("capture_id", "ssrc").distinct()
    return findings(t["rtp_streams"].where("packets > 20").join(safe, ["capture_id", "ssrc"], "left_anti"), "voip.unencrypted_media", "Calls in the clear", "high", "Telephony", F.col("src_ip"), ["src_ip", "dst_ip", "codec", "packets"], first="first_seen", last="last_seen")


@rule("voip.registration_attack")
def registration_attack(t: Tables) -> DataFrame:
    s = t["sip"].where("is_request AND auth_user <> ''").groupBy("capture_id", "src_ip", "auth_user").agg(F.count("*").alias("tries"), F.min("ts").alias("ts"), F.max("ts").alias("end")).where("tries >= 5")
    return findings(s, "voip.registration_attack", "Many log-ins for one telephone user", "high", "Telephony", F.col("src_ip"), ["src_ip", "auth_user", "tries"], last="end")


@rule("voip.scanner")
def voip_scanner(t: Tables) -> DataFrame:
    return findings(t["sip"].where(F.lower("user_agent").rlike("friendly-scanner|sipvicious|sipcli|sundayddr|sip-scan|pplsip|vaxsipuseragent")), "voip.scanner", "SIP scanner", "high", "Telephony", F.col("src_ip"), ["src_ip", "user_agent"])


@rule("voip.spoofed_invite")
def spoofed_invite(t: Tables) -> DataFrame:
    host = F.regexp_replace("contact", r"^sips?:([^@]*@)?", "")
    s = t["sip"].where("is_request AND method = 'INVITE'").where((F.size("via_hosts") > 0) & (~F.array_contains("via_hosts", F.col("src_ip")) | host.rlike(r"^(127\.|localhost|\[?::1)")))
    return findings(s, "voip.spoofed_invite", "INVITE from another address than it says", "high", "Telephony", F.col("src_ip"), ["src_ip", "via_hosts", "contact"])


@rule("voip.enumeration")
def voip_enumeration(t: Tables) -> DataFrame:
    c = t["calls"].groupBy("capture_id").agg(F.count_if(F.col("final_status") >= 400).alias("failed"), F.count_if(F.col("answered").isNotNull()).alias("answered"), F.min("invited").alias("ts"), F.min("caller").alias("caller")).where("failed >= 10 AND failed > answered")
    return findings(c, "voip.enumeration", "Many calls fail", "medium", "Telephony", F.col("caller"), ["failed", "answered"])


@rule("voip.media_loss")
def media_loss(t: Tables) -> DataFrame:
    return findings(t["rtp_streams"].where("loss_percent > 5 AND packets > 50"), "voip.media_loss", "Lossy media", "low", "Telephony", F.col("src_ip"), ["src_ip", "dst_ip", "loss_percent"], first="first_seen", last="last_seen")


@rule("phishing.lookalike_domain")
def lookalike(t: Tables) -> DataFrame:
    asked = t["dns"].select("capture_id", "ts", "src_ip", F.explode("queries.name").alias("name"))
    seen = asked.union(t["http_requests"].select("capture_id", "ts", "src_ip", "host")).union(t["tls"].select("capture_id", "ts", "src_ip", "sni")).union(t["quic_hellos"].select("capture_id", "ts", "src_ip", "sni"))
    # by hash first, as a least text is found by sorting; "asked" is the name, as a filter on a key would be asked of every row
    n = seen.where("name IS NOT NULL").groupBy("capture_id", F.lower("name").alias("name"), "src_ip").agg(F.min("ts").alias("ts"))
    n = n.groupBy("capture_id", "name").agg(F.min("ts").alias("ts"), F.min("src_ip").alias("src_ip"), F.min("name").alias("asked"))
    return findings(n.withColumn("brand", patterns.imitates(F.col("asked"))).where("brand IS NOT NULL"), "phishing.lookalike_domain", "A name close to a known one", "high", "Phishing", F.col("src_ip"), ["name", "brand", "src_ip"])


@rule("environment.simulated")
def simulated(t: Tables) -> DataFrame:
    said = t["http_responses"].where(F.concat_ws(" ", "server", "body").rlike("INetSim|FakeNet")).select("capture_id", "ts", "src_ip", F.lit("marker").alias("why"))
    same = t["files"].groupBy("capture_id", "sha256").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("ts").alias("ts"), F.min("source").alias("src_ip")).where("n >= 4 AND sources >= 3").select("capture_id", "ts", "src_ip", F.lit("same answer").alias("why"))
    return findings(said.union(same), "environment.simulated", "Simulated network", "info", "Environment", F.col("src_ip"), ["src_ip", "why"])


@rule("capture.truncated")
def truncated(t: Tables) -> DataFrame:
    i = t["info"].where("truncated_packets > 0.02 * packets")
    return findings(i, "capture.truncated", "Packets were cut when captured", "info", "Capture", F.lit(None).cast("string"), ["truncated_packets", "packets"], first="first_ts", last="last_ts")


@rule("capture.drops")
def drops(t: Tables) -> DataFrame:
    return findings(t["info"].where("drops > 0"), "capture.drops", "The capturing host dropped packets", "info", "Capture", F.lit(None).cast("string"), ["drops", "packets"], first="first_ts", last="last_ts")


def detect(t: Tables, only: list[str] | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The findings of all rules (or ``only`` some), and of cheap hosting among the hosts that grave ones name.

    The rules' events are one table (which ``store`` writes once), so all rules together have the shuffle of one.
    """
    names = [n for n in EVENTS if only is None or n in only]
    if not names:
        raise ValueError("no such rule")
    store = store or (lambda df, name: df)
    out = folded(store(reduce(DataFrame.unionByName, [EVENTS[n](t) for n in names]), "events"))
    if only is not None:
        return out
    out = store(out, "raised")
    return out.unionByName(folded(disposable_hosting(out)))


def disposable_hosting(found: DataFrame) -> DataFrame:
    """Events of cheap hosting: hosts of critical and high findings in ranges that rent by the hour."""
    grave = found.where(F.col("severity").isin("critical", "high"))
    said = grave.select("capture_id", F.explode("evidence").alias("e"), F.col("first_seen").alias("ts")).select("capture_id", F.coalesce(F.get_json_object("e", "$.dst"), F.get_json_object("e", "$.dst_ip")).alias("ip"), "ts")
    named = grave.select("capture_id", F.explode("hosts").alias("ip"), F.col("first_seen").alias("ts")).union(said)
    owner = first_range(ip4_number(F.col("ip")), [(c, o) for c, o, k in fixed.KNOWN_NETWORKS if k == "vps"], F.lit(None))
    hit = named.where("ip IS NOT NULL").groupBy("capture_id", "ip").agg(F.min("ts").alias("ts")).withColumn("operator", owner).where("operator IS NOT NULL")
    return findings(hit, "infra.disposable_hosting", "Suspicious host at a cheap provider", "low", "Infrastructure", F.col("ip"), ["ip", "operator"], confidence="medium")
