"""What a report shows of a capture's findings and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import csv_guard, defang, is_private, registered_domain, risk_band, subnet
from ..operators import facts, patterns, reassembly
from ..sources.store import written
from .rules import Tables, rank_of


def capture_risk(findings: DataFrame) -> DataFrame:
    """Score and band of each capture; a rule's family is its id's first word."""
    f = findings.withColumn("family", F.split("id", r"\.")[0]).withColumn("order", F.xxhash64("id", "title"))
    score = patterns.risk_score(f, "capture_id", "family", "severity", "confidence", "order")
    every = findings.select("capture_id").distinct().join(score, "capture_id", "left").withColumn("risk", F.coalesce("risk", F.lit(0)))
    return every.withColumn("band", risk_band(F.col("risk")))


def host_risks(findings: DataFrame) -> DataFrame:
    named = findings.select("capture_id", F.explode("hosts").alias("ip"), "severity")
    per = named.withColumn("key", F.struct("capture_id", "ip"))
    return patterns.host_risk(per, "key", "severity").select("key.*", "risk")


def top_hosts(t: Tables, findings: DataFrame, n: int = 500) -> DataFrame:
    h = t["hosts"].join(host_risks(findings), ["capture_id", "ip"], "left").withColumn("risk", F.coalesce("risk", F.lit(0))).withColumn("bytes", F.col("bytes_sent") + F.col("bytes_received"))
    r = F.row_number().over(W.partitionBy("capture_id").orderBy(F.col("risk").desc(), F.col("bytes").desc(), "ip"))
    return h.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def graph(t: Tables, findings: DataFrame, nodes: int = 300, edges: int = 900) -> tuple[DataFrame, DataFrame]:
    """The riskiest and busiest hosts, and the conversations between them, with sizes for drawing; an edge is suspect
    if critical or high findings name both its ends."""
    n = top_hosts(t, findings, nodes).select("capture_id", "ip", "risk", "bytes", subnet(F.col("ip")).alias("group"))
    n = n.withColumn("weight", F.round(F.pow(F.col("bytes") / F.max("bytes").over(W.partitionBy("capture_id")), F.lit(0.4)), 4))
    e = t["flows"].groupBy("capture_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.col("bytes_out") + F.col("bytes_in")).alias("bytes"), F.sum("packets").alias("packets"))
    grave = findings.where(F.col("severity").isin("critical", "high")).select("capture_id", F.explode("hosts").alias("ip")).distinct().withColumn("grave", F.lit(True))
    ends = n.select("capture_id", "ip").join(grave, ["capture_id", "ip"], "left")
    end = lambda c: ends.select("capture_id", F.col("ip").alias(c), F.coalesce("grave", F.lit(False)).alias(f"g{c}"))
    e = e.join(end("a"), ["capture_id", "a"]).join(end("b"), ["capture_id", "b"]).withColumn("suspect", F.col("ga") & F.col("gb")).drop("ga", "gb")
    e = e.withColumn("__r", F.row_number().over(W.partitionBy("capture_id").orderBy(F.col("bytes").desc(), "a", "b"))).where(F.col("__r") <= edges).drop("__r")
    return n, e.withColumn("weight", F.round(F.pow(F.col("bytes") / F.max("bytes").over(W.partitionBy("capture_id")), F.lit(0.35)), 4))


def iocs(t: Tables, findings: DataFrame) -> DataFrame:
    """Indicators: outside addresses of findings from medium up, names in the evidence of grave ones, rare TLS
    fingerprints, digests of signed or executable files; each also in a form that no client follows."""
    grave = findings.where(F.col("severity").isin("critical", "high"))
    said = grave.select("capture_id", F.explode("evidence").alias("e"))
    names = said.select("capture_id", F.explode(F.array(*[F.get_json_object("e", f"$.{k}") for k in ("domain", "host", "sni", "name", "dst", "dst_ip")])).alias("v")).where("v IS NOT NULL")
    is_ip = F.col("v").rlike(r"^\d{1,3}(\.\d{1,3}){3}$|:")
    ips = findings.where(F.col("severity").isin("critical", "high", "medium")).select("capture_id", F.explode("hosts").alias("v")).union(names.where(is_ip))
    out = ips.where(is_ip & ~is_private(F.col("v"))).select("capture_id", F.lit("ip").alias("kind"), "v")
    out = out.union(names.where(~is_ip & F.col("v").contains(".")).select("capture_id", F.lit("domain"), "v"))
    rare = findings.where("id = 'tls.rare_fingerprint'").select("capture_id", F.explode("evidence").alias("e"))
    out = out.union(rare.select("capture_id", F.lit("ja3"), F.get_json_object("e", "$.ja3")))
    out = out.union(t["files"].where((F.size("signatures") > 0) | (F.col("category") == "executable")).select("capture_id", F.lit("sha256"), "sha256"))
    return out.distinct().withColumnRenamed("v", "value").withColumn("defanged", F.when(F.col("kind").isin("ip", "domain"), defang(F.col("value"))).otherwise(F.col("value")))


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """Findings by rule and title: new, missing or common against an earlier capture."""
    return patterns.compare(now, before, ["id", "title"])


def domains(dns: DataFrame) -> DataFrame:
    """(capture_id, domain): the registered domains that a capture's questions and answers name."""
    names = dns.select("capture_id", F.explode("queries.name").alias("name"))
    return names.select("capture_id", registered_domain(F.lower("name")).alias("domain")).where("domain <> ''").distinct()


def _values(found: DataFrame, hosts: DataFrame, domains_: DataFrame) -> DataFrame:
    """(kind, value) of what two captures are compared by."""
    out = found.select(F.lit("finding").alias("kind"), F.concat_ws(": ", "id", "title").alias("value"))
    out = out.union(hosts.select(F.lit("host"), "ip")).union(hosts.where("NOT is_private").select(F.lit("external"), "ip"))
    return out.union(domains_.select(F.lit("domain"), "domain")).where("value IS NOT NULL")


def compare_captures(now: tuple[Tables, DataFrame], before: tuple[Tables, DataFrame]) -> DataFrame:
    """(kind, value, state) of findings, hosts, external hosts and domains of two analysed captures: new, missing or common."""
    of = lambda t, found: _values(found, t["hosts"], domains(t["dns"]))
    return patterns.compare(of(*now), of(*before), ["kind", "value"])


#: What is read back of a report on disk.  The types are stated, as a folder of a clean capture has no file to tell them, and a
#: capture named by digits is a text.
KEPT = {
    "findings": "id string, title string, severity string, hosts array<string>, capture_id string",
    "hosts": "ip string, is_private boolean, capture_id string",
    "domains": "domain string, capture_id string",
    "runs": "capture_id string, risk long, band string, created timestamp",
}


def stored(spark: SparkSession, path: str, capture: str | None = None) -> dict[str, DataFrame]:
    """The tables of KEPT of a report folder, of all its captures or of one."""
    out = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in KEPT.items()}
    return {name: df.where(F.col("capture_id") == capture) if capture is not None else df for name, df in out.items()}


def compare_stored(now: dict[str, DataFrame], before: dict[str, DataFrame]) -> DataFrame:
    """(kind, value, state) as ``compare_captures`` gives it, of two reports that ``stored`` read.  Captures that were written to
    a folder several times count once."""
    of = lambda r: _values(r["findings"], r["hosts"], r["domains"])
    return patterns.compare(of(now), of(before), ["kind", "value"])


def compare_summary(now: dict[str, DataFrame], before: dict[str, DataFrame]) -> DataFrame:
    """One row: the risk of both reports (the highest of their captures, each by its latest run; 0 of a report without runs), the
    difference, how many findings, hosts, external hosts and domains are new, how many findings are gone, and a sentence."""

    def risk(r: dict[str, DataFrame], name: str) -> DataFrame:
        return r["runs"].groupBy("capture_id").agg(F.max_by("risk", "created").alias("risk")).agg(F.coalesce(F.max("risk"), F.lit(0)).alias(name))

    n = lambda kind, state: F.count_if((F.col("kind") == kind) & (F.col("state") == state))
    counts = compare_stored(now, before).agg(
        *[n(kind, "new").alias(f"new_{kind}s") for kind in ("finding", "host", "external", "domain")], n("finding", "missing").alias("resolved_findings"), n("host", "missing").alias("missing_hosts")
    )
    rows = counts.crossJoin(risk(now, "risk")).crossJoin(risk(before, "risk_before")).withColumn("risk_delta", F.col("risk") - F.col("risk_before"))
    way = F.when(F.col("risk_delta") > 0, "Risk rose").when(F.col("risk_delta") < 0, "Risk fell").otherwise("Risk is as before")
    said = F.format_string("%s (%d to %d): %d new findings, %d resolved; %d new hosts, %d of them external.", way, F.col("risk_before"), F.col("risk"), F.col("new_findings"), F.col("resolved_findings"), F.col("new_hosts"), F.col("new_externals"))
    return rows.withColumn("summary", said)


def as_csv(df: DataFrame) -> DataFrame:
    """Flat text columns that a spreadsheet shows and doesn't run."""
    flat = [F.array_join(c, "; ").alias(c) if kind.startswith("array<string") else F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    rows = df.select(*flat)
    return rows.select(*[csv_guard(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes])


def csv_tables(t: Tables, findings: DataFrame, indicators: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six tables of a report for spreadsheets: findings, hosts, flows, files, credentials, iocs (``indicators``, where they were made before)."""
    scope = F.when(F.col("is_private"), "internal").otherwise("external")
    version = F.when(F.col("ip").contains(":"), 6).otherwise(4)
    named = t["tls"].where("sni IS NOT NULL").groupBy("capture_id", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.col("dst_port").alias("dport")).agg(F.min("sni").alias("sni"))
    flows = t["flows"].join(named, ["capture_id", "src", "dst", "dport"], "left")
    hosts = t["hosts"].join(host_risks(findings), ["capture_id", "ip"], "left")
    made = {
        "findings": findings.select("capture_id", "severity", "confidence", "category", "title", "count", "id", F.array_join("hosts", " ").alias("hosts"), "first_seen", "last_seen"),
        "hosts": hosts.select("capture_id", "ip", version.alias("ip_version"), F.get("macs", F.lit(0)).alias("mac"), scope.alias("scope"), (F.col("packets_sent") + F.col("packets_received")).alias("packets"), (F.col("bytes_sent") + F.col("bytes_received")).alias("bytes"), F.col("n_peers").alias("peers"), F.array_join(F.transform("ports_served", lambda p: p.cast("string")), " ").alias("ports_served"), F.coalesce("risk", F.lit(0)).alias("risk")),
        "flows": flows.select("capture_id", F.col("src").alias("source"), F.col("dst").alias("destination"), F.col("dport").alias("port"), "protocol", "service", "packets", (F.col("bytes_out") + F.col("bytes_in")).alias("bytes"), "duration", F.coalesce("sni", F.lit("")).alias("sni")),
        "files": t["files"].select("capture_id", F.col("name").alias("filename"), F.col("kind").alias("type"), "size", "md5", "sha256", "entropy", "source", F.col("target").alias("destination"), "protocol", F.array_join("signatures.name", " | ").alias("signatures")),
        "credentials": t["credentials"].select("capture_id", "protocol", "method", "username", "secret", "secret_kind", "client", "server", F.col("server_port").alias("port"), "crackable"),
        "iocs": (iocs(t, findings) if indicators is None else indicators).select("capture_id", F.col("kind").alias("type"), "value", "defanged"),
    }
    return {name: as_csv(df) for name, df in made.items()}


def _uuid(*c: Column | str) -> Column:
    """A UUID (name-based form) of columns."""
    h = F.md5(F.concat_ws("|", *c))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Techniques that rule families stand for, by their public numbers.
TECHNIQUES = {"recon": "T1046", "c2": "T1071", "dns": "T1071.004", "exfil": "T1048", "lateral": "T1021", "tunnel": "T1572", "abuse": "T1496", "spoof": "T1557.002", "anonymity": "T1090.003", "ntlm": "T1550.002", "kerberos": "T1558", "ransomware": "T1486", "malware": "T1105", "file": "T1105", "credentials": "T1040", "cleartext": "T1040", "phishing": "T1566", "web": "T1190"}


def stix(findings: DataFrame, indicators: DataFrame) -> DataFrame:
    """STIX 2.1 objects, one JSON text a row: an indicator for each IOC, a note for each finding."""
    value = F.regexp_replace("value", r"(['\\])", r"\\$1")
    form = F.when(F.col("kind") == "ip", F.when(F.col("value").contains(":"), "ipv6-addr:value").otherwise("ipv4-addr:value")).when(F.col("kind") == "domain", "domain-name:value").when(F.col("kind") == "sha256", "file:hashes.'SHA-256'").otherwise("x-ja3:value")
    pattern = F.concat(F.lit("["), form, F.lit(" = '"), value, F.lit("']"))
    score = F.when(F.col("kind") == "sha256", 70).when(F.col("kind") == "ja3", 40).otherwise(60)
    i = indicators.select("capture_id", F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), _uuid("kind", "value")).alias("id"), F.lit("stix").alias("pattern_type"), pattern.alias("pattern"), score.alias("confidence"))).alias("object"))
    n = findings.select("capture_id", F.to_json(F.struct(F.lit("note").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("note--"), _uuid("capture_id", "id", "title")).alias("id"), F.col("title").alias("abstract"), F.concat_ws(" ", "severity", "category").alias("content"))).alias("object"))
    return i.union(n)


def stix_bundle(findings: DataFrame, indicators: DataFrame, created: str | None = None) -> DataFrame:
    """A STIX 2.1 bundle for each capture, one object a row: who made it, a technique for each kind of finding, indicators, notes,
    and the report that refers to them.  The objects of a bundle are joined by whoever needs one file (``bundle`` has its id)."""
    now = F.lit(created) if created else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    base = lambda kind, *key: [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit(f"{kind}--"), _uuid(F.lit(kind), *key)).alias("id"), now.alias("created"), now.alias("modified")]
    captures_ = findings.select("capture_id").distinct()
    who = captures_.select("capture_id", F.to_json(F.struct(*base("identity", F.lit("wiretide")), F.lit("wiretide").alias("name"), F.lit("system").alias("identity_class"))).alias("object"))
    used = findings.select("capture_id", F.element_at(F.create_map(*[F.lit(x) for kv in TECHNIQUES.items() for x in kv]), F.split("id", r"\.")[0]).alias("technique")).where("technique IS NOT NULL").distinct()
    refs = F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.col("technique").alias("external_id")))
    attack = used.select("capture_id", F.to_json(F.struct(*base("attack-pattern", "technique"), F.col("technique").alias("name"), refs.alias("external_references"))).alias("object"))
    whole = stix(findings, indicators).union(attack).union(who)
    listed = whole.groupBy("capture_id").agg(F.array_sort(F.collect_set(F.get_json_object("object", "$.id"))).alias("object_refs"))
    report_ = listed.select("capture_id", F.to_json(F.struct(*base("report", "capture_id"), F.concat(F.lit("Capture "), "capture_id").alias("name"), now.alias("published"), F.array(F.lit("observed-data")).alias("report_types"), "object_refs")).alias("object"))
    return whole.union(report_).select("capture_id", F.concat(F.lit("bundle--"), _uuid("capture_id")).alias("bundle"), "object")


def misp(findings: DataFrame, indicators: DataFrame) -> DataFrame:
    """MISP attributes and tags, one JSON text a row; low and informational findings are left out."""
    kind = F.when(F.col("kind") == "ip", "ip-dst").when(F.col("kind") == "ja3", "ja3-fingerprint-md5").otherwise(F.col("kind"))
    a = indicators.select("capture_id", F.to_json(F.struct(kind.alias("type"), F.lit("Network activity").alias("category"), F.col("value"), F.lit(True).alias("to_ids"))).alias("attribute"))
    f = findings.where(F.col("severity").isin("critical", "high", "medium"))
    return a.union(f.select("capture_id", F.to_json(F.struct(F.lit("comment").alias("type"), F.lit("Other").alias("category"), F.col("title").alias("value"), F.lit(False).alias("to_ids"))).alias("attribute")))


#: MISP's threat levels (1 the highest) by band.
THREAT_LEVELS = {"critical": "1", "high": "1", "elevated": "2", "low": "3", "clean": "4"}


def misp_events(findings: DataFrame, risk: DataFrame) -> DataFrame:
    """The MISP event of each capture as JSON: threat level, state of analysis and tags; its attributes are ``misp``'s rows."""
    used = findings.select("capture_id", F.element_at(F.create_map(*[F.lit(x) for kv in TECHNIQUES.items() for x in kv]), F.split("id", r"\.")[0]).alias("technique")).where("technique IS NOT NULL")
    tags = used.groupBy("capture_id").agg(F.array_sort(F.collect_set(F.format_string('mitre-attack-pattern:"%s"', "technique"))).alias("tags"))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in THREAT_LEVELS.items() for x in kv]), F.col("band"))
    every = F.concat(F.array(F.format_string('wiretide:risk="%s"', "band")), F.coalesce("tags", F.array().cast("array<string>")))
    event = F.struct(F.concat(F.lit("Capture "), "capture_id").alias("info"), level.alias("threat_level_id"), F.lit("2").alias("analysis"), F.lit("0").alias("distribution"), F.transform(every, lambda x: F.struct(x.alias("name"))).alias("Tag"))
    return risk.join(tags, "capture_id", "left").select("capture_id", F.to_json(F.struct(event.alias("Event"))).alias("event"))


#: Objects of one part of a document.
PER_PART = 1000


def _listed(rows: DataFrame, rank: int, per: int) -> DataFrame:
    """(capture_id, text) -> parts of texts, each behind a comma.  A part is a row, so a list may be of any length."""
    n = rows.groupBy("capture_id").agg(F.count("*").alias("n"))
    dealt = rows.join(n, "capture_id").withColumn("part", F.pmod(F.xxhash64("text"), F.expr(f"n div {per} + 1")))
    joined = F.concat(F.lit(","), F.array_join(F.array_sort(F.collect_list("text")), ",\n"))
    return dealt.groupBy("capture_id", "part").agg(joined.alias("text")).select("capture_id", F.lit(rank).alias("rank"), "part", "text")


def _one(rows: DataFrame, rank: int, text: Column) -> DataFrame:
    return rows.select("capture_id", F.lit(rank).alias("rank"), F.lit(0).cast("long").alias("part"), text.alias("text"))


def stix_documents(findings: DataFrame, indicators: DataFrame, created: str | None = None, per: int = PER_PART) -> DataFrame:
    """(capture_id, rank, part, text): the texts of a capture, in order of rank and part, are one STIX 2.1 bundle.  The objects that
    its report refers to are listed in parts too, so no row grows with the capture."""
    objects = stix_bundle(findings, indicators, created)
    kind, id_ = F.get_json_object("object", "$.type"), F.get_json_object("object", "$.id")
    first, report_ = objects.where(kind == "identity"), objects.where(kind == "report")
    rest = objects.where(~kind.isin("identity", "report"))
    # the report's own list is made anew from the rows
    head = F.regexp_extract("object", r'(?s)^(.*"object_refs":\[)', 1)
    return (
        _one(first, 0, F.concat(F.lit('{"type":"bundle","id":"'), "bundle", F.lit('","objects":['), "object"))
        .union(_listed(rest.select("capture_id", F.col("object").alias("text")), 1, per))
        .union(_one(report_.join(first.select("capture_id", id_.alias("who")), "capture_id"), 2, F.concat(F.lit(","), head, F.lit('"'), "who", F.lit('"'))))
        .union(_listed(rest.select("capture_id", F.concat(F.lit('"'), id_, F.lit('"')).alias("text")), 3, per))
        .union(_one(first, 4, F.lit("]}]}")))
    )


def misp_documents(findings: DataFrame, indicators: DataFrame, risk: DataFrame, per: int = PER_PART) -> DataFrame:
    """(capture_id, rank, part, text): the texts of a capture, in order, are one MISP event with its attributes; the first one
    tells the capture's risk."""
    events = misp_events(findings, risk).join(risk, "capture_id")
    said = F.to_json(F.struct(F.lit("comment").alias("type"), F.lit("Other").alias("category"), F.format_string("Risk %d of 100 (%s)", F.col("risk").cast("long"), "band").alias("value"), F.lit(False).alias("to_ids")))
    head = F.regexp_replace("event", r"\}\}$", "")
    return (
        _one(events, 0, F.concat(head, F.lit(',"Attribute":['), said))
        .union(_listed(misp(findings, indicators).select("capture_id", F.col("attribute").alias("text")), 1, per))
        .union(_one(events, 2, F.lit("]}}")))
    )


def write_documents(parts: DataFrame, path: str) -> None:
    """One file for each capture, in a folder of its own: its parts in order, which stream past the task that writes them."""
    parts.repartition("capture_id").sortWithinPartitions("capture_id", "rank", "part").select("capture_id", "text").write.mode("append").partitionBy("capture_id").text(path)


def verdict(risk: DataFrame, findings: DataFrame) -> DataFrame:
    """A sentence for each capture by its band; from "high" up with the number of grave findings behind it."""
    n = findings.groupBy("capture_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    grave = F.format_string("%d critical and %d high findings", F.coalesce("critical", F.lit(0)), F.coalesce("high", F.lit(0)))
    band = F.col("band")
    said = F.when(band == "clean", "Nothing malicious was found; the traffic looks like routine.").when(band == "low", "Routine traffic with small faults; nothing says that a host is compromised.")
    said = said.when(band == "elevated", "Suspicious traffic that an analyst should see; no single proof of a compromise.")
    said = said.when(band == "high", F.concat(F.lit("Strong signs of malice ("), grave, F.lit("): examine the hosts named."))).otherwise(F.concat(F.lit("A compromise is likely ("), grave, F.lit("): treat the hosts named as suspect and respond to an incident.")))
    return risk.join(n, "capture_id", "left").select("capture_id", "risk", "band", said.alias("verdict"))


def html(t: Tables, findings: DataFrame, hosts: int = 120) -> str:
    """A page of one report: verdicts, findings and the ``hosts`` riskiest hosts, all text escaped.  Only what the page shows
    comes to the driver."""
    from html import escape

    def rows(df: DataFrame, cols: list[str], n: int) -> str:
        head = "".join(f"<th>{escape(c)}</th>" for c in cols)
        body = "".join("<tr>" + "".join(f"<td>{escape(str('' if r[c] is None else r[c]))}</td>" for c in cols) + "</tr>" for r in df.select(*cols).limit(n).collect())
        return f"<table><tr>{head}</tr>{body}</table>"

    rank = rank_of(F.col("severity"))
    parts = [
        "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Capture report</title></head><body><h1>Capture report</h1>",
        *[f"<p>{escape(r.capture_id)} <meter min='0' max='100' low='25' high='50' value='{r.risk}'>{r.risk}</meter></p>" for r in capture_risk(findings).orderBy("capture_id").limit(100).collect()],
        rows(verdict(capture_risk(findings), findings).orderBy("capture_id"), ["capture_id", "verdict"], 100),
        "<h2>Findings</h2>", rows(findings.orderBy(rank.desc(), F.col("count").desc(), "id"), ["severity", "id", "title", "count", "hosts"], 500),
        "<h2>Files</h2>", rows(t["files"].orderBy(F.size("signatures").desc(), F.col("size").desc()).withColumn("signs", F.array_join("signatures.name", ", ")), ["name", "kind", "size", "sha256", "source", "target", "signs"], 200),
        "<h2>Credentials</h2>", rows(t["credentials"].orderBy("protocol", "username"), ["protocol", "method", "username", "secret_kind", "client", "server"], 200),
        "<h2>Protocols</h2>", rows(t["protocol_counts"].orderBy(F.col("packets").desc(), "name"), ["name", "packets", "bytes"], 50),
        "<h2>Hosts</h2>", rows(top_hosts(t, findings, hosts).orderBy(F.col("risk").desc(), F.col("bytes").desc()), ["ip", "risk", "bytes", "n_peers"], hosts), "</body></html>",
    ]
    return "".join(parts)


def write(t: Tables, findings: DataFrame, path: str, with_bodies: bool = False) -> None:
    """Findings, statistics and fact tables as Parquet by capture, findings as compressed JSON, six tables as CSV, STIX and MISP objects as
    JSON lines; with ``with_bodies`` also the carved files' contents, each once, by SHA-256.  Tables that weren't stored are written once first."""
    if getattr(t, "makers", None) and t.store is None:
        t = type(t)(t.makers, written)
    risk = capture_risk(findings)
    findings.write.mode("append").partitionBy("capture_id").parquet(f"{path}/findings")
    for name in ("hosts", "flows", "timeline"):
        t[name].write.mode("append").partitionBy("capture_id").parquet(f"{path}/{name}")
    for name in ("profile", "files", "stream_summaries", "smb_summary", "protocol_counts"):
        t[name].write.mode("append").parquet(f"{path}/{name}")
    domains(t["dns"]).write.mode("append").partitionBy("capture_id").parquet(f"{path}/domains")
    facts.statistics(t, findings).write.mode("append").parquet(f"{path}/statistics")
    findings.write.mode("append").option("compression", "gzip").json(f"{path}/json")
    found = written(iocs(t, findings), "indicators")
    for name, df in csv_tables(t, findings, found).items():
        df.write.mode("append").option("header", True).csv(f"{path}/csv/{name}")
    stix_bundle(findings, found).select("object").write.mode("append").text(f"{path}/stix")
    write_documents(stix_documents(findings, found), f"{path}/stix_bundles")
    write_documents(misp_documents(findings, found, risk), f"{path}/misp_events")
    misp(findings, found).select("attribute").write.mode("append").text(f"{path}/misp/attributes")
    misp_events(findings, risk).select("event").write.mode("append").text(f"{path}/misp/events")
    if with_bodies:
        reassembly.bodies(t["carved"]).write.mode("append").parquet(f"{path}/bodies")
    risk.withColumn("created", F.current_timestamp()).write.mode("append").parquet(f"{path}/runs")


def history(spark, path: str, n: int = 200) -> DataFrame:
    """The latest ``n`` runs of a report folder."""
    return spark.read.parquet(f"{path}/runs").orderBy(F.col("created").desc()).limit(n)
