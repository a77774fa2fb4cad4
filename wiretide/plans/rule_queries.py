"""Every detection on tables made of the driver's events, beside SQL that says what it finds.

A made table is one SELECT that Spark and DuckDB read alike; columns that are arrays are put together in Spark only.  The
SQL of a rule selects its events (capture, id, title, rank, host, evidence, times), which one template folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import bounds
from . import rules
from .tables import sql_domain, sql_entropy, values

CAP = "CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS capture_id"
TS = "CAST(1700000000 + event_id AS DOUBLE)"
WHO = f"{CAP}, {TS} AS ts, event_id AS number, concat('10.0.0.', user_id % 6) AS src_ip, concat('10.0.1.', event_id % 9) AS dst_ip"
CLIENT = "concat('10.0.0.', user_id % 6)"


def case(column: str, *options: object, otherwise: object) -> str:
    """CASE over column % the number that stands last among the options' keys."""
    show = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {show(x)}" for i, x in enumerate(options)) + f" ELSE {otherwise} END"


#: One sample for each web attack pattern, in their order, then a log-in, programs, and a plain page.
SAMPLES = (
    "/a?q=1 union select 2", "/a?x=1 or 1=1", "/a?x=sleep(5)", "/a?t=information_schema", "/a?x=1; drop x", "/a?x=<script >", "/a?x onload=y", "/a?x=javascript:y", "/../../x", "/etc/passwd", "/php://input", "/a?x=;cat y", "/a?x=$(y)",
    "JNDI", "/{{ config }}", "/a?url=http://127.0.0.1", "/rO0AB", "/c99.php", "/<!ENTITY x SYSTEM", "/a?$where", "/login?user=a&password=b", "/get/tool.exe", "/get/mod.dll?v=2",
)
URI = case("event_id % 29", *SAMPLES, otherwise="'/index.html'").replace("'JNDI'", "concat('/$', '{jndi:ldap')")

MADE: dict[str, str] = {
    "flows": f"""SELECT {CAP}, event_id AS number, {CLIENT} AS src, 20000 + event_id AS sport,
  CASE event_id % 7 WHEN 0 THEN '128.31.0.39' WHEN 1 THEN concat('185.220.101.', user_id % 9) WHEN 2 THEN concat('10.0.9.', event_id % 60) WHEN 3 THEN concat('10.1.1.', event_id % 60) ELSE concat('45.77.', event_id % 5, '.', user_id % 200) END AS dst,
  CAST({case("event_id % 26", 443, 80, 21, 23, 25, 110, 143, 161, 389, 22, 135, 445, 3389, 5985, 3333, 14444, 9001, 1194, 51820, 500, otherwise="40000 + event_id % 500")} AS BIGINT) AS dport,
  CAST(CASE WHEN event_id % 5 = 0 THEN 17 ELSE 6 END AS BIGINT) AS protocol, event_id % 60 AS packets, CASE WHEN event_id % 11 = 0 THEN 6000000 + event_id ELSE event_id % 1000 END AS bytes_out,
  (event_id % 3) * 1000000 AS bytes_in, CAST(1 AS BIGINT) AS syns, CAST(CASE WHEN user_id % 6 = 1 AND event_id % 17 > 0 THEN 0 ELSE 1 END AS BIGINT) AS synacks, {TS} AS first_seen, {TS} + event_id % 50 AS last_seen, true AS src_private, event_id % 7 IN (2, 3) AS dst_private FROM events""",
    "connection_events": """SELECT 'a' AS capture_id, concat('10.0.1.', event_id % 5) AS src, CASE WHEN event_id % 5 < 3 THEN concat('45.77.9.', event_id % 5) ELSE concat('10.2.2.', event_id % 5) END AS dst, CAST(443 AS BIGINT) AS dport,
  (1700000000 + event_id * 12) * 1000000 + (user_id % 7) * CASE event_id % 5 WHEN 1 THEN 5000000 WHEN 2 THEN 9900000 ELSE 100000 END AS us FROM events""",
    "beat_flows": """SELECT 'a' AS capture_id, concat('10.0.1.', event_id % 5) AS src, CASE WHEN event_id % 5 < 3 THEN concat('45.77.9.', event_id % 5) ELSE concat('10.2.2.', event_id % 5) END AS dst, CAST(443 AS BIGINT) AS dport, CAST(6 AS BIGINT) AS protocol,
  count(*) * 100 AS bytes_out, count(*) * CASE WHEN event_id % 5 = 4 THEN 9000 ELSE 0 END AS bytes_in, event_id % 5 >= 3 AS dst_private FROM events GROUP BY event_id % 5""",
    "dns": f"""SELECT {CAP}, {TS} AS ts, event_id AS number, CASE WHEN event_id % 4 IN (1, 3) THEN '8.8.8.8' ELSE {CLIENT} END AS src_ip, CASE WHEN event_id % 4 IN (1, 3) THEN {CLIENT} ELSE '8.8.8.8' END AS dst_ip, event_id % 4 IN (1, 3) AS is_response,
  CAST(CASE WHEN user_id % 6 = 2 THEN 3 ELSE 0 END AS BIGINT) AS rcode, CASE event_type WHEN 'error' THEN concat(left(md5(CAST(event_id AS STRING)), 30), '.t', user_id % 3, '.evil.com')
  WHEN 'click' THEN concat(substr('bcdfghjklmnpqrstvwxzbcdfghjklmnpqrstvwxz', CAST(1 + event_id % 20 AS INT), 14), '.com') WHEN 'view' THEN CASE event_id % 5 WHEN 0 THEN 'www.paypa1.com' WHEN 1 THEN 'gooogle.com' WHEN 2 THEN 'paypal.com' ELSE 'login.netfIix.com' END
  ELSE concat('www.shop', user_id % 5, '.example.co.uk') END AS qname, CASE WHEN event_id % 3 = 0 THEN 'TXT' ELSE 'A' END AS qtype FROM events""",
    "http_requests": f"""SELECT {WHO}, CAST(CASE WHEN event_id % 10 = 0 THEN 443 ELSE 80 END AS BIGINT) AS dst_port, 'GET' AS method, CASE WHEN event_id % 6 = 0 THEN concat('45.77.1.', user_id % 9) WHEN event_id % 6 = 1 THEN 'micros0ft.com' ELSE 'shop.example' END AS host, {URI} AS uri,
  CASE WHEN event_id % 31 = 5 THEN 'x=1&token=abc' ELSE '' END AS body, CASE WHEN event_id % 50 = 0 THEN 'sqlmap/1.0' WHEN event_id % 499 = 3 THEN concat('rare-', event_id) ELSE concat('Mozilla/', event_id % 5) END AS user_agent, CAST(NULL AS STRING) AS referer, CAST(NULL AS STRING) AS cookie,
  CASE event_id % 20 WHEN 3 THEN 'Basic dTpw' WHEN 4 THEN 'Bearer abcdef' ELSE NULL END AS auth FROM events""",
    "http_responses": f"""SELECT {CAP}, {TS} AS ts, event_id + 1 AS number, concat('10.0.1.', event_id % 9) AS src_ip, {CLIENT} AS dst_ip, CAST(CASE WHEN user_id % 6 < 3 AND event_id % 4 > 0 THEN 404 ELSE 200 END AS BIGINT) AS status,
  CASE event_id % 9 WHEN 0 THEN 'MZabc' WHEN 1 THEN 'made by INetSim' ELSE 'ok' END AS body, CASE WHEN event_id % 2 = 0 THEN 'image/png' ELSE 'application/octet-stream' END AS content_type, 'x' AS server FROM events""",
    "tls": f"""SELECT {WHO}, CAST({case("event_id % 3", 443, 8443, otherwise=4433)} AS BIGINT) AS dst_port, CASE WHEN event_id % 499 = 7 THEN md5(CAST(event_id AS STRING)) ELSE md5(CAST(event_id % 8 AS STRING)) END AS ja3,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'amaz0n.com' ELSE concat('h', event_id % 9, '.example.com') END AS sni, {case("event_id % 5", "SSL 3.0", "TLS 1.0", "TLS 1.1", "TLS 1.2", otherwise="'TLS 1.3'")} AS version FROM events""",
    "quic_hellos": f"SELECT {WHO}, CASE WHEN event_id % 2 = 0 THEN 'www.faceb0ok.com' ELSE 'quic.example' END AS sni FROM events",
    "certificates": f"SELECT {WHO}, event_id % 3 = 0 AS self_signed, concat('cn', user_id % 8) AS subject_cn FROM events",
    "icmp": f"SELECT {WHO}, CAST({case('event_id % 4', 8, 0, 134, otherwise=3)} AS BIGINT) AS type, event_id % 300 AS payload_len, 5.0 + CAST(event_id % 10 AS DOUBLE) / 8 AS entropy, event_id % 4 = 2 AS is_v6 FROM events",
    "arp": f"SELECT {CAP}, {TS} AS ts, CASE WHEN event_id % 20 = 19 THEN '10.0.0.255' ELSE concat('10.0.0.', event_id % 20) END AS arp_sender_ip, CASE WHEN event_id % 5 = 4 AND user_id % 3 = 0 THEN '02:00:00:00:00:99' ELSE concat('02:00:00:00:00:', event_id % 20) END AS arp_sender_mac FROM events",
    "packets": f"SELECT {WHO}, {case('event_id % 3', '6in4', 'IP-in-IP', otherwise=chr(39) + 'VLAN' + chr(39))} AS enclosing FROM events",
    "ntlm": f"""SELECT {CAP}, {TS} AS ts, event_id AS number, concat('10.0.0.', event_id % 6) AS src_ip, concat('10.0.1.', user_id % 9) AS dst_ip, CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 3 END AS BIGINT) AS message_type, CAST(CASE WHEN event_id % 4 = 0 THEN 24 ELSE 200 END AS BIGINT) AS nt_response_length,
  event_id % 7 = 0 AS anonymous, CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('user', event_id % 11) END AS usr, 'CORP' AS domain FROM events""",
    "kerberos": f"SELECT {WHO}, {case('event_id % 4', 'AS-REQ', 'TGS-REQ', 'AS-REP', otherwise=chr(39) + 'TGS-REP' + chr(39))} AS message_type, CAST(CASE WHEN user_id % 2 = 0 OR event_id % 3 = 0 THEN 23 ELSE 18 END AS BIGINT) AS etype, 'EXAMPLE.COM' AS realm, event_id % 8 = 2 AS weak_etype, concat('p', user_id % 5) AS principals FROM events",
    "smb": f"""SELECT {CAP}, 1700000000 + CAST(event_id AS DOUBLE) / 100 AS ts, event_id AS number, concat('10.0.0.', user_id % 3) AS src_ip, concat('10.0.2.', event_id % 7) AS dst_ip, CASE WHEN event_id % 10 = 0 THEN 'SMB1' ELSE 'SMB2' END AS version,
  {case("event_id % 4", "Write", "Create", "SessionSetup", otherwise="'Read'")} AS command, event_id % 3 = 0 AS signed, event_id % 5 = 4 AS is_response FROM events""",
    "smb_names": f"SELECT {WHO}, CASE WHEN event_id % 50 = 0 THEN concat('Share/Doc', user_id % 9, '.LOCKED') WHEN event_id % 50 = 1 THEN 'HOW_TO_DECRYPT.txt' ELSE concat('doc', event_id, '.docx') END AS filename FROM events",
    "files": f"""SELECT {CAP}, {TS} AS ts, event_id AS number, concat('45.77.1.', user_id % 9) AS source, {CLIENT} AS target, CASE WHEN event_id % 90 = 0 THEN 'read_me.txt' ELSE concat('f', event_id % 50) END AS name, {case("event_id % 5", "HTTP", "FTP-Data", "SMB", "TFTP", otherwise="'FTP'")} AS protocol,
  CASE WHEN event_id % 3 = 0 THEN 'executable' ELSE 'text' END AS category, 'exe' AS kind, md5(CAST(event_id % 700 AS STRING)) AS sha256, event_id % 4000 AS size, {case("event_id % 6", "Reverse shell", "UPX packed", "PDF with embedded JavaScript", otherwise="NULL")} AS sig,
  {case("event_id % 6", "critical", "low", "medium", otherwise="NULL")} AS sig_severity FROM events""",
    "programs": f"SELECT {CAP}, {TS} AS ts, concat('45.77.1.', user_id % 9) AS source, concat('p', event_id % 50) AS name, md5(CAST(event_id % 300 AS STRING)) AS sha256, md5(CAST(event_id % 9 AS STRING)) AS imphash, CAST(event_id % 6 AS INT) AS n_suspicious FROM events",
    "ics": f"SELECT {CAP}, {TS} AS ts, CASE WHEN event_id % 8 = 0 THEN concat('45.32.0.', user_id % 9) ELSE {CLIENT} END AS src_ip, concat('10.0.3.', event_id % 9) AS dst_ip, {case('event_id % 4', 'Modbus', 'S7comm', 'DNP3', otherwise=chr(39) + 'BACnet' + chr(39))} AS protocol, concat('f', event_id % 6) AS function, event_id % 6 = 5 AS dangerous FROM events",
    "mqtt": f"SELECT {WHO}, CASE WHEN event_id % 3 = 0 THEN 'PUBLISH' ELSE 'CONNECT' END AS type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('u', user_id % 4) END AS username, event_id % 4 = 2 AS has_password, concat('c', event_id % 20) AS client_id FROM events",
    "ssdp": f"SELECT {WHO}, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('cam/', event_id % 4) END AS server FROM events",
    "wifi": f"""SELECT {CAP}, {TS} AS ts, event_id AS number, {case("event_id % 5", "beacon", "deauthentication", "disassociation", "probe response", otherwise="'eapol'")} AS subtype, concat('02:00:00:00:01:0', user_id % 4) AS source, concat('02:00:00:00:02:0', event_id % 3) AS destination,
  concat('02:00:00:00:00:0', user_id % 4) AS bssid, event_id % 9 AS reason_code, CASE WHEN event_id % 5 IN (0, 3) THEN concat('net', user_id % 2) ELSE NULL END AS ssid, CASE WHEN user_id % 4 = 2 THEN 'Open' ELSE 'WPA2/WPA3' END AS security, CASE WHEN event_id % 5 = 4 THEN 1 + event_id % 4 ELSE NULL END AS handshake_message FROM events""",
    "quic": f"SELECT {WHO}, event_id % 3 > 0 AS is_initial, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'QUIC v1' END AS version_name, 1 + event_id % 13 AS version, event_id % 13 > 0 AS is_known_version FROM events",
    "credentials": f"""SELECT {CAP}, {TS} AS ts, {CLIENT} AS client, '10.0.0.9' AS server, {case("event_id % 4", "FTP", "NTLM", "POP3", otherwise="'HTTP'")} AS protocol, {case("event_id % 4", "USER/PASS", "NTLM", "APOP", otherwise="'Cookie'")} AS method,
  {case("event_id % 4", "password", "challenge-response", "hash", otherwise="'token'")} AS secret_kind, event_id % 8 IN (1, 2) AS crackable, concat('u', user_id % 9) AS username FROM events""",
    "sip": f"""SELECT {WHO}, event_id % 3 < 2 AS is_request, {case("event_id % 3", "INVITE", "REGISTER", otherwise="'OK'")} AS method, CASE WHEN event_id % 6 = 1 THEN concat('ext', user_id % 3) ELSE '' END AS auth_user, CASE WHEN event_id % 40 = 0 THEN 'friendly-scanner' ELSE 'Phone/1' END AS user_agent,
  CASE WHEN event_id % 30 = 0 THEN 'sip:a@127.0.0.1' ELSE concat('sip:a@10.0.0.', user_id % 6) END AS contact, CASE WHEN event_id % 12 = 0 THEN '172.16.9.9' WHEN event_id % 12 = 6 THEN NULL ELSE {CLIENT} END AS via FROM events""",
    "rtp_streams": f"SELECT {CAP}, {TS} AS first_seen, {TS} + 30 AS last_seen, {CLIENT} AS src_ip, concat('10.0.1.', event_id % 9) AS dst_ip, event_id AS ssrc, 'G.711 u-law' AS codec, event_id % 120 AS packets, CAST(event_id % 25 AS DOUBLE) / 2 AS loss_percent FROM events",
    "call_media": f"SELECT {CAP}, event_id AS ssrc, event_id % 4 = 0 AS srtp FROM events",
    "calls": f"SELECT {CAP}, concat('sip:', user_id % 6, '@x') AS caller, {TS} AS invited, CASE WHEN event_id % 3 = 0 THEN {TS} + 1 ELSE NULL END AS answered, CAST(CASE WHEN event_id % 3 = 0 THEN 200 WHEN user_id % 2 = 0 THEN 404 ELSE 183 END AS BIGINT) AS final_status FROM events",
    "info": "SELECT concat('c', user_id % 20) AS capture_id, count(*) AS packets, CAST(sum(CASE WHEN event_id % 40 < user_id % 20 THEN 1 ELSE 0 END) AS BIGINT) AS truncated_packets, CAST(max(CASE WHEN user_id % 20 > 14 THEN event_id ELSE 0 END) AS BIGINT) AS drops, CAST(min(event_id) AS DOUBLE) AS first_ts, CAST(max(event_id) AS DOUBLE) AS last_ts FROM events GROUP BY user_id % 20",
}


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("wiretide_events")
    df = spark.sql(MADE[name].replace("FROM events", "FROM wiretide_events"))
    c = F.col
    if name == "dns":
        df = df.withColumn("queries", F.array(F.struct(c("qname").alias("name"), c("qtype").alias("type"))))
    elif name == "packets":
        df = df.withColumn("encapsulation", F.array("enclosing"))
    elif name == "ntlm":
        df = df.withColumnRenamed("usr", "user")
    elif name == "http_requests":
        df = df.withColumnRenamed("auth", "authorization")
    elif name == "kerberos":
        df = df.withColumn("etypes", F.array("etype", F.lit(17).cast("long")))
    elif name == "files":
        df = df.withColumn("signatures", F.when(c("sig").isNull(), F.array().cast("array<struct<name:string,severity:string>>")).otherwise(F.array(F.struct(c("sig").alias("name"), c("sig_severity").alias("severity")))))
    elif name == "programs":
        df = df.withColumn("suspicious", F.array_repeat(F.lit("VirtualAlloc"), c("n_suspicious")))
    elif name == "sip":
        df = df.withColumn("via_hosts", F.when(c("via").isNull(), F.array().cast("array<string>")).otherwise(F.array("via")))
    return df


def one_of(column: str, words: tuple) -> str:
    return f"{column} IN ({', '.join(repr(w) if isinstance(w, str) else str(w) for w in words)})"


def in_ranges(ip: str, kind: str) -> str:
    """CASE with the operator of the first range of a kind that holds an address."""
    n = f"(CAST(split_part({ip}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({ip}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({ip}, '.', 3) AS BIGINT) * 256 + CAST(split_part({ip}, '.', 4) AS BIGINT))"
    return "CASE " + " ".join(f"WHEN {n} BETWEEN {bounds(c)[0]} AND {bounds(c)[1]} THEN '{o}'" for c, o, k in fixed.KNOWN_NETWORKS if k == kind) + " END"


def events_of(table: str, where: str, name: str, title: str, rank: str, host: str, evidence: str, first: str = "ts", last: str | None = None, apart: str = "''") -> str:
    return f"SELECT capture_id, {name} AS id, {title} AS title, {rank} AS rank, {host} AS host, concat_ws('|', {evidence}) AS evidence, {first} AS first, {last or first} AS last, {apart} AS apart FROM {table} WHERE {where}"


def of(name: str, title: str, rank: int | str, table: str, where: str, host: str, evidence: str, **more: str) -> str:
    return events_of(table, where, f"'{name}'", f"'{title}'", str(rank), host, evidence, **more)


def group(table: str, keys: str, aggregates: str, having: str, where: str = "true") -> str:
    return f"(SELECT {keys}, {aggregates} FROM {table} WHERE {where} GROUP BY {keys} HAVING {having})"


ENDS = "min(first_seen) AS ts, max(last_seen) AS fin"
TIMES = "min(ts) AS ts, max(ts) AS fin"
WEB = ", ".join(f"CASE WHEN regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}') THEN '{t}' END" for t, _, _, p in fixed.WEB_PATTERNS)
WEIGHTS = values([(t, c, w) for t, c, w, _ in fixed.WEB_PATTERNS])
BEAT_SQL = """(WITH g AS (SELECT *, us - lag(us) OVER (PARTITION BY capture_id, src, dst, dport ORDER BY us) AS gap FROM connection_events),
s AS (SELECT capture_id, src, dst, dport, count(*) AS n_gaps, avg(gap) AS mean, median(gap) AS med, stddev_pop(gap) AS dev FROM g WHERE gap > 0 GROUP BY ALL),
m AS (SELECT capture_id, src, dst, dport, median(abs(gap - med)) AS mad FROM g JOIN s USING (capture_id, src, dst, dport) WHERE gap > 0 GROUP BY ALL),
c AS (SELECT capture_id, src, dst, dport, count(*) AS n_events, min(us) / 1e6 AS ts, max(us) / 1e6 AS fin FROM connection_events GROUP BY ALL),
j AS (SELECT *, dev / mean AS cv, mad / med AS mr, (bytes_out + bytes_in) / n_events AS size FROM s JOIN m USING (capture_id, src, dst, dport) JOIN c USING (capture_id, src, dst, dport) JOIN flows USING (capture_id, src, dst, dport))
SELECT *, NOT dst_private AS outside, CASE WHEN cv < 0.15 THEN 40 WHEN cv < 0.3 THEN 28 ELSE 15 END + CASE WHEN mr < 0.1 THEN 25 WHEN mr < 0.25 THEN 15 ELSE 0 END + CASE WHEN n_gaps >= 40 THEN 20 WHEN n_gaps >= 20 THEN 12 WHEN n_gaps >= 12 THEN 6 ELSE 0 END
  + CASE WHEN size < 2000 THEN 10 ELSE 0 END + CASE WHEN dst_private THEN 0 ELSE 10 END AS score FROM j WHERE n_events >= 8 AND n_gaps >= 7 AND med BETWEEN 900000 AND 86400000000 AND cv <= 0.55 AND mr <= 0.45)"""
ASKED = f"(SELECT *, {sql_domain('qname')} AS domain FROM dns WHERE NOT is_response)"
SUBS = f"(SELECT DISTINCT capture_id, domain, CASE WHEN qname = domain THEN '' ELSE left(qname, len(qname) - len(domain) - 1) END AS sub FROM {ASKED})"
TUNNEL = f"""(WITH p AS (SELECT capture_id, domain, count(*) AS n, avg(len(sub)) AS size, coalesce(avg(CASE WHEN list_max(list_transform(string_split(sub, '.'), lambda x: len(x))) >= 12 THEN {sql_entropy('sub')} END), 0) AS bits FROM {SUBS} GROUP BY ALL HAVING count(*) >= 25),
k AS (SELECT capture_id, domain, avg(CASE WHEN qtype IN ('TXT', 'NULL', 'MX') THEN 1 ELSE 0 END) AS odd, count(*) AS queries, min(ts) AS ts, max(ts) AS fin, min(src_ip) AS client FROM {ASKED} GROUP BY ALL)
SELECT *, CASE WHEN n >= 200 THEN 35 WHEN n >= 80 THEN 25 ELSE 12 END + CASE WHEN size >= 40 THEN 30 WHEN size >= 25 THEN 20 WHEN size >= 18 THEN 10 ELSE 0 END + CASE WHEN bits >= 3.8 THEN 25 WHEN bits >= 3.2 THEN 15 ELSE 0 END + CASE WHEN odd > 0.3 THEN 20 ELSE 0 END AS score
FROM p JOIN k USING (capture_id, domain))"""
RANDOM = f"""(SELECT capture_id, domain, string_split(domain, '.')[1] AS label, min(ts) AS ts, min(src_ip) AS client FROM {ASKED} GROUP BY ALL)"""
BRANDS = values(list(enumerate(fixed.BRANDS)))
LOOK = f"""(WITH s AS (SELECT capture_id, ts, src_ip, qname AS name FROM dns UNION ALL SELECT capture_id, ts, src_ip, host FROM http_requests UNION ALL SELECT capture_id, ts, src_ip, sni FROM tls UNION ALL SELECT capture_id, ts, src_ip, sni FROM quic_hellos),
n AS (SELECT capture_id, lower(name) AS name, array_to_string(string_split(lower(name), '.')[-2:], '.') AS tail, min(ts) AS ts, min(src_ip) AS src_ip FROM s WHERE name IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM (VALUES {BRANDS}) t(i, brand))
SELECT capture_id, name, ts, src_ip, min_by(brand, i) AS brand FROM n, b WHERE tail NOT IN (SELECT brand FROM b) AND levenshtein(tail, brand) BETWEEN 1 AND 2 AND abs(len(tail) - len(brand)) <= 2 GROUP BY ALL)"""
NAMED = "(SELECT capture_id, ts, lower(name) AS name, source FROM files UNION ALL SELECT capture_id, ts, lower(filename), src_ip FROM smb_names)"
RANSOM = " OR ".join([f"contains(name, '{x}')" for x in fixed.RANSOM_NOTES] + [f"name LIKE '%{x}'" for x in fixed.RANSOM_ENDINGS])
VALID = "message_type = 3 AND usr <> ''"

#: Rule -> (tables, least events of a finding, SQL of its events).
CASES: dict[str, tuple[tuple[str, ...], int, str]] = {
    "recon.port_scan": (("flows",), 1, of("recon.port_scan", "Port scan", "CASE WHEN ports >= 100 THEN 3 ELSE 2 END", group("flows", "capture_id, src, dst", f"count(DISTINCT dport) AS ports, {ENDS}", "count(DISTINCT dport) >= 25"), "true", "src", "src, dst, ports", last="fin")),
    "recon.network_sweep": (("flows",), 1, of("recon.network_sweep", "Network sweep", 3, group("flows", "capture_id, src, dport", f"count(DISTINCT dst) AS targets, {ENDS}", "count(DISTINCT dst) >= 20"), "true", "src", "src, dport, targets", last="fin")),
    "recon.syn_unanswered": (("flows",), 1, of("recon.syn_unanswered", "Connections that nobody answers", 2, group("flows", "capture_id, src", "count(*) AS total, count(*) FILTER (synacks = 0) AS hits, min(first_seen) AS ts", "count(*) >= 40 AND count(*) FILTER (synacks = 0) > 0.85 * count(*)", "protocol = 6 AND syns > 0"), "true", "src", "src, total, hits", apart="src")),
    "c2.beacon": (("connection_events", "flows=beat_flows"), 1, of("c2.beacon", "Regular call-backs to an outside host", 4, BEAT_SQL, "score >= 75 AND outside", "src", "src, dst, dport", last="fin")),
    "c2.periodic_traffic": (("connection_events", "flows=beat_flows"), 1, of("c2.periodic_traffic", "Periodic traffic", "CASE WHEN outside THEN 2 ELSE 1 END", BEAT_SQL, "score >= 55 AND NOT (score >= 75 AND outside)", "src", "src, dst, dport", last="fin")),
    "dns.tunneling": (("dns",), 1, of("dns.tunneling", "Data in DNS names", "CASE WHEN score >= 80 THEN 4 ELSE 3 END", TUNNEL, "score >= 55", "client", "domain, client", last="fin")),
    "dns.dga": (("dns",), 1, of("dns.dga", "Many names that don''t exist", 3, "(SELECT capture_id, CASE WHEN is_response THEN dst_ip ELSE src_ip END AS client, count(*) FILTER (is_response AND rcode = 3) AS missing, count(*) FILTER (NOT is_response) AS queries, min(ts) AS ts, max(ts) AS fin FROM dns GROUP BY ALL)", "missing >= 40 AND missing > 0.4 * queries", "client", "client", last="fin")),
    "dns.random_domains": (("dns",), 3, of("dns.random_domains", "Domains of random letters", 2, RANDOM, f"len(label) >= 10 AND {sql_entropy('label')} > 3.6 AND len(regexp_replace(label, '[^aeiou]', '', 'g')) < 0.25 * len(label)", "client", "domain, client")),
    "web.attack": (("http_requests", "http_responses"), 1, f"""SELECT capture_id, concat('web.', kind) AS id, title, CASE WHEN w >= 50 THEN 4 WHEN w >= 40 THEN 3 ELSE 2 END AS rank, src_ip AS host, CAST(number AS VARCHAR) AS evidence, ts AS first, ts AS last, '' AS apart
FROM (SELECT *, unnest(list_filter([{WEB}], lambda v: v IS NOT NULL)) AS title FROM (SELECT *, concat_ws(' ', uri, body, user_agent) AS x FROM http_requests)) JOIN (VALUES {WEIGHTS}) p(title, kind, w) USING (title)"""),
    "web.scanner": (("http_requests",), 1, of("web.scanner", "Scanner''s user agent", 3, "http_requests", "user_agent LIKE 'sqlmap%'", "src_ip", "src_ip, dst_ip, user_agent")),
    "web.dirbust": (("http_responses",), 1, of("web.dirbust", "Search for hidden pages", 2, group("http_responses", "capture_id, dst_ip", "count(*) FILTER (status = 404) AS hits, min(ts) AS ts", "count(*) FILTER (status = 404) >= 50 AND count(*) FILTER (status = 404) > 0.6 * count(*)"), "true", "dst_ip", "dst_ip")),
    "cleartext.service": (("flows",), 1, events_of(f"(SELECT * FROM flows JOIN (VALUES {values(list(fixed.CLEARTEXT_SERVICES.items()))}) s(dport, name) USING (dport))", "name <> 'HTTP' AND packets > 2", "concat('cleartext.', lower(name))", "concat(name, ' in the clear')", "CASE WHEN name IN ('Telnet', 'FTP', 'POP3', 'IMAP') THEN 3 ELSE 2 END", "src", "src, dst, dport, packets", "first_seen", "last_seen")),
    "cleartext.http_credentials": (("http_requests",), 1, of("cleartext.http_credentials", "Credentials over plain HTTP", 4, "(SELECT *, 'Authorization' AS parameter FROM http_requests WHERE lower(auth) LIKE 'basic %' UNION ALL SELECT *, CASE WHEN uri LIKE '%password=%' THEN 'password' ELSE 'token' END FROM http_requests WHERE (uri LIKE '%password=%' OR body LIKE '%token=%') AND dst_port NOT IN (443, 8443))", "true", "src_ip", "src_ip, dst_ip, parameter")),
    "exfil.large_upload": (("flows",), 1, of("exfil.large_upload", "Large upload to an outside host", "CASE WHEN sum(bytes_out) OVER (PARTITION BY capture_id) > 100000000 THEN 3 ELSE 2 END", "flows", "src_private AND NOT dst_private AND bytes_out >= 5000000 AND bytes_out >= 4 * greatest(1, bytes_in)", "src", "src, dst, dport, bytes_out, bytes_in", first="first_seen", last="last_seen")),
    "lateral.service": (("flows",), 1, events_of(f"(SELECT capture_id, name, src, count(DISTINCT dst) AS peers, {ENDS} FROM flows JOIN (VALUES {values(list(fixed.LATERAL_SERVICES.items()))}) s(dport, name) USING (dport) WHERE src_private AND dst_private GROUP BY ALL HAVING count(DISTINCT dst) >= 5)", "true", "concat('lateral.', lower(name))", "concat(name, ' to many inside hosts')", "CASE WHEN peers >= 10 THEN 3 ELSE 2 END", "src", "src, peers", last="fin")),
    "tunnel.icmp": (("icmp",), 10, of("tunnel.icmp", "Data in ICMP echoes", 3, "icmp", "type IN (0, 8, 128, 129) AND payload_len > 100 AND entropy > 5.5", "src_ip", "src_ip, dst_ip, payload_len")),
    "tunnel.tls_nonstandard_port": (("tls",), 1, of("tunnel.tls_nonstandard_port", "TLS on an unusual port", 2, "tls", "sni IS NOT NULL AND dst_port = 4433", "src_ip", "src_ip, dst_ip, dst_port, sni")),
    "abuse.mining": (("flows",), 1, of("abuse.mining", "Traffic to mining pools'' ports", 2, "flows", f"{one_of('dport', fixed.MINING_PORTS)} AND packets > 20", "src", "src, dst, dport, packets", first="first_seen", last="last_seen")),
    "tls.self_signed": (("certificates",), 1, of("tls.self_signed", "Self-signed certificate", 2, "certificates", "self_signed", "src_ip", "src_ip, subject_cn")),
    "tls.rare_fingerprint": (("tls",), 1, of("tls.rare_fingerprint", "Rare TLS client", 1, "(SELECT *, count(*) OVER (PARTITION BY capture_id) AS kinds, sum(n) OVER (PARTITION BY capture_id) AS whole, sum(CASE WHEN n <= 2 THEN n ELSE 0 END) OVER (PARTITION BY capture_id) AS few FROM (SELECT capture_id, ja3, count(*) AS n, min_by(ts, number) AS ts, min_by(src_ip, number) AS src_ip FROM tls GROUP BY ALL))", "n <= 2 AND kinds > 5 AND few < 0.5 * whole", "src_ip", "ja3")),
    "tls.obsolete_version": (("tls",), 1, of("tls.obsolete_version", "Obsolete TLS version", 2, "tls", "version IN ('SSL 3.0', 'TLS 1.0', 'TLS 1.1')", "src_ip", "src_ip, dst_ip, version")),
    "spoof.arp": (("arp",), 1, of("spoof.arp", "One address, several hardware addresses", 3, group("arp", "capture_id, arp_sender_ip", f"count(DISTINCT arp_sender_mac) AS owners, {TIMES}", "count(DISTINCT arp_sender_mac) >= 2", "arp_sender_ip NOT LIKE '%.255'"), "true", "arp_sender_ip", "arp_sender_ip, owners", last="fin")),
    "ipv6.rogue_ra": (("icmp",), 1, of("ipv6.rogue_ra", "Several IPv6 routers announce themselves", 3, group("icmp", "capture_id", "min(src_ip) AS src_ip, min(ts) AS ts, count(DISTINCT src_ip) AS routers", "count(DISTINCT src_ip) > 1", "is_v6 AND type = 134"), "true", "src_ip", "routers")),
    "ipv6.tunnelled": (("packets",), 20, of("ipv6.tunnelled", "IP inside IP", 2, "packets", "enclosing IN ('6in4', 'IP-in-IP')", "src_ip", "src_ip, dst_ip")),
    "infra.ip_literal_http": (("http_requests",), 1, of("infra.ip_literal_http", "HTTP to a bare address", 2, "http_requests", "host LIKE '45.%'", "src_ip", "src_ip, host, uri")),
    "infra.rare_user_agent": (("http_requests",), 1, of("infra.rare_user_agent", "Rare user agent", 1, "(SELECT *, count(*) OVER (PARTITION BY capture_id) AS kinds FROM (SELECT capture_id, user_agent, count(*) AS n, min_by(ts, number) AS ts, min_by(src_ip, number) AS src_ip FROM http_requests GROUP BY ALL))", "kinds > 3 AND n <= 3 AND user_agent NOT LIKE 'sqlmap%'", "src_ip", "user_agent")),
    "malware.executable_download": (("http_requests",), 1, of("malware.executable_download", "Download of a program", 3, "http_requests", "uri IN ('/get/tool.exe', '/get/mod.dll?v=2')", "src_ip", "src_ip, dst_ip, host, uri")),
    "malware.content_type_mismatch": (("http_responses",), 1, of("malware.content_type_mismatch", "A program under another content type", 3, "http_responses", "body LIKE 'MZ%' AND content_type = 'image/png'", "src_ip", "src_ip, dst_ip, content_type")),
    "anonymity.tor": (("flows",), 1, of("anonymity.tor", "Tor", 3, f"(SELECT *, CASE WHEN {one_of('dst', fixed.TOR_AUTHORITIES)} THEN 'directory authority' ELSE coalesce({in_ranges('dst', 'anonymity')}, CASE WHEN {one_of('dport', fixed.TOR_PORTS)} AND packets > 20 THEN 'port' END) END AS why FROM flows)", "NOT dst_private AND why IS NOT NULL", "src", "src, dst, dport, why", first="first_seen", last="last_seen")),
    "anonymity.vpn": (("flows",), 1, of("anonymity.vpn", "VPN", 2, "flows", f"NOT dst_private AND packets > 10 AND {one_of('dport', tuple(fixed.VPN_PORTS))}", "src", "src, dst, dport", first="first_seen", last="last_seen")),
    "ntlm.v1_in_use": (("ntlm",), 1, of("ntlm.v1_in_use", "NTLMv1", 3, "ntlm", "message_type = 3 AND nt_response_length = 24", "src_ip", "src_ip, dst_ip, domain, usr")),
    "ntlm.null_session": (("ntlm",), 1, of("ntlm.null_session", "Null session", 2, "ntlm", "message_type = 3 AND anonymous", "src_ip", "src_ip, dst_ip")),
    "ntlm.credential_spread": (("ntlm",), 1, of("ntlm.credential_spread", "One account on many hosts", 3, group("ntlm", "capture_id, usr", f"min(src_ip) AS who, {TIMES}", "count(DISTINCT dst_ip) >= 6", VALID), "true", "who", "usr", last="fin")),
    "ntlm.password_spraying": (("ntlm",), 1, of("ntlm.password_spraying", "One host tries many accounts", 3, group("ntlm", "capture_id, src_ip", TIMES, "count(DISTINCT usr) >= 8", VALID), "true", "src_ip", "src_ip", last="fin")),
    "kerberos.activity": (("kerberos",), 1, of("kerberos.activity", "Kerberos in use", 0, "kerberos", "true", "src_ip", "message_type, realm")),
    "kerberos.rc4_offered": (("kerberos",), 1, of("kerberos.rc4_offered", "RC4 everywhere in Kerberos", 1, group("kerberos", "capture_id", "count(*) AS n, min(ts) AS ts, min(src_ip) AS src_ip", "min(CASE WHEN etype = 23 THEN 1 ELSE 0 END) = 1"), "true", "src_ip", "n")),
    "kerberos.kerberoasting": (("kerberos",), 1, of("kerberos.kerberoasting", "Service tickets asked for with RC4", "CASE WHEN n >= 5 THEN 3 ELSE 2 END", group("kerberos", "capture_id, src_ip", f"count(*) AS n, {TIMES}", "true", "message_type = 'TGS-REQ' AND etype = 23"), "true", "src_ip", "src_ip", last="fin")),
    "kerberos.asrep_roasting": (("kerberos",), 3, of("kerberos.asrep_roasting", "Weakly encrypted AS replies", 2, "kerberos", "message_type = 'AS-REP' AND weak_etype", "dst_ip", "dst_ip, principals")),
    "smb.v1_in_use": (("smb",), 1, of("smb.v1_in_use", "SMB 1", 3, "smb", "version = 'SMB1'", "src_ip", "src_ip, dst_ip")),
    "smb.unsigned_sessions": (("smb",), 5, of("smb.unsigned_sessions", "Unsigned SMB sessions", 2, "smb", "version = 'SMB2' AND command = 'SessionSetup' AND NOT signed", "src_ip", "src_ip, dst_ip")),
    "ransomware.mass_file_operations": (("smb",), 1, of("ransomware.mass_file_operations", "Mass changes of shared files", 4, group("smb", "capture_id, src_ip", TIMES, "count(*) >= 200 AND count(*) / greatest(max(ts) - min(ts), 1) >= 3 AND count(DISTINCT dst_ip) >= 2", "command IN ('Write', 'Create', 'SetInfo') AND NOT is_response"), "true", "src_ip", "src_ip", last="fin")),
    "ransomware.artefacts": (("files", "smb_names"), 1, of("ransomware.artefacts", "Ransomware''s file names", 4, NAMED, RANSOM, "source", "name, source")),
    "ics.traffic_present": (("ics",), 1, of("ics.traffic_present", "Industrial protocols", 0, "ics", "true", "dst_ip", "protocol, dst_ip")),
    "ics.control_commands": (("ics",), 1, of("ics.control_commands", "Commands that change a process", 3, "ics", "dangerous", "src_ip", "protocol, function, src_ip, dst_ip")),
    "ics.external_access": (("ics",), 1, of("ics.external_access", "Industrial device reached from outside", 4, "ics", "src_ip NOT LIKE '10.%'", "src_ip", "protocol, src_ip, dst_ip")),
    "iot.mqtt_anonymous": (("mqtt",), 1, of("iot.mqtt_anonymous", "MQTT without a user", 3, "mqtt", "type = 'CONNECT' AND username IS NULL", "src_ip", "src_ip, dst_ip, client_id")),
    "iot.mqtt_cleartext_credentials": (("mqtt",), 1, of("iot.mqtt_cleartext_credentials", "MQTT password in the clear", 4, "mqtt", "type = 'CONNECT' AND has_password", "src_ip", "src_ip, dst_ip, username")),
    "iot.device_discovery": (("ssdp",), 1, of("iot.device_discovery", "Devices that announce themselves", 1, group("ssdp", "capture_id, src_ip", "max_by(server, number) AS server, max(ts) AS ts", "true", "server IS NOT NULL"), "true", "src_ip", "src_ip, server")),
    "wifi.deauth_flood": (("wifi",), 20, of("wifi.deauth_flood", "Flood of disconnections", 3, "wifi", "subtype IN ('deauthentication', 'disassociation')", "bssid", "bssid, destination, reason_code")),
    "wifi.evil_twin": (("wifi",), 1, of("wifi.evil_twin", "One network name, several stations", "CASE WHEN kinds > 1 THEN 3 ELSE 2 END", group("wifi", "capture_id, ssid", "count(DISTINCT security) AS kinds, min(bssid) AS bssid, min(ts) AS ts", "count(DISTINCT bssid) > 1", "subtype IN ('beacon', 'probe response') AND ssid <> ''"), "true", "bssid", "ssid")),
    "wifi.handshake_captured": (("wifi",), 1, of("wifi.handshake_captured", "Key exchange captured", 3, group("(SELECT *, concat(least(source, destination), '-', greatest(source, destination)) AS pair FROM wifi)", "capture_id, pair", "min(ts) AS ts, min(bssid) AS bssid", "count(DISTINCT handshake_message) = 2", "handshake_message IN (1, 2)"), "true", "bssid", "pair")),
    "quic.in_use": (("quic",), 1, of("quic.in_use", "QUIC", 1, "quic", "is_initial", "src_ip", "src_ip, dst_ip, version_name")),
    "quic.unknown_version": (("quic",), 1, of("quic.unknown_version", "Unknown QUIC version", 2, "quic", "NOT is_known_version", "src_ip", "src_ip, dst_ip, version")),
    "file.signature": (("files",), 1, events_of("files", "sig IS NOT NULL", "concat('file.signature.', left(replace(lower(sig), ' ', '_'), 40))", "sig", "CASE sig_severity WHEN 'critical' THEN 4 WHEN 'medium' THEN 2 ELSE 1 END", "source", "sha256, size, source, target")),
    "file.executable_transfer": (("files",), 1, of("file.executable_transfer", "A program was transferred", 3, "files", "category = 'executable' AND protocol IN ('HTTP', 'FTP', 'TFTP', 'FTP-Data')", "target", "name, sha256, source, target")),
    "file.suspicious_imports": (("programs",), 1, of("file.suspicious_imports", "A program that reaches into others", 3, "programs", "n_suspicious >= 3", "source", "name, sha256, imphash, n_suspicious")),
    "credentials.cleartext": (("credentials",), 1, of("credentials.cleartext", "Passwords in the clear", 4, "credentials", "secret_kind = 'password'", "client", "protocol, username, client")),
    "credentials.crackable_hashes": (("credentials",), 1, of("credentials.crackable_hashes", "Log-ins that can be guessed offline", 3, "credentials", "secret_kind IN ('hash', 'challenge-response') AND crackable", "client", "protocol, username, client")),
    "credentials.tokens": (("http_requests", "credentials"), 1, of("credentials.tokens", "Access tokens in the clear", 2, "(SELECT capture_id, ts, src_ip AS client, dst_ip AS server, 'Bearer' AS method FROM http_requests WHERE auth LIKE 'Bearer %' AND dst_port NOT IN (443, 8443) UNION ALL SELECT capture_id, ts, client, server, method FROM credentials WHERE secret_kind = 'token')", "true", "client", "client, server, method")),
    "voip.activity": (("sip", "rtp_streams"), 1, of("voip.activity", "Telephony", 0, "(SELECT capture_id, ts, method, src_ip, dst_ip FROM sip UNION ALL SELECT capture_id, first_seen, 'RTP', src_ip, dst_ip FROM rtp_streams)", "true", "src_ip", "method, src_ip, dst_ip")),
    "voip.unencrypted_media": (("rtp_streams", "call_media"), 1, of("voip.unencrypted_media", "Calls in the clear", 3, "rtp_streams r", "packets > 20 AND NOT EXISTS (SELECT 1 FROM call_media c WHERE c.srtp AND c.capture_id = r.capture_id AND c.ssrc = r.ssrc)", "src_ip", "src_ip, dst_ip, codec, packets", first="first_seen", last="last_seen")),
    "voip.registration_attack": (("sip",), 1, of("voip.registration_attack", "Many log-ins for one telephone user", 3, group("sip", "capture_id, src_ip, auth_user", TIMES, "count(*) >= 5", "is_request AND auth_user <> ''"), "true", "src_ip", "src_ip, auth_user", last="fin")),
    "voip.scanner": (("sip",), 1, of("voip.scanner", "SIP scanner", 3, "sip", "user_agent = 'friendly-scanner'", "src_ip", "src_ip, user_agent")),
    "voip.spoofed_invite": (("sip",), 1, of("voip.spoofed_invite", "INVITE from another address than it says", 3, "sip", "is_request AND method = 'INVITE' AND via IS NOT NULL AND (via <> src_ip OR contact LIKE '%@127.%')", "src_ip", "src_ip, via, contact")),
    "voip.enumeration": (("calls",), 1, of("voip.enumeration", "Many calls fail", 2, group("calls", "capture_id", "min(invited) AS ts, min(caller) AS caller", "count(*) FILTER (final_status >= 400) >= 10 AND count(*) FILTER (final_status >= 400) > count(answered)"), "true", "caller", "caller")),
    "voip.media_loss": (("rtp_streams",), 1, of("voip.media_loss", "Lossy media", 1, "rtp_streams", "loss_percent > 5 AND packets > 50", "src_ip", "src_ip, dst_ip, loss_percent", first="first_seen", last="last_seen")),
    "phishing.lookalike_domain": (("dns", "http_requests", "tls", "quic_hellos"), 1, of("phishing.lookalike_domain", "A name close to a known one", 3, LOOK, "true", "src_ip", "name")),
    "environment.simulated": (("http_responses", "files"), 1, of("environment.simulated", "Simulated network", 0, "(SELECT capture_id, ts, src_ip, 'marker' AS why FROM http_responses WHERE body LIKE '%INetSim%' UNION ALL SELECT capture_id, min(ts), min(source), 'same' FROM files GROUP BY capture_id, sha256 HAVING count(*) >= 4 AND count(DISTINCT source) >= 3)", "true", "src_ip", "src_ip, why")),
    "capture.truncated": (("info",), 1, of("capture.truncated", "Packets were cut when captured", 0, "info", "truncated_packets > 0.02 * packets", "CAST(NULL AS VARCHAR)", "packets", first="first_ts", last="last_ts")),
    "capture.drops": (("info",), 1, of("capture.drops", "The capturing host dropped packets", 0, "info", "drops > 0", "CAST(NULL AS VARCHAR)", "packets", first="first_ts", last="last_ts")),
}

RULE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RULE_SQL: dict[str, str] = {}


def _shown(found: DataFrame) -> DataFrame:
    return found.select("capture_id", "id", "title", "severity", "count", F.size("hosts").cast("long").alias("n_hosts"), F.get("hosts", F.lit(0)).alias("first_host"), F.size("evidence").cast("long").alias("n_evidence"), "first_seen", "last_seen")


def _register(name: str, sources: tuple[str, ...], least: int, sql: str) -> None:
    pairs = [(s.split("=")[0], s.split("=")[-1]) for s in sources]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(rules.RULES[name]({t: made(spark, sf_dir, m) for t, m in pairs}))

    key = "rule_" + name.replace(".", "_")
    run.__name__ = key
    run.__doc__ = f"{name} over made tables of all events."
    RULE_QUERIES[key] = run
    tables_ = ", ".join(f"{t} AS ({MADE[m]})" for t, m in pairs)
    RULE_SQL[key] = f"""WITH {tables_}, hits AS ({sql})
SELECT capture_id, id, title, ['info', 'low', 'medium', 'high', 'critical'][max(rank) + 1] AS severity, count(*) AS count, CAST(least({rules.MOST_HOSTS}, count(DISTINCT host)) AS BIGINT) AS n_hosts, min(host) AS first_host,
  CAST(least({rules.MOST_EVIDENCE}, count(DISTINCT evidence)) AS BIGINT) AS n_evidence, CAST(min(first) AS DOUBLE) AS first_seen, CAST(max(last) AS DOUBLE) AS last_seen FROM hits GROUP BY capture_id, id, title, apart HAVING count(*) >= {least}"""


for _name, _case in CASES.items():
    _register(_name, *_case)
