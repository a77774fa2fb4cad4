"""QUIC, blocklists, exposed credentials, programs, reports on disk."""

import base64
import hashlib
import struct

from pyspark.sql import functions as F

from tests import frames as f
from tests.test_captures import ME, WEB, session, write
from wiretide.operators import credentials, facts, programs, quic, reputation
from wiretide.plans import captures, report, rules
from wiretide.sources import pcap as src


def test_quic_keys():
    k = quic.initial_keys("00000001", bytes.fromhex("8394c8f03e515708"))
    assert k["key"].hex() == "1f369613dd76d5467730efcbe3b1a22d" and k["iv"].hex() == "fa044b2f42a3fd3b46fb255c" and k["hp"].hex() == "9f50449e04a0e810283a1e9933adedd2"


def sealed(spark, version, dcid, plain, pn=2, pn_size=2):
    """An Initial packet, protected with Spark's AES."""
    k = quic.initial_keys(version, dcid)
    first = 0xC0 | (0x10 if version == "6B3343CF" else 0) | (pn_size - 1)
    length = pn_size + len(plain) + 16
    head = bytes([first]) + bytes.fromhex(version) + bytes([len(dcid)]) + dcid + b"\x03abc" + b"\x00" + struct.pack(">H", 0x4000 | length) + pn.to_bytes(pn_size)
    nonce = k["iv"][:-4] + (int.from_bytes(k["iv"][-4:]) ^ pn).to_bytes(4)
    row = spark.range(1).select(F.aes_encrypt(F.lit(plain), F.lit(k["key"]), F.lit("GCM"), F.lit("DEFAULT"), F.lit(nonce), F.lit(head)).alias("c")).first()
    body = bytes(row.c)[12:]
    sample = (pn.to_bytes(pn_size) + body)[4:20]
    mask = bytes(spark.range(1).select(F.aes_encrypt(F.lit(sample), F.lit(k["hp"]), F.lit("ECB"), F.lit("PKCS")).alias("m")).first().m)
    out = bytearray(head)
    out[0] ^= mask[0] & 15
    for i in range(pn_size):
        out[len(head) - pn_size + i] ^= mask[1 + i]
    return bytes(out) + body


def test_quic_hello(spark, tmp_path):
    shake = f.hello("quic.example.com")[5:]
    cut = len(shake) // 2
    frame = lambda off, data: b"\x06" + struct.pack(">H", 0x4000 | off) + struct.pack(">H", 0x4000 | len(data)) + data
    plain = frame(cut, shake[cut:]) + b"\x01" + frame(0, shake[:cut]) + bytes(900)
    p = []
    for i, (version, size) in enumerate((("00000001", 1), ("00000001", 4), ("6B3343CF", 2))):
        p.append((i, f.udp4(ME, WEB, 40000 + i, 443, sealed(spark, version, b"\x01\x02\x03\x04\x05\x06\x07" + bytes([i]), plain, 7, size))))
    broken = bytearray(p[0][1])
    broken[-1] ^= 1
    p.append((9, bytes(broken)))
    write(tmp_path, "q.pcap", f.pcap(p))
    t = captures.tables(src.read_captures(spark, str(tmp_path)))
    got = t["quic_hellos"].collect()
    assert [r.sni for r in got] == ["quic.example.com"] * 3 and all(r.ja4.startswith("q13d") and r.alpn == ["h2"] for r in got)
    assert t["quic"].where("is_initial").count() == 4


def test_reputation(spark, tmp_path):
    path = lambda name, lines: write(tmp_path, name, "\n".join(lines).encode())
    ips = reputation.read_feed(spark, path("ips", ["# list", "45.77.1.1,x", "not-an-ip", "2606:4700::9 y", ""]), "bad", "ip", "lines", "high")
    nets = reputation.read_feed(spark, path("nets", ["; drop", "45.64.0.0/10 ; S1", "1.2.3.4", "9.9.9.9/33x"]), "drop", "ip", "cidr", "critical")
    names = reputation.read_feed(spark, path("names", ["*.Evil.example", "nodots"]), "names", "domain", "lines", "medium")
    urls = reputation.read_feed(spark, path("urls", ["http://u@Mal.example:8080/x", "// c"]), "urls", "url", "lines", "low")
    feeds = ips.union(nets).union(names).union(urls)
    hits = reputation.check_ips(spark.createDataFrame([(x,) for x in ("45.77.1.1", "45.127.255.255", "45.128.0.0", "10.0.0.1", "1.2.3.4", "2606:4700::9")], "ip string"), feeds)
    assert {(r.ip, r.feed, r.detail) for r in hits.collect()} == {("45.77.1.1", "bad", "listed"), ("45.77.1.1", "drop", "within 45.64.0.0/10"), ("45.127.255.255", "drop", "within 45.64.0.0/10"), ("1.2.3.4", "drop", "within 1.2.3.4"), ("2606:4700::9", "bad", "listed")}
    d = reputation.check_domains(spark.createDataFrame([(x,) for x in ("a.b.evil.example.", "evil.example", "mal.example", "example", "ok.example")], "domain string"), feeds)
    assert {(r.domain, r.feed) for r in d.collect()} == {("a.b.evil.example", "names"), ("evil.example", "names"), ("mal.example", "urls")}
    v = {r.ip: r for r in reputation.verdicts(hits, "ip").collect()}
    assert v["45.77.1.1"].worst_severity == "critical" and v["45.77.1.1"].feeds == ["bad", "drop"]
    ctx = spark.createDataFrame([("45.77.1.1", True, True, None), ("8.8.8.8", False, True, "dns.google")], "ip string, proxy boolean, hosting boolean, reverse_dns string")
    s = {r.ip: r.score for r in reputation.scores(hits, ctx).collect()}
    assert s["45.77.1.1"] == 100 and s["8.8.8.8"] == 8 and s["1.2.3.4"] == 55


def test_credentials(spark, tmp_path):
    b64 = lambda s: base64.b64encode(s.encode()).decode()
    talks = [
        (21, "USER ftp1\r\nPASS one!\r\n", "220 hi\r\n"), (110, "USER pop1\r\nPASS two\r\n", "+OK\r\n"), (110, "APOP bob c4c9334bac560ecc979e58001b3e22fb\r\n", "+OK\r\n"), (143, 'a1 LOGIN "im" "three x"\r\n', "* OK\r\n"),
        (25, f"EHLO x\r\nAUTH PLAIN {b64(chr(0) + 'sm' + chr(0) + 'four')}\r\n", "220\r\n"), (587, f"AUTH LOGIN\r\n{b64('lo')}\r\n{b64('five')}\r\n", "334\r\n"), (25, f"AUTH CRAM-MD5\r\n{b64('cr 0123456789abcdef')}\r\n", "334\r\n"),
        (23, "op\r\nsix\r\nls\r\n", "login: password: $ "), (80, f"GET / HTTP/1.1\r\nAuthorization: Basic {b64('wb:se:ven')}\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\n"), (80, "POST /l HTTP/1.1\r\n\r\n&user=fo&x=1&password=ei%21ght", ""),
        (80, 'GET / HTTP/1.1\r\nAuthorization: Digest username="dg", response="00112233445566778899aabbccddeeff"\r\n\r\n', ""), (80, "GET /plain HTTP/1.1\r\n\r\n", ""),
    ]
    p = []
    for i, (port, a, b) in enumerate(talks):
        p += session(100 + i, 41000 + i, "10.0.0.9", port, a.encode(), b.encode())
    write(tmp_path, "c.pcap", f.pcap(p))
    t = captures.tables(src.read_captures(spark, str(tmp_path)))
    got = {(r.protocol, r.method, r.username, r.secret) for r in credentials.exposed(t["streams"], disclose=True).collect()}
    assert got == {
        ("FTP", "USER/PASS", "ftp1", "one!"), ("POP3", "USER/PASS", "pop1", "two"), ("POP3", "APOP", "bob", "c4c9334bac560ecc979e58001b3e22fb"), ("IMAP", "LOGIN", "im", "three x"), ("SMTP", "AUTH PLAIN", "sm", "four"),
        ("SMTP", "AUTH LOGIN", "lo", "five"), ("SMTP", "AUTH CRAM-MD5", "cr", "0123456789abcdef"), ("Telnet", "login", "op", "six"), ("HTTP", "HTTP Basic", "wb", "se:ven"), ("HTTP", "form", "fo", "ei!ght"), ("HTTP", "HTTP Digest", "dg", "00112233445566778899aabbccddeeff"),
    }
    masked = {r.username: r.secret for r in t["credentials"].collect()}
    assert masked["ftp1"] == hashlib.sha256(b"one!").hexdigest()
    found = {r.id: r["count"] for r in rules.detect(t, ["credentials.cleartext", "credentials.crackable_hashes", "credentials.tokens"]).collect()}
    assert found == {"credentials.cleartext": 8, "credentials.crackable_hashes": 3}


def program(names):
    """A small 32-bit program that imports ``names`` from kernel32.dll."""
    base = 0x1000
    table = b"".join(struct.pack("<H", 0) + n.encode() + b"\0" for n in names)
    thunks, at = b"", base + 40 + 4 * (len(names) + 1)
    for n in names:
        thunks += struct.pack("<I", at)
        at += 3 + len(n)
    body = struct.pack("<IIIII", base + 40, 0, 0, at, base + 40) + bytes(20) + thunks + bytes(4) + table + b"KERNEL32.dll\0"
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 12345, 0, 0, 224, 2)
    optional = struct.pack("<H", 0x10B) + bytes(94) + bytes(8) + struct.pack("<II", base, 40) + bytes(112)
    section = b".idata\0\0" + struct.pack("<IIII", len(body), base, len(body), 512) + bytes(16)
    return (head + optional[:224] + section).ljust(512, b"\0") + body


def test_programs(spark):
    names = ["WriteProcessMemory", "CreateRemoteThread", "VirtualAllocEx", "ExitProcess"]
    df = spark.createDataFrame([("x", "HTTP", "a", "b", "t.exe", 1.0, 1, program(names)), ("x", "HTTP", "a", "b", "u.exe", 1.0, 2, b"MZ" + bytes(80))], "capture_id string, protocol string, source string, target string, name string, ts double, number long, data binary")
    got = programs.programs(df).collect()
    assert len(got) == 1 and got[0].machine == "x86" and got[0].compiled == 12345 and got[0].suspicious == names[:3]
    assert got[0].imphash == hashlib.md5(",".join(f"kernel32.{n}" for n in names).lower().encode()).hexdigest()
    assert rules.RULES["file.suspicious_imports"]({"programs": programs.programs(df)}).first().severity == "high"


def test_report_on_disk(spark, tmp_path):
    p = [(100 + i / 10, f.tcp4("10.0.0.66", "10.0.0.10", 50000, 1 + i, 2)) for i in range(60)] + [(200, f.udp4(ME, "8.8.8.8", 4000, 53, f.question("a.example")))]
    write(tmp_path, "r.pcap", f.pcap(p))
    t = captures.tables(src.read_captures(spark, str(tmp_path / "r.pcap")))
    found = captures.settled(rules.detect(t, ["recon.port_scan", "recon.syn_unanswered"]))
    report.write(t, found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/flows")).count() == 61
    assert report.history(spark, str(tmp_path / "out")).first().band in ("low", "medium")
    page = report.html(t, found)
    assert "recon.port_scan" in page and "<script" not in page
    roles = {r.ip: r.role for r in facts.host_roles(t["hosts"]).collect()}
    assert roles["10.0.0.66"] == "client" and roles["8.8.8.8"] == "external"
    vendors = spark.createDataFrame([("AABBCC", "Acme")], "prefix string, vendor string")
    macs = spark.createDataFrame([(m,) for m in ("aa:bb:cc:00:00:01", "02:00:00:00:00:01", "ff:ff:ff:ff:ff:ff", "00:11:22:33:44:55")], "mac string")
    assert {r.mac: r.vendor for r in facts.hardware(macs, vendors).collect()} == {"aa:bb:cc:00:00:01": "Acme", "02:00:00:00:00:01": "Locally administered", "ff:ff:ff:ff:ff:ff": "Broadcast", "00:11:22:33:44:55": None}
    stats = {r.name: r.value for r in facts.statistics(t).collect()}
    assert stats["dns"] == 1 and stats["domains"] == 1
