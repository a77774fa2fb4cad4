"""Web evidence, SIP digests, fragment accounts, IPv6 ranges."""

import ipaddress
import random

from pyspark.sql import functions as F

from tests import frames as f
from wiretide.functions import columns as C
from wiretide.operators import credentials, reassembly, reputation
from wiretide.plans import captures
from wiretide.sources import pcap as src

ME, WEB = "10.0.0.5", "45.77.1.1"


def tables(spark, tmp_path, packets, name="x.pcap"):
    (tmp_path / name).write_bytes(f.pcap(sorted(packets, key=lambda p: p[0])))
    return captures.tables(src.read_captures(spark, str(tmp_path / name)))


def test_what_matched_and_where(spark, tmp_path):
    asks = [
        (1, b"GET /a%2520b?q=" + b"x" * 90 + b"%2527%20union%20select%20pw HTTP/1.1\r\nHost: h\r\n\r\n"), (3, b"POST /p HTTP/1.1\r\nHost: h\r\nContent-Length: 30\r\n\r\nc=information_schema&rest=tail"),
        (5, b"GET /plain HTTP/1.1\r\nHost: h\r\nUser-Agent: ${jndi:ldap://x/a}\r\n\r\n"),
    ]
    p = [(t, f.tcp4(ME, WEB, 4000, 80, 24, 1, a)) for t, a in asks] + [(2, f.tcp4(WEB, ME, 80, 4000, 24, 1, b"HTTP/1.1 403 No\r\nContent-Length: 0\r\n\r\n"))]
    rows = {r.title: r for r in tables(spark, tmp_path, p)["web_evidence"].collect()}
    union = rows["SQL injection: union select"]
    assert (union.matched.lower(), union.location, union.status, union.number) == ("union select", "URI", 403, 1)
    assert "xxx' union select pw" in union.context and len(union.context) <= 60 * 2 + len("union select")
    assert rows["SQL injection: metadata access"].location == "request body"
    assert [r.location for t, r in rows.items() if "jndi" in r.matched.lower()] == ["header"]


def test_sip_digests(spark, tmp_path):
    ask = 'Digest realm="voip.example", nonce="n0nce", algorithm=MD5, qop="auth"'
    give = 'Digest username="alice", realm="voip.example", nonce="n0nce", uri="sip:voip.example", response="0123456789abcdef0123456789abcdef", algorithm=MD5'
    head = lambda first, line, call="c9": f.sip(first, "10.0.0.5", call, "1 REGISTER").replace(b"User-Agent: phone\r\n", f"User-Agent: phone\r\n{line}\r\n".encode())
    p = [
        (1, f.udp4(ME, WEB, 5060, 5060, f.sip("REGISTER sip:voip.example SIP/2.0", "10.0.0.5", "c9", "1 REGISTER"))), (2, f.udp4(WEB, ME, 5060, 5060, head("SIP/2.0 401 Unauthorized", f"WWW-Authenticate: {ask}"))),
        (3, f.udp4(ME, WEB, 5060, 5060, head("REGISTER sip:voip.example SIP/2.0", f"Authorization: {give}"))),
        (4, f.udp4(ME, WEB, 5060, 5060, head("INVITE sip:b SIP/2.0", 'Proxy-Authorization: Digest username="bob", nonce="other", response=ffff, uri="sip:b"', "c10"))), (5, f.udp4(ME, WEB, 5060, 5060, head("REGISTER sip:x SIP/2.0", 'Authorization: Digest username="", realm="r"', "c11"))),
    ]
    t = tables(spark, tmp_path, p)
    rows = {r.username: r for r in credentials.sip_digests(t["sip"], disclose=True).collect()}
    a, b = rows["alice"], rows["bob"]
    assert (a.realm, a.nonce, a.uri, a.secret, a.challenged, a.challenger, a.client, a.server, a.server_port) == ("voip.example", "n0nce", "sip:voip.example", "0123456789abcdef0123456789abcdef", 2, WEB, ME, WEB, 5060)
    assert (b.secret, b.realm, b.challenged, b.algorithm) == ("ffff", None, None, "MD5") and set(rows) == {"alice", "bob"}
    shown = t["credentials"].where("protocol = 'SIP'").collect()
    assert {r.username for r in shown} == {"alice", "bob"} and all(len(r.secret) == 64 and r.crackable and r.secret_kind == "challenge-response" for r in shown)


def cut(ident, data, t, step=400, places=None):
    parts = [(o, data[o : o + step]) for o in range(0, len(data), step)]
    return [(t, f.eth(f.ip4(ME, WEB, 17, parts[i][1], ident, (parts[i][0] // 8) | (0x2000 if parts[i][0] + step < len(data) else 0)))) for i in (places if places is not None else range(len(parts)))]


def test_fragment_accounts(spark, tmp_path):
    body = f.udp(5000, 53, bytes(2000))
    p = cut(1, body, 1000.0) + cut(2, body, 1000.0, places=[4, 2, 0, 1, 3, 2, 2]) + cut(3, body, 1001.0, places=[0, 2]) + cut(4, body, 1090.0, places=[1])
    p += cut(5, body, 1091.0) + [(1091.5, f.eth(f.ip4(ME, WEB, 17, bytes(200), 5, (200 // 8) | 0x2000)))]  # begins within the first part
    p += [(1092.0, f.eth(f.ip4(ME, WEB, 17, bytes(1400), 6, (o // 8) | 0x2000))) for o in range(0, 65_000, 1000)]
    d = tables(spark, tmp_path, p)["decoded"]
    sets = {r.ip_id: (r.state, r.parts, r.repeated, r.overlapping) for r in reassembly.fragment_sets(d).collect()}
    assert sets == {1: ("whole", 6, 0, 0), 2: ("dropped", 5, 2, 0), 3: ("dropped", 2, 0, 0), 4: ("incomplete", 1, 0, 0), 5: ("whole", 7, 0, 1), 6: ("dropped", 65, 0, 64)}
    s = reassembly.fragment_stats(d).first()
    assert (s.datagrams_reassembled, s.overlapping_fragments) == (2, 2 + 1 + 64) and (s.fragment_sets_incomplete, s.fragment_sets_dropped) == (1, 3)
    assert reassembly.datagrams(d).count() == s.datagrams_reassembled


def test_ipv6_ranges_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    base = [ipaddress.ip_address("2600::") + rng.getrandbits(120) for _ in range(60)]
    nets = [str(ipaddress.ip_network((int(a), bits), strict=False)) for a, bits in zip(base, [0, 1, 13, 32, 33, 47, 48, 63, 64, 65, 100, 127, 128] * 5)][1:]
    ips = [str(a + rng.randrange(5)) for a in base] + [str(ipaddress.ip_network(n).network_address) for n in nets] + [str(ipaddress.ip_network(n).broadcast_address) for n in nets] + ["2a00:1::5", "45.64.1.1"]
    (tmp_path / "nets").write_text("\n".join([*(n.upper() for n in nets), "45.64.0.0/10", "2001:db8::/129", "x::y/3", "2a00:0001:0::5"]))
    feeds = reputation.read_feed(spark, str(tmp_path / "nets"), "drop", "ip", "cidr", "high")
    got = {r.ip: r.detail for r in reputation.check_ips(spark.createDataFrame([(x,) for x in ips], "ip string"), feeds).collect()}
    outside = {r.ip for r in spark.createDataFrame([(x,) for x in ips], "ip string").where(~C.is_private(F.col("ip"))).collect()}
    held = [ipaddress.ip_network(n) for n in nets]
    for ip in set(ips) & outside - {"45.64.1.1", "2a00:1::5"}:
        within = [n for n in held if ipaddress.ip_address(ip) in n]
        best = max((n.prefixlen for n in within), default=None)
        assert (got.get(ip) is None) == (best is None), ip
        assert best is None or (got[ip] == "listed" if best == 128 else got[ip].endswith(f"/{best}")), (ip, got[ip])
    assert got["45.64.1.1"] == "within 45.64.0.0/10" and got["2a00:1::5"] == "listed"
