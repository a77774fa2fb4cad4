"""Frames and capture files for tests, built byte by byte."""

from __future__ import annotations

import ipaddress
import struct


def eth(body: bytes, kind: int = 0x0800, src: str = "02:00:00:00:00:01", dst: str = "02:00:00:00:00:02") -> bytes:
    mac = lambda m: bytes.fromhex(m.replace(":", ""))
    return mac(dst) + mac(src) + struct.pack(">H", kind) + body


def ip4(src: str, dst: str, proto: int, body: bytes, ident: int = 1, frag: int = 0, ttl: int = 64) -> bytes:
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), ident, frag, ttl, proto, 0, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + body


def ip6(src: str, dst: str, proto: int, body: bytes) -> bytes:
    return struct.pack(">IHBB16s16s", 6 << 28, len(body), proto, 64, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + body


def tcp(sport: int, dport: int, flags: int, seq: int = 1, body: bytes = b"") -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 8192, 0, 0) + body


def udp(sport: int, dport: int, body: bytes) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def tcp4(src: str, dst: str, sport: int, dport: int, flags: int = 24, seq: int = 1, body: bytes = b"") -> bytes:
    return eth(ip4(src, dst, 6, tcp(sport, dport, flags, seq, body)))


def udp4(src: str, dst: str, sport: int, dport: int, body: bytes) -> bytes:
    return eth(ip4(src, dst, 17, udp(sport, dport, body)))


def question(name: str, kind: int = 1, ident: int = 7) -> bytes:
    return struct.pack(">HHHHHH", ident, 0x0100, 1, 0, 0, 0) + b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0" + struct.pack(">HH", kind, 1)


def answer(name: str, ip: str, rcode: int = 0) -> bytes:
    q = question(name)
    return q[:2] + struct.pack(">HHHHH", 0x8180 | rcode, 1, 0 if rcode else 1, 0, 0) + q[12:] + (b"" if rcode else b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + ipaddress.ip_address(ip).packed)


def hello(sni: str = "www.example.com", versions: tuple = (0x0304, 0x0303)) -> bytes:
    ext = lambda kind, body: struct.pack(">HH", kind, len(body)) + body
    name = sni.encode()
    exts = ext(0x0A0A, b"") + ext(0, struct.pack(">HBH", len(name) + 3, 0, len(name)) + name) + ext(10, struct.pack(">HHH", 4, 29, 23)) + ext(11, b"\x01\x00") + ext(13, struct.pack(">HHH", 4, 0x0403, 0x0804))
    exts += ext(16, struct.pack(">HB", 3, 2) + b"h2") + ext(43, bytes([2 * len(versions)]) + b"".join(struct.pack(">H", v) for v in versions))
    body = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(">HHHH", 6, 0x1A1A, 0x1301, 0xC02F) + b"\x01\0" + struct.pack(">H", len(exts)) + exts
    shake = b"\x01" + len(body).to_bytes(3) + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def smb2(command: int, body: bytes, flags: int = 0) -> bytes:
    m = b"\xfeSMB" + struct.pack("<HHIHHIIQIIQ16s", 64, 0, 0, command, 1, flags, 0, 1, 0, 0, 1, bytes(16)) + body
    return struct.pack(">I", len(m)) + m


def smb2_create(name: str) -> bytes:
    n = name.encode("utf-16-le")
    return smb2(5, struct.pack("<HBBIQQIIIIIHHII", 57, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 120, len(n), 0, 0) + n)


def smb2_write(offset: int, data: bytes) -> bytes:
    return smb2(9, struct.pack("<HHIQ16sIIHHI", 49, 112, len(data), offset, bytes(16), 0, 0, 0, 0, 0) + data)


def ntlm3(user: str, response: int = 24) -> bytes:
    parts, at, blob = b"", 88, b""
    for p in (bytes(24), bytes(response), "DOM".encode("utf-16-le"), user.encode("utf-16-le"), "WS".encode("utf-16-le"), b""):
        parts += struct.pack("<HHI", len(p), len(p), at)
        blob += p
        at += len(p)
    return b"NTLMSSP\0" + struct.pack("<I", 3) + parts + struct.pack("<I", 1) + bytes(24) + blob


def der(tag: int, *parts: bytes) -> bytes:
    b = b"".join(parts)
    return bytes([tag]) + (bytes([len(b)]) if len(b) < 128 else b"\x82" + struct.pack(">H", len(b))) + b


def tgs_req(etypes: tuple = (23,)) -> bytes:
    name = lambda *w: der(0x30, der(0xA0, der(2, b"\x02")), der(0xA1, der(0x30, *[der(27, x.encode()) for x in w])))
    body = der(0x30, der(0xA2, der(27, b"EXAMPLE.COM")), der(0xA3, name("http", "web.example.com")), der(0xA8, der(0x30, *[der(2, bytes([e])) for e in etypes])))
    return der(0x6C, der(0x30, der(0xA1, der(2, b"\x05")), der(0xA2, der(2, b"\x0c")), der(0xA4, body)))


def sip(first: str, via: str, call: str = "c1", cseq: str = "1 INVITE", body: str = "", contact: str = "sip:a@10.0.0.1") -> bytes:
    return f"{first}\r\nVia: SIP/2.0/UDP {via}:5060;branch=z\r\nFrom: <sip:a@ex.com>;tag=1\r\nTo: <sip:b@ex.com>\r\nCall-ID: {call}\r\nCSeq: {cseq}\r\nContact: <{contact}>\r\nUser-Agent: phone\r\n\r\n{body}".encode()


def rtp(seq: int, ssrc: int = 99) -> bytes:
    return struct.pack(">BBHII", 0x80, 0, seq, seq * 160, ssrc) + bytes(160)


def beacon(ssid: str, bssid: bytes, secure: bool) -> bytes:
    tags = bytes([0, len(ssid)]) + ssid.encode() + (bytes.fromhex("30140100000fac040100000fac040100000fac020000") if secure else b"")
    return b"\0\0\x08\0\0\0\0\0" + b"\x80\0\0\0" + b"\xff" * 6 + bssid + bssid + b"\0\0" + bytes(8) + b"\x64\0" + (b"\x11\0" if secure else b"\x01\0") + tags


def deauth(bssid: bytes) -> bytes:
    return b"\0\0\x08\0\0\0\0\0" + b"\xc0\0\0\0" + b"\xff" * 6 + bssid + bssid + b"\0\0" + b"\x07\0"


def eapol(message: int, ap: bytes, station: bytes) -> bytes:
    info = {1: 0x008A, 2: 0x010A, 3: 0x13CA, 4: 0x030A}[message]
    a, b = (station, ap) if message % 2 else (ap, station)
    return b"\0\0\x08\0\0\0\0\0" + b"\x08\x02\0\0" + a + b + ap + b"\0\0" + b"\xaa\xaa\x03\0\0\0\x88\x8e" + b"\x02\x03\0\x5f\x02" + struct.pack(">H", info) + bytes(90)


def pcap(frames: list[tuple[float, bytes]], link: int = 1, order: str = "<", nano: bool = False, snap: int = 65535) -> bytes:
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, snap, link)
    for ts, f in frames:
        cut = f[:snap]
        out += struct.pack(order + "IIII", int(ts), round((ts % 1) * (1e9 if nano else 1e6)), len(cut), len(f)) + cut
    return out


def block(kind: int, body: bytes, order: str = "<") -> bytes:
    body += bytes(-len(body) % 4)
    size = struct.pack(order + "I", 12 + len(body))
    return struct.pack(order + "I", kind) + size + body + size


def pcapng(frames: list[tuple[float, bytes]], link: int = 1, order: str = "<") -> bytes:
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    out += block(1, struct.pack(order + "HHI", link, 0, 65535) + struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0), order)
    for ts, f in frames:
        ticks = round(ts * 1e9)
        out += block(6, struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f, order)
    return out
