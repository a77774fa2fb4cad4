"""Frames to header columns.

A batch is decoded as a whole: each packet has a place and a layer, and each round takes one header off all packets of
a layer with array operations on the batch's bytes.  Inner headers replace outer ones; what encloses them is listed.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(data: Column, at: Column, size: int) -> Column:
    """Unsigned big-endian number in a binary column, by JVM expressions; null beyond its end."""
    part = F.substring(data, at + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


LONGS = [
    "ethertype", "ip_version", "ttl", "ip_len", "ip_id", "ip_flags", "frag_offset", "dscp", "flow_label", "protocol", "src_port", "dst_port", "tcp_flags",
    "tcp_seq", "tcp_ack", "tcp_window", "icmp_type", "icmp_code", "arp_op", "payload_offset", "tunnel_depth",
]
TEXTS = ["src_mac", "dst_mac", "src_ip", "dst_ip", "arp_sender_mac", "arp_sender_ip", "arp_target_mac", "arp_target_ip", "error"]
FIELDS = (
    [T.StructField(n, T.LongType()) for n in LONGS]
    + [T.StructField(n, T.StringType()) for n in TEXTS]
    + [T.StructField("is_fragment", T.BooleanType()), T.StructField("encapsulation", T.ArrayType(T.StringType())), T.StructField("vlan_ids", T.ArrayType(T.LongType())), T.StructField("mpls_labels", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())]
)
DONE, ETH, TYPE, IP, L4, SLL, SLL2, NULL, PPP, DOT11, RADIOTAP = range(11)
# Link types and how they begin.
LINKS = {1: ETH, 113: SLL, 276: SLL2, 0: NULL, 108: NULL, 9: PPP, 12: IP, 14: IP, 101: IP, 228: IP, 229: IP, 105: DOT11, 127: RADIOTAP}
ROUNDS = 24
DEPTH = 4


class Batch:
    def __init__(self, data: pa.Array, links: np.ndarray):
        self.n = len(data)
        raw = data.fill_null(b"")
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + self.n + 1].astype(np.int64)
        bytes_ = raw.buffers()[2]
        self.buf = np.concatenate((np.frombuffer(bytes_, np.uint8) if bytes_ else np.empty(0, np.uint8), np.zeros(64, np.uint8)))
        self.start, self.end = offsets[:-1].copy(), offsets[1:].copy()
        self.at = self.start.copy()
        self.layer = np.array([LINKS.get(int(x), IP) for x in links], np.int8)
        self.code = np.zeros(self.n, np.int64)  # ethertype or protocol to come
        self.long = {k: np.full(self.n, -1, np.int64) for k in LONGS}
        self.long["tunnel_depth"][:] = 0
        self.text: dict[str, np.ndarray] = {k: np.full(self.n, None, object) for k in TEXTS}
        self.frag = np.zeros(self.n, bool)
        self.more: dict[str, dict[int, list]] = {"encapsulation": {}, "vlan_ids": {}, "mpls_labels": {}}

    def u(self, at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(size):
            out = out << 8 | self.buf[np.minimum(at + i, len(self.buf) - 1)]
        return out

    def need(self, i: np.ndarray, size: int | np.ndarray, what: str) -> np.ndarray:
        """Those of i that have size bytes left; the others end with an error."""
        ok = self.at[i] + size <= self.end[i]
        bad = i[~ok]
        self.text["error"][bad] = f"short {what} header"
        self.layer[bad] = DONE
        return i[ok]

    def note(self, name: str, i: np.ndarray, what) -> None:
        many = what if isinstance(what, np.ndarray) else [what] * len(i)
        for k, w in zip(i.tolist(), many):
            self.more[name].setdefault(k, []).append(int(w) if name != "encapsulation" else w)

    def mac(self, at: np.ndarray) -> np.ndarray:
        v, back = np.unique(self.u(at, 6), return_inverse=True)
        return np.array([":".join(f"{x:012x}"[k : k + 2] for k in range(0, 12, 2)) for x in v.tolist()], object)[back]

    def ip4(self, at: np.ndarray) -> np.ndarray:
        v, back = np.unique(self.u(at, 4), return_inverse=True)
        return np.array([f"{x >> 24}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}" for x in v.tolist()], object)[back]

    def ip6(self, at: np.ndarray) -> np.ndarray:
        return np.array([str(ipaddress.IPv6Address(self.buf[a : a + 16].tobytes())) for a in at.tolist()], object)

    def put(self, i: np.ndarray, **values) -> None:
        for k, v in values.items():
            self.long[k][i] = v

    def go(self, i: np.ndarray, layer: int | np.ndarray, step: int | np.ndarray = 0, code: np.ndarray | int | None = None) -> None:
        self.layer[i] = layer
        self.at[i] += step
        if code is not None:
            self.code[i] = code

    def run(self) -> None:
        steps = {ETH: self.ethernet, TYPE: self.by_type, IP: self.ip, L4: self.transport, SLL: self.cooked, SLL2: self.cooked2, NULL: self.null, PPP: self.ppp, DOT11: self.dot11, RADIOTAP: self.radiotap}
        for _ in range(ROUNDS):
            live = np.unique(self.layer[self.layer != DONE]).tolist()
            if not live:
                return
            for layer in live:
                i = np.flatnonzero(self.layer == layer)
                if len(i):
                    steps[layer](i)
        self.text["error"][self.layer != DONE] = "too many headers"

    # links ------------------------------------------------------------------------------------------------

    def ethernet(self, i: np.ndarray) -> None:
        i = self.need(i, 14, "Ethernet")
        a = self.at[i]
        self.text["dst_mac"][i], self.text["src_mac"][i] = self.mac(a), self.mac(a + 6)
        self.go(i, TYPE, 14, self.u(a + 12, 2))

    def cooked(self, i: np.ndarray) -> None:
        i = self.need(i, 16, "cooked")
        self.text["src_mac"][i] = self.mac(self.at[i] + 6)
        self.go(i, TYPE, 16, self.u(self.at[i] + 14, 2))

    def cooked2(self, i: np.ndarray) -> None:
        i = self.need(i, 20, "cooked")
        self.text["src_mac"][i] = self.mac(self.at[i] + 12)
        self.go(i, TYPE, 20, self.u(self.at[i], 2))

    def null(self, i: np.ndarray) -> None:
        self.go(self.need(i, 4, "loopback"), IP, 4)

    def ppp(self, i: np.ndarray) -> None:
        i = self.need(i, 2, "PPP")
        framed = self.u(self.at[i], 2) == 0xFF03
        self.at[i[framed]] += 2
        kind = self.u(self.at[i], 2)
        self.go(i, np.where((kind == 0x21) | (kind == 0x57), IP, DONE), 2)

    def radiotap(self, i: np.ndarray) -> None:
        i = self.need(i, 4, "radiotap")
        self.go(i, DOT11, self.buf[self.at[i] + 2] + 256 * self.buf[self.at[i] + 3].astype(np.int64))

    def dot11(self, i: np.ndarray) -> None:
        i = self.need(i, 24, "802.11")
        a = self.at[i]
        self.text["dst_mac"][i], self.text["src_mac"][i] = self.mac(a + 4), self.mac(a + 10)
        data = (self.buf[a] >> 2 & 3) == 2
        qos = data & ((self.buf[a] >> 4 & 8) > 0)
        self.note("encapsulation", i, "802.11")
        self.layer[i[~data]] = DONE
        j = i[data]
        self.at[j] += np.where(qos[data], 26, 24)
        snap = self.u(self.at[j], 3) == 0xAAAA03
        self.layer[j[~snap]] = DONE
        j = self.need(j[snap], 8, "LLC")
        self.go(j, TYPE, 8, self.u(self.at[j] + 6, 2))

    # between link and network -----------------------------------------------------------------------------

    def by_type(self, i: np.ndarray) -> None:
        code = self.code[i]
        self.put(i, ethertype=code)
        for kind, f in ((0x8100, self.vlan), (0x88A8, self.vlan), (0x9100, self.vlan), (0x8847, self.mpls), (0x8848, self.mpls), (0x8864, self.pppoe), (0x0806, self.arp)):
            j = i[code == kind]
            if len(j):
                f(j)
        net = (code == 0x0800) | (code == 0x86DD)
        self.layer[i[net]] = IP
        j = i[code == 0x6558]
        self.layer[j] = ETH
        known = np.isin(code, (0x8100, 0x88A8, 0x9100, 0x8847, 0x8848, 0x8864, 0x0806, 0x0800, 0x86DD, 0x6558))
        self.layer[i[~known]] = DONE

    def vlan(self, i: np.ndarray) -> None:
        i = self.need(i, 4, "VLAN")
        self.note("encapsulation", i, "VLAN")
        self.note("vlan_ids", i, self.u(self.at[i], 2) & 0xFFF)
        self.go(i, TYPE, 4, self.u(self.at[i] + 2, 2))

    def mpls(self, i: np.ndarray) -> None:
        i = self.need(i, 4, "MPLS")
        word = self.u(self.at[i], 4)
        self.note("encapsulation", i, "MPLS")
        self.note("mpls_labels", i, word >> 12)
        self.go(i, np.where(word >> 8 & 1, IP, TYPE), 4)

    def pppoe(self, i: np.ndarray) -> None:
        i = self.need(i, 8, "PPPoE")
        self.note("encapsulation", i, "PPPoE")
        self.go(i, PPP, 6)

    def arp(self, i: np.ndarray) -> None:
        i = self.need(i, 28, "ARP")
        a = self.at[i]
        self.put(i, arp_op=self.u(a + 6, 2))
        for name, mac, ip in (("sender", 8, 14), ("target", 18, 24)):
            self.text[f"arp_{name}_mac"][i], self.text[f"arp_{name}_ip"][i] = self.mac(a + mac), self.ip4(a + ip)
        self.go(i, DONE, 28)

    # network ----------------------------------------------------------------------------------------------

    def ip(self, i: np.ndarray) -> None:
        i = self.need(i, 1, "IP")
        version = self.buf[self.at[i]] >> 4
        self.ip_4(i[version == 4])
        self.ip_6(i[version == 6])
        bad = i[(version != 4) & (version != 6)]
        self.text["error"][bad] = "not IP"
        self.layer[bad] = DONE

    def inner(self, i: np.ndarray, what: str) -> np.ndarray:
        """One tunnel deeper; those too deep stop."""
        self.long["tunnel_depth"][i] += 1
        self.note("encapsulation", i, what)
        deep = self.long["tunnel_depth"][i] > DEPTH
        self.text["error"][i[deep]] = "tunnels too deep"
        self.layer[i[deep]] = DONE
        return i[~deep]

    def ip_4(self, i: np.ndarray) -> None:
        i = self.need(i, 20, "IPv4")
        a = self.at[i]
        size, total, frag = (self.buf[a] & 15).astype(np.int64) * 4, self.u(a + 2, 2), self.u(a + 6, 2)
        self.put(i, ip_version=4, dscp=self.buf[a + 1] >> 2, ip_len=total, ip_id=self.u(a + 4, 2), ip_flags=frag >> 13, frag_offset=(frag & 0x1FFF) * 8, ttl=self.buf[a + 8], protocol=self.buf[a + 9])
        self.text["src_ip"][i], self.text["dst_ip"][i] = self.ip4(a + 12), self.ip4(a + 16)
        self.end[i] = np.where(total >= size, np.minimum(self.end[i], a + total), self.end[i])
        part = ((frag & 0x1FFF) > 0) | ((frag >> 13 & 1) > 0)
        self.frag[i] = part
        self.go(i, np.where(part, DONE, L4), np.maximum(size, 20), self.buf[a + 9])

    def ip_6(self, i: np.ndarray) -> None:
        i = self.need(i, 40, "IPv6")
        a = self.at[i]
        word, size = self.u(a, 4), self.u(a + 4, 2)
        self.put(i, ip_version=6, dscp=word >> 22 & 63, flow_label=word & 0xFFFFF, ip_len=size, ttl=self.buf[a + 7], protocol=self.buf[a + 6])
        self.text["src_ip"][i], self.text["dst_ip"][i] = self.ip6(a + 8), self.ip6(a + 24)
        self.end[i] = np.where(size > 0, np.minimum(self.end[i], a + 40 + size), self.end[i])
        self.go(i, L4, 40, self.buf[a + 6])

    # transport --------------------------------------------------------------------------------------------

    def transport(self, i: np.ndarray) -> None:
        code = self.code[i]
        self.put(i, protocol=code)
        for kinds, f in (((0, 43, 60, 51), self.extension), ((44,), self.fragment), ((6,), self.tcp), ((17,), self.udp), ((1,), self.icmp), ((58,), self.icmp), ((4, 41), self.ip_in_ip), ((47,), self.gre)):
            j = i[np.isin(code, kinds)]
            if len(j):
                f(j)
        self.layer[i[~np.isin(code, (0, 43, 60, 51, 44, 6, 17, 1, 58, 4, 41, 47))]] = DONE

    def extension(self, i: np.ndarray) -> None:
        i = self.need(i, 8, "extension")
        n = self.buf[self.at[i] + 1].astype(np.int64)
        self.go(i, L4, np.where(self.code[i] == 51, (n + 2) * 4, (n + 1) * 8), self.buf[self.at[i]])

    def fragment(self, i: np.ndarray) -> None:
        i = self.need(i, 8, "fragment")
        a = self.at[i]
        word = self.u(a + 2, 2)
        self.put(i, protocol=self.buf[a], frag_offset=word & 0xFFF8, ip_flags=word & 1, ip_id=self.u(a + 4, 4))
        self.frag[i] = True
        self.go(i, DONE, 8)

    def tcp(self, i: np.ndarray) -> None:
        i = self.need(i, 20, "TCP")
        a = self.at[i]
        self.put(i, src_port=self.u(a, 2), dst_port=self.u(a + 2, 2), tcp_seq=self.u(a + 4, 4), tcp_ack=self.u(a + 8, 4), tcp_flags=self.buf[a + 13], tcp_window=self.u(a + 14, 2))
        self.go(i, DONE, np.maximum((self.buf[a + 12] >> 4).astype(np.int64) * 4, 20))

    def udp(self, i: np.ndarray) -> None:
        i = self.need(i, 8, "UDP")
        a = self.at[i]
        port = self.u(a + 2, 2)
        self.put(i, src_port=self.u(a, 2), dst_port=port)
        self.go(i, DONE, 8)
        j = i[(port == 4789) & (self.at[i] + 8 + 14 <= self.end[i])]
        self.go(self.inner(j, "VXLAN"), ETH, 8)
        j = i[(port == 6081) & (self.at[i] + 8 <= self.end[i])]
        j = self.inner(j, "Geneve")
        b = self.at[j]
        self.go(j, TYPE, 8 + (self.buf[b] & 63).astype(np.int64) * 4, self.u(b + 2, 2))

    def icmp(self, i: np.ndarray) -> None:
        i = self.need(i, 4, "ICMP")
        a = self.at[i]
        self.put(i, icmp_type=self.buf[a], icmp_code=self.buf[a + 1])
        self.go(i, DONE, np.where(self.code[i] == 1, np.minimum(8, self.end[i] - a), 4))

    def ip_in_ip(self, i: np.ndarray) -> None:
        for code, what in ((4, "IP-in-IP"), (41, "6in4")):
            self.go(self.inner(i[self.code[i] == code], what), IP)

    def gre(self, i: np.ndarray) -> None:
        i = self.inner(self.need(i, 4, "GRE"), "GRE")
        flags, kind = self.u(self.at[i], 2), self.u(self.at[i] + 2, 2)
        size = 4 + 4 * ((flags >> 15 & 1) + (flags >> 13 & 1) + (flags >> 12 & 1))
        span = (kind == 0x88BE) | (kind == 0x22EB)
        self.go(i, np.where(span, ETH, TYPE), size + np.where(kind == 0x88BE, 8, np.where(kind == 0x22EB, 12, 0)), kind)


def decoded(batch: pa.RecordBatch, at: int, link: int) -> list[pa.Array]:
    b = Batch(batch.column(at), batch.column(link).to_numpy(zero_copy_only=False))
    with np.errstate(over="ignore"):
        b.run()
    cut = np.minimum(b.at, b.end)
    b.long["payload_offset"] = cut - b.start
    raw = b.buf.tobytes()
    longs = [pa.array(b.long[k], pa.int64(), mask=b.long[k] < 0) for k in LONGS]
    lists = [pa.array([b.more[k].get(i, []) for i in range(b.n)], pa.list_(pa.string() if k == "encapsulation" else pa.int64())) for k in b.more]
    return [*longs, *(pa.array(b.text[k], pa.string()) for k in TEXTS), pa.array(b.frag), *lists, pa.array([raw[s:e] for s, e in zip(cut.tolist(), b.end.tolist())], pa.binary())]


def decode(packets: DataFrame, keep: tuple[str, ...] = ("capture_id", "number", "ts", "caplen", "wirelen")) -> DataFrame:
    """``keep`` and the header columns of each packet; damage is told in ``error``, never raised."""
    cols = [*keep, "data", "linktype"]
    schema = T.StructType([packets.schema[k] for k in keep] + FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *decoded(b, len(keep), len(keep) + 1)], names=schema.names)

    return packets.select(*cols).mapInArrow(run, schema)
