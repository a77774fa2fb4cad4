"""Files in streams that are longer than a row may be."""

import hashlib
import random

import pytest

from tests import frames as f
from tests.test_carving import DC, ME, WEB, read_reply, stream
from wiretide.operators import long_streams, reassembly
from wiretide.plans import captures
from wiretide.sources import pcap as src

SHA = lambda x: hashlib.sha256(x).hexdigest()


def digest(parts, responses):
    return [(line, d.size, d.sha256.hexdigest()) for line, d in long_streams.http_bodies(iter(parts), responses)]


def chunked(data, step):
    return b"".join(b"%x;x=1\r\n%s\r\n" % (len(data[i : i + step]), data[i : i + step]) for i in range(0, len(data), step)) + b"0\r\n\r\n"


@pytest.mark.parametrize("step", [1, 3, 7, 64, 1000, 10**6])
def test_messages_over_pieces(step):
    rng = random.Random(step)
    body = rng.randbytes(3000)
    down = b"HTTP/1.1 200 OK\r\nContent-Length: 3000\r\n\r\n" + body + b"HTTP/1.1 204 No\r\n\r\nHTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n" + chunked(body, 700) + b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n"
    up = b"GET /a HTTP/1.1\r\nHost: x\r\n\r\nPOST /b HTTP/1.1\r\ncontent-length: 5\r\n\r\nhelloGET /c HTTP/1.1\r\n\r\n"
    for data, responses in ((down + b"HTTP/1.0 200 OK\r\n\r\n" + body, True), (up, False), (down + b"garbage\r\n\r\n", True), (down[:-60], True), (b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\nzz\r\nabc", True), (down[:2000], True)):
        want = [(line, len(b), SHA(b)) for line, b in reassembly.split_http(data, responses)]
        assert digest((data[i : i + step] for i in range(0, len(data), step)), responses) == want


@pytest.mark.parametrize("step", [1, 50, 4096])
def test_smb_over_pieces(step):
    rng = random.Random(step)
    data = rng.randbytes(9000)
    up = f.smb2_create("d\\tool.bin") + b"".join(f.smb2_write(o, data[o : o + 1000]) for o in range(0, 9000, 1000))
    down = b"".join(read_reply(data[o : o + 3000]) for o in range(0, 9000, 3000))
    for stream_, to_server in ((up, True), (down, False)):
        got = list(long_streams.smb_parts((stream_[i : i + step] for i in range(0, len(stream_), step)), to_server))
        names, whole, n = reassembly.smb_transfer(stream_, to_server, 1 << 20, 1 << 20)
        assert [x for x, _, _ in got if x is not None] == names
        assert reassembly.placed({o: d for x, o, d in got if x is None}, 1 << 20, 1 << 20) == whole == data and sum(x is None for x, *_ in got) == n


def test_files_of_long_conversations(spark, tmp_path):
    rng = random.Random(3)
    big, small, wrote = b"%PDF-1.7" + rng.randbytes(12_000_000), b"MZ" + rng.randbytes(5000), b"MZ" + rng.randbytes(7_000_000)
    ask = b"GET /x/big.pdf?a=1 HTTP/1.1\r\nHost: h\r\n\r\nGET /y/small.exe HTTP/1.1\r\nHost: h\r\n\r\n"
    reply = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n%sHTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n%s" % (len(big), big, chunked(small, 900))
    p = [(1, f.tcp4(ME, WEB, 31000, 80, 2, 0))] + stream(2, ME, WEB, 31000, 80, ask)
    p += [(3 + i / 1e6, f.tcp4(WEB, ME, 80, 31000, 24, (4_294_000_000 + i) % (1 << 32), reply[i : i + 4000])) for i in range(0, len(reply), 4000)]  # its sequence numbers wrap
    up = f.smb2_create("share\\new tool.bin") + b"".join(f.smb2_write(o, wrote[o : o + 65_536]) for o in range(0, len(wrote), 65_536))
    p += [(1, f.tcp4(ME, DC, 32000, 445, 2, 0))] + stream(2, ME, DC, 32000, 445, up, 4000)
    short = b"HTTP/1.1 200 OK\r\nContent-Length: 100\r\n\r\n" + b"\x7fELF" + bytes(96)
    p += [(1, f.tcp4(ME, WEB, 33000, 80, 2, 0))] + stream(2, ME, WEB, 33000, 80, b"GET /s.elf HTTP/1.1\r\n\r\n") + stream(3, WEB, ME, 80, 33000, short)
    (tmp_path / "x.pcap").write_bytes(f.pcap(sorted(p, key=lambda x: x[0])))
    t = captures.tables(src.read_captures(spark, str(tmp_path / "x.pcap")), persist=True)
    assert t["long"].count() == 2
    got = {r.sha256: r for r in t["files"].collect()}
    assert set(got) == {SHA(big), SHA(small), SHA(wrote), SHA(short[-100:])}
    a, b, c = got[SHA(big)], got[SHA(small)], got[SHA(wrote)]
    assert (a.name, a.kind, a.size, a.source, a.target, a.protocol) == ("big.pdf", "pdf", len(big), WEB, ME, "HTTP") and a.entropy > 7.9 and a.md5 == hashlib.md5(big).hexdigest()
    assert (b.name, b.kind, b.size) == ("small.exe", "exe", len(small)) and (c.name, c.kind, c.size, c.source, c.protocol) == ("new tool.bin", "exe", len(wrote), ME, "SMB")
    assert {r.sha256 for r in reassembly.bodies(t["carved"]).collect()} == {SHA(short[-100:])}


def test_chunks_against_streams(spark):
    """Overlaps, repeats and holes: the bytes of ``reassembly.streams``, at any size of chunk."""
    rng = random.Random(8)
    data = rng.randbytes(4000)
    parts = [(o, data[o : o + rng.randrange(1, 300)]) for o in range(0, 2500, 90)] + [(o, data[o : o + 100]) for o in (0, 50, 2900, 3000)]
    rows = [("c", off, i, d) for i, (off, d) in enumerate(parts)]
    df = spark.createDataFrame(rows, "k string, off long, number long, data binary")
    want, best = bytearray(), {}
    for off, d in parts:
        if len(d) > len(best.get(off, b"")):
            best[off] = d
    for off in sorted(best):
        if off - len(want) > 500:
            break
        want += bytes(max(0, off - len(want)))
        want += best[off][max(0, len(want) - off) :]
    for chunk in (64, 1000, 1 << 20):
        made = sorted((r.at, bytes(r.data), r.cut) for r in long_streams.chunks(df, ["k"], chunk, 500).collect())
        out = bytearray()
        for at, d, cut in made:
            if at - len(out) > 500:
                break
            out += bytes(max(0, at - len(out))) + d
        assert out == want
