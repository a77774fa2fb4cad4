"""Captures read in parts by tasks, and what their heads say."""

import gzip
import random
import struct

from tests import frames as f
from wiretide.plans import captures, rules
from wiretide.sources import pcap as src


def packets(n, seed=1):
    rng = random.Random(seed)
    return [(1_700_000_000 + i / 8, f.udp4("10.0.0.5", "8.8.8.8", 1000 + i, 53, f.question("".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 40))) + ".example"))) for i in range(n)]


def test_files_are_read_in_ranges(spark, tmp_path):
    p = packets(3000)
    big = f.pcapng(p[:1500]) + f.pcapng(p[1500:], 101)  # a second section with another link type
    for name, data in (("a.pcap", f.pcap(p)), ("b.pcap", f.pcap(p, order=">", nano=True)), ("c.pcapng", f.pcapng(p)), ("d.pcapng", big), ("e.gz", gzip.compress(f.pcap(p))), ("small.pcap", f.pcap(p[:3]))):
        (tmp_path / name).write_bytes(data)
    split = 20_000
    df = src.read_captures(spark, str(tmp_path), split).cache()
    want = [(i + 1, round(t, 5), b) for i, (t, b) in enumerate(p)]
    for name in ("a.pcap", "b.pcap", "c.pcapng", "d.pcapng", "e.gz"):
        got = sorted((r.number, round(r.ts, 5), bytes(r.data)) for r in df.where(f"capture_id LIKE '%/{name}'").collect())
        assert got == want, name
    assert {r.linktype for r in df.where("capture_id LIKE '%/d.pcapng' AND number > 1500").select("linktype").distinct().collect()} == {101}
    assert df.where("capture_id LIKE '%/small.pcap'").count() == 3
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    parts = {r.path.rsplit("/", 1)[1]: r["count"] for r in src._ranges(files, split).groupBy("path").count().collect()}
    assert min(parts[n] for n in ("a.pcap", "b.pcap", "c.pcapng", "d.pcapng")) > 5 and parts["e.gz"] == parts["small.pcap"] == 1


def test_bytes_that_look_like_records(spark, tmp_path):
    """A packet that holds a capture: the range that finds records in it is not believed, so the file is read as one."""
    inner = f.pcap(packets(400, 2))
    p = packets(100) + [(1_700_000_100.0, f.udp4("10.0.0.5", "8.8.8.8", 7, 9, inner[:30_000]))] + packets(100, 3)
    (tmp_path / "x.pcap").write_bytes(f.pcap(p))
    got = sorted((r.number, bytes(r.data)) for r in src.read_captures(spark, str(tmp_path), 8_000).collect())
    assert got == [(i + 1, b) for i, (_, b) in enumerate(p)]


def test_probe_and_drops(spark, tmp_path):
    order = "<"
    option = lambda code, body: struct.pack("<HH", code, len(body)) + body + bytes(-len(body) % 4)
    out = f.block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1) + option(3, b"Linux 6") + option(4, b"dumper 1") + option(0, b""), order)
    out += f.block(1, struct.pack("<HHI", 1, 0, 4096) + option(2, b"eth0") + option(0, b""), order)
    for ts, frame in packets(5):
        out += f.block(6, struct.pack("<IIIII", 0, int(ts * 1e6) >> 32, int(ts * 1e6) & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)
    out += f.block(5, struct.pack("<III", 0, 0, 0) + option(5, struct.pack("<Q", 17)) + option(0, b""), order)
    (tmp_path / "p.pcapng").write_bytes(out)
    (tmp_path / "q.pcap.gz").write_bytes(gzip.compress(f.pcap(packets(2), order=">")))
    got = {r.capture_id.rsplit("/", 1)[1]: r for r in src.probe(spark, str(tmp_path)).collect()}
    a, b = got["p.pcapng"], got["q.pcap.gz"]
    assert (a.format, a.byte_order, a.snaplen, a.linktypes, a.interfaces, a.os, a.application, a.drops) == ("pcapng", "little", 4096, [1], ["eth0"], "Linux 6", "dumper 1", 0)
    assert (b.format, b.compression, b.byte_order, b.linktypes) == ("pcap", "gzip", "big", [1])
    t, found = captures.analyse(spark, str(tmp_path))
    assert t["info"].where("drops = 17").count() == 1
    assert [r["count"] for r in rules.RULES["capture.drops"](t).collect()] == [1]
    assert found.where("id = 'capture.drops'").count() == 1
