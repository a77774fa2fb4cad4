"""Captures read in blocks through Spark's text reader: the packets of a local read, whatever the blocks are."""

import bz2
import gzip
import random
import struct

import pytest

from tests import frames as f
from wiretide.sources import blocks
from wiretide.sources import pcap as src


def packets(n, seed=1, most=40):
    rng = random.Random(seed)
    return [(1_700_000_000 + i / 8, f.udp4("10.0.0.5", "8.8.8.8", 1000 + i % 5000, 53, rng.randbytes(rng.randrange(1, most)))) for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "30000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def local(path):
    with open(path, "rb") as file:
        stream = src.unpacked(file)
        return [p for _, p in src.records(stream, src.opened(stream))]


def same(spark, folder):
    df = blocks.read_blocks(spark, str(folder))
    assert df.dtypes == [(c.name, c.dataType.simpleString()) for c in src.SCHEMA]
    got = {}
    for r in df.collect():
        got.setdefault(r.capture_id.rsplit("/", 1)[1], []).append((r.number, r.ts, r.caplen, r.wirelen, r.linktype, bytes(r.data)))
    want = {p.name: local(p) for p in folder.iterdir()}
    assert got.keys() == {k for k, v in want.items() if v}
    for name, rows in got.items():
        rows.sort()
        assert [x[:1] + x[2:] for x in rows] == [x[:1] + x[2:] for x in want[name]], name
        assert [x[1] for x in rows] == pytest.approx([x[1] for x in want[name]], abs=1e-9), name
    ids = {r.capture_id for r in df.select("capture_id").distinct().collect()}
    assert ids <= {r.path for r in spark.read.format("binaryFile").load(str(folder)).select("path").collect()}


def test_formats_and_orders(spark, tmp_path, small_blocks):
    p = packets(3000)
    files = {
        "a.pcap": f.pcap(p), "b c+d%.pcap": f.pcap(p, order=">", nano=True), "c.pcapng": f.pcapng(p), "d.pcapng": f.pcapng(p[:1500]) + f.pcapng(p[1500:], 101), "e.cap": gzip.compress(f.pcap(p)), "g.cap": bz2.compress(f.pcapng(p)),
        "h.pcap": f.pcap(packets(60, 3, 9000)), "small.pcap": f.pcap(p[:3]), "none.pcap": f.pcap([]), "tail.pcap": f.pcap(p[:40])[:-1], "feed.pcap": f.pcap([*p[:40], (1_700_000_100.0, p[0][1] + b"\n")]), "half.pcap": f.pcap(p)[:-7],
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    same(spark, tmp_path)


def test_interfaces_known_from_earlier_blocks(spark, tmp_path, small_blocks):
    out = f.block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1), "<")
    rng = random.Random(2)
    for i in range(4000):
        if i % 900 == 0:
            out += f.block(1, struct.pack("<HHI", 100 + i // 900, 0, 4096) + struct.pack("<HHB3x", 9, 1, [6, 9, 0x94, 3, 6][i // 900]), "<")
        if i == 3000:
            out += f.block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1), "<") + f.block(1, struct.pack("<HHI", 7, 0, 0), "<") + f.block(1, struct.pack("<HHI", 8, 0, 0), "<")
        face = rng.randrange(0, i // 900 + 1) if i < 3000 else rng.randrange(0, 4)
        data = rng.randbytes(20)
        out += f.block(6, struct.pack("<IIIII", face, 400_000, 17 * i, len(data), len(data)) + data, "<") if i % 50 else f.block(3, struct.pack("<I", 20) + data, "<")
    (tmp_path / "i.pcapng").write_bytes(out)
    same(spark, tmp_path)


def test_bytes_that_look_like_records(spark, tmp_path, small_blocks):
    """Packets that hold captures: blocks that begin in them are read again from the place where the one before ends."""
    inner = f.pcap(packets(2000, 2))
    one = lambda s, n: (1_700_000_100.0, f.udp4("10.0.0.5", "8.8.8.8", 7, 9, inner[s : s + n]))
    for k, p in enumerate((packets(100) + [one(0, 45_000)] + packets(100, 3), [one(24 + 100 * i, 50_000) for i in range(8)], packets(300) + [one(100, 60_000), one(30, 60_000)] + packets(900, 5))):
        (tmp_path / f"{k}.pcap").write_bytes(f.pcap(p))
        (tmp_path / f"{k}.pcapng").write_bytes(f.pcapng(p))
    same(spark, tmp_path)


def test_damage_and_other_files_are_told(spark, tmp_path, small_blocks):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pcap").write_bytes(f.pcap(packets(2000)) + struct.pack("<IIII", 1, 1, 0xFFFFFFFF, 5) + bytes(40_000))
    with pytest.raises(src.CaptureError):
        blocks.read_blocks(spark, str(tmp_path / "x"))
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "b.pcap").write_bytes(b"hello\nworld\n" * 9000)
    with pytest.raises(src.CaptureError, match="not a capture"):
        blocks.read_blocks(spark, str(tmp_path / "y"))


def test_a_store_that_only_spark_opens(spark, tmp_path, small_blocks):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.caps.link./in", f"file://{tmp_path}")
    (tmp_path / "a.pcap").write_bytes(f.pcap(packets(2000)))
    got = src.read_captures(spark, "viewfs://caps/in/a.pcap")
    rows = sorted((r.number, bytes(r.data)) for r in got.collect())
    assert rows == [(n, d) for n, *_, d in local(tmp_path / "a.pcap")]
    assert {r.capture_id for r in got.select("capture_id").distinct().collect()} == {"viewfs://caps/in/a.pcap"}


def test_heads_of_files_that_are_not_taken_whole(spark, tmp_path, small_blocks, monkeypatch):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.caps2.link./in", f"file://{tmp_path}")
    (tmp_path / "a.pcap").write_bytes(f.pcap(packets(2000), order=">"))
    (tmp_path / "b.pcapng").write_bytes(f.pcapng(packets(2)))
    monkeypatch.setattr(src, "WHOLE_BYTES", 10_000)
    got = {r.capture_id.rsplit("/", 1)[1]: r for r in src.probe(spark, "viewfs://caps2/in", whole=True).collect()}
    assert (got["a.pcap"].format, got["a.pcap"].byte_order, got["a.pcap"].drops) == ("pcap", "big", None)
    assert (got["b.pcapng"].format, got["b.pcapng"].drops) == ("pcapng", 0)
