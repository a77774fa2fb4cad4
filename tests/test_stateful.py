"""State and timers of streams against the batch operators."""

import random

import pytest

from tests import frames as f
from wiretide.operators import intervals, reassembly
from wiretide.operators.decode import decode
from wiretide.sources import pcap as src
from wiretide.streaming import live, stateful

ME, WEB = "10.0.0.5", "45.77.1.1"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stateful.PROVIDER)
    yield
    spark.conf.set(key, before)


def replay(spark, tmp_path, files, made, name):
    """The stream's rows after the files came one after the other, each a micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = []
    q = made(live.stream_packets(spark, str(folder), src.SCHEMA)).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for i, p in enumerate(files):
            (tmp_path / f"{i}.pcap").write_bytes(f.pcap(p))
            df = src.read_captures(spark, str(tmp_path / f"{i}.pcap")).selectExpr("'x' AS capture_id", f"number + {len(rows)} AS number", "ts", "caplen", "wirelen", "linktype", "data")
            rows += df.collect()
            df.coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.createDataFrame(rows, src.SCHEMA), spark.table(name)


def parts(ident, data, t, step=400):
    cut = [(o, data[o : o + step]) for o in range(0, len(data), step)]
    return [(t, f.eth(f.ip4(ME, WEB, 17, d, ident, (o // 8) | (0x2000 if o + step < len(data) else 0)))) for o, d in cut]


def test_fragments_over_batches(spark, tmp_path, rocks):
    body = lambda n: f.udp(5000, 53, bytes(range(256)) * 8)[:n]
    a, b, c = parts(1, body(1500), 1000.0), parts(2, body(1200), 1001.0), parts(3, body(900), 1002.0)
    one = [a[1], b[0], c[2]]
    two = [(1003.0, x) for _, x in (a[0], c[0], c[1])] + [(1004.0, a[3][1])]
    three = [(1005.0, a[2][1]), (1006.0, c[2][1])]  # a is whole; a part of c that was whole comes again
    late = [(1200.0, f.udp4(ME, WEB, 1, 2, b"clock")), (1200.0, parts(9, body(800), 0)[0][1])]
    more = [(1201.0, b[1][1]), (1300.0, parts(8, body(800), 0)[0][1])]
    rows, got = replay(spark, tmp_path, [one, two, three, late, more, [(1500.0, parts(7, body(800), 0)[0][1])], [(1501.0, parts(6, body(800), 0)[0][1])]], stateful.fragments, "fragments")
    got = got.collect()
    whole = {r.ip_id: bytes(r.data) for r in got if r.state == "whole"}
    assert whole == {1: body(1500), 3: body(900)}
    lost = sorted((r.ip_id, r.parts, r.bytes) for r in got if r.state == "lost")
    assert (2, 1, 400) in lost and (3, 1, 100) in lost and (9, 1, 400) in lost
    assert not {7, 6} & {i for i, _, _ in lost}  # their time isn't over
    assert reassembly.datagrams(decode(rows)).count() == 2  # as the batch has it


def test_beacons_are_those_of_the_batch(spark, tmp_path, rocks):
    rng = random.Random(6)
    times = [(1000.0 + 60 * i + rng.random(), WEB) for i in range(40)] + [(1000.0 + 45 * i, "45.77.1.2") for i in range(30)] + [(1500.0, "45.77.1.3")]
    p = [(t, f.tcp4(ME, d, 40000 + i, 443, 2)) for i, (t, d) in enumerate(sorted(times))]
    files = [p[:20], p[20:45][::-1], p[45:], [(9000.0, f.tcp4(ME, "45.77.1.9", 1, 443, 2))], [(9001.0, f.tcp4(ME, "45.77.1.9", 2, 443, 2))]]
    key = ["capture_id", "src", "dst", "dport"]
    rows, got = replay(spark, tmp_path, files, lambda s: stateful.beacon_stats(stateful.openings(s, "1000 seconds"), key, 600), "beacons")
    got = {r.dst: r.asDict() for r in got.collect()}
    want = {r.dst: r.asDict() for r in intervals.interval_stats(stateful.openings(rows).drop("time"), key, "us").collect()}
    assert got.keys() == want.keys() == {WEB, "45.77.1.2"}
    for k, r in want.items():
        assert all(got[k][c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in r.items())
