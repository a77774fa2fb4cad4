"""Reports that are read back from disk and compared, feeds' states, links."""

import datetime as dt
import shutil

from pyspark.sql import functions as F

from tests import frames as f
from tests.test_captures import ME, write
from wiretide.operators import facts, reputation
from wiretide.plans import captures, report, rules
from wiretide.sources import pcap as src


def analysed(spark, path, name, packets):
    write(path, name, f.pcap(packets))
    t = captures.tables(src.read_captures(spark, str(path / name)), persist=True)
    return t, captures.settled(rules.detect(t, ["recon.port_scan", "recon.syn_unanswered"]))


def test_stored_reports(spark, tmp_path):
    scan = [(100 + i / 10, f.tcp4("10.0.0.66", "10.0.0.10", 50000, 1 + i, 2)) for i in range(60)]
    ask = lambda name, to, at=200: [(at, f.udp4(ME, to, 4000, 53, f.question(name)))]
    quiet, loud = tmp_path / "quiet", tmp_path / "loud"
    before = analysed(spark, tmp_path, "a.pcap", ask("www.a.example", "8.8.8.8"))
    now = analysed(spark, tmp_path, "b.pcap", scan + ask("www.B.example", "9.9.9.9") + ask("www.a.example", "9.9.9.9", 201))
    report.write(*before, str(quiet))
    report.write(*now, str(loud))
    for file in (loud / "hosts").rglob("*.parquet"):  # what is written again counts once
        shutil.copy(file, file.with_name(f"again-{file.name}"))
    a, b = report.stored(spark, str(quiet)), report.stored(spark, str(loud))
    assert a["findings"].count() == 0 and a["hosts"].count() == 2
    got = {(r.kind, r.value, r.state) for r in report.compare_stored(b, a).collect()}
    assert got == {(r.kind, r.value, r.state) for r in report.compare_captures(now, before).collect()}
    assert {("external", "9.9.9.9", "new"), ("external", "8.8.8.8", "missing"), ("domain", "b.example", "new"), ("domain", "a.example", "common"), ("host", "10.0.0.66", "new"), ("host", ME, "common")} <= got
    s = report.compare_summary(b, a).first()
    assert (s.risk_before, s.new_externals, s.new_domains, s.resolved_findings, s.missing_hosts) == (0, 1, 1, 0, 1) and s.new_findings == 2 and s.risk_delta == s.risk > 0 and s.summary.startswith("Risk rose (0 to ")
    back = report.compare_summary(a, b).first()
    assert (back.risk_delta, back.new_findings, back.resolved_findings) == (-s.risk, 0, 2) and back.summary.startswith("Risk fell")
    name = b["runs"].first().capture_id
    assert report.stored(spark, str(loud), name)["hosts"].count() == 8 and report.stored(spark, str(loud), "other")["hosts"].count() == 0
    kept = {r.name: r.value for r in spark.read.parquet(str(loud / "statistics")).distinct().collect()}
    assert (kept["dns"], kept["dns_questions"], kept["domains"], kept["findings"], kept["hosts"]) == (2, 2, 2, 2, 4)
    assert sum(v for k, v in kept.items() if k.startswith("findings_")) == 2
    assert {r.name for r in facts.statistics(before[0]).collect()} == {"hosts", "flows", "dns", "dns_questions", "domains"}


def test_feed_states_and_links(spark):
    at = lambda *x: dt.datetime(2024, 1, *x, tzinfo=dt.timezone.utc)
    listed = spark.createDataFrame([("new", "ip", "high", at(9, 12)), ("old", "domain", "low", at(1)), ("week", "url", "low", at(3)), ("none", "ip", "low", None)], "name string, kind string, severity string, fetched_at timestamp")
    feeds = spark.createDataFrame([("new", "ip", "high", "45.77.1.1", None, None), ("old", "domain", "low", "evil.example", None, None), ("old", "domain", "low", "b.evil.example", None, None), ("week", "url", "medium", "a.b.evil.example", None, None)], "feed string, kind string, severity string, value string, lo long, hi long")
    status = reputation.feed_status(listed, feeds, F.lit(at(10)))
    assert {r.name: (r.entries, r.age_hours, r.cached, r.stale) for r in status.collect()} == {"new": (1, 12.0, True, False), "old": (2, 216.0, True, True), "week": (1, 168.0, True, False), "none": (0, None, False, False)}
    ips = spark.createDataFrame([("45.77.1.1",), ("45.77.1.1",), ("8.8.8.8",), ("10.0.0.1",), (None,)], "ip string")
    names = spark.createDataFrame([("A.B.evil.example.",), ("ok.example",), ("example",), (None,), ("",)], "domain string")
    got = {r.indicator: r for r in reputation.enriched_report(ips, names, feeds, status).collect()}
    assert set(got) == {"45.77.1.1", "a.b.evil.example"}
    assert (got["45.77.1.1"].checked_feeds, got["45.77.1.1"].worst_severity, got["45.77.1.1"].stale_feeds) == (1, "high", ["old"]) and got["45.77.1.1"].sources[0].detail == "listed"
    name = got["a.b.evil.example"]
    assert [(s.feed, s.detail) for s in name.sources] == [("old", "matched b.evil.example"), ("week", "matched a.b.evil.example")] and name.checked_feeds == 2 and name.worst_severity == "medium"
    assert reputation.enriched_report(ips.limit(0), names.limit(0), feeds, status).count() == 0
    links = lambda x, kind: spark.range(1).select(reputation.pivot_links(F.lit(x).cast("string"), F.lit(kind)).alias("l")).first().l
    assert [x.url for x in links("2001:db8::1", "ip")][2] == "https://www.shodan.io/host/2001:db8::1" and len(links("1.1.1.1", "ip")) == 6
    assert links("a b*~+/é_.x-y", "domain")[2].url == "https://crt.sh/?q=a%20b%2A~%2B%2F%C3%A9_.x-y" and links(None, "ip") is None
