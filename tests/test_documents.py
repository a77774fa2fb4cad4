"""One STIX bundle and one MISP event a capture, in parts."""

import json
from pathlib import Path

from wiretide.plans import report


def made(spark):
    f = [("c1", "c2.beacon", 'Say "hi"\n', "critical", "high", "C2", ["45.77.0.1"], ["{}"], 1.0, 2.0, 3), ("c1", "dns.tunneling", "Tunnel", "high", "low", "DNS", ["10.0.0.1"], ["{}"], 1.0, 2.0, 3), ("c2", "quic.in_use", "QUIC", "info", "low", "Other", ["10.0.0.1"], ["{}"], 1.0, 2.0, 1)]
    findings = spark.createDataFrame(f, "capture_id string, id string, title string, severity string, confidence string, category string, hosts array<string>, evidence array<string>, first_seen double, last_seen double, count long")
    i = [("c1", "ip", f"45.77.{k // 250}.{k % 250}") for k in range(700)] + [("c1", "domain", f"d{k}.example") for k in range(300)] + [("c2", "sha256", "ab" * 32)]
    return findings, spark.createDataFrame(i, "capture_id string, kind string, value string")


def whole(parts):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: (r.capture_id, r.rank, r.part)):
        out[r.capture_id] = out.get(r.capture_id, "") + r.text + "\n"
    return {k: json.loads(v) for k, v in out.items()}


def test_bundles(spark, tmp_path):
    findings, indicators = made(spark)
    parts = report.stix_documents(findings, indicators, "2024-01-01T00:00:00.000Z", per=50).cache()
    assert parts.where("rank = 1 AND capture_id = 'c1'").count() > 10 and max(len(r.text) for r in parts.collect()) < 40_000
    for capture, bundle in whole(parts).items():
        ids = [o["id"] for o in bundle["objects"]]
        assert bundle["type"] == "bundle" and bundle["id"].startswith("bundle--") and len(ids) == len(set(ids))
        reports = [o for o in bundle["objects"] if o["type"] == "report"]
        assert len(reports) == 1 and set(reports[0]["object_refs"]) == set(ids) - {reports[0]["id"]} and len(reports[0]["object_refs"]) == len(ids) - 1
        assert sum(o["type"] == "indicator" for o in bundle["objects"]) == (1000 if capture == "c1" else 1)
    report.write_documents(parts, str(tmp_path / "stix"))
    files = {p.parent.name: json.loads(p.read_text()) for p in Path(tmp_path / "stix").rglob("part-*.txt")}
    assert files == {f"capture_id={k}": v for k, v in whole(parts).items()}


def test_events(spark):
    findings, indicators = made(spark)
    events = whole(report.misp_documents(findings, indicators, report.capture_risk(findings), per=100))
    assert set(events) == {"c1", "c2"}
    a = events["c1"]["Event"]
    assert len(a["Attribute"]) == 1 + 1000 + 2 and a["threat_level_id"] in ("1", "2", "3") and any("mitre" in t["name"] for t in a["Tag"])
    assert {x["type"] for x in a["Attribute"]} == {"comment", "ip-dst", "domain"} and a["Attribute"][0]["value"].startswith("Risk ")
