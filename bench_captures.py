"""Throughput of reading, decoding, folding and analysing captures: writes BENCH_MB of packets as several files, then times them."""

from __future__ import annotations

import json
import os
import random
import shutil
import tempfile
import threading
import time

from pyspark.sql import SparkSession


def make(folder: str, size: int, files: int) -> int:
    """Writes ``size`` MB of packets to ``files`` captures; gives the number of packets."""
    from tests import frames as f

    rng, made = random.Random(1), 0
    for k in range(files):
        frames, held = [], 0
        while held < size * 1_000_000 // files:
            a, b = f"10.0.{rng.randrange(4)}.{rng.randrange(225)}", f"45.77.{rng.randrange(3)}.{rng.randrange(200)}"
            kind = rng.random()
            if kind < 0.75:
                frame = f.tcp4(a, b, rng.randrange(1024, 65536), 443, 24, rng.randrange(1 << 32), rng.randbytes(rng.randrange(100, 1400)))
            elif kind < 0.9:
                frame = f.udp4(a, "8.8.8.8", rng.randrange(1024, 65536), 53, f.question(f"host{rng.randrange(5000)}.example.com"))
            else:
                frame = f.eth(f.ip4(a, b, 1, b"\x08\0" + bytes(62)))
            frames.append((1_700_000_000 + len(frames) / 1000, frame))
            held += len(frame) + 16
        made += len(frames)
        with open(f"{folder}/{k}.pcap", "wb") as out:
            out.write(f.pcap(frames))
    return made


def resident_mb() -> float:
    """Resident memory of this process and all that it started."""
    import psutil

    total = 0
    for p in [(me := psutil.Process()), *me.children(recursive=True)]:
        try:
            total += p.memory_info().rss
        except psutil.Error:
            continue
    return total / 1e6


def analysed(spark: SparkSession, folder: str, size: int) -> dict:
    """A whole analysis with its reports: seconds, MB a second, findings and the most memory that was resident."""
    from wiretide.plans import captures, report

    most, done = [0.0], threading.Event()

    def watch() -> None:
        while not done.wait(0.5):
            most[0] = max(most[0], resident_mb())

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    out = tempfile.mkdtemp(prefix="reports-")
    began = time.time()
    t, found = captures.analyse(spark, folder)
    middle = time.time()
    report.write(t, found, out)
    took = time.time() - began
    done.set()
    watcher.join()
    return {"mb": size, "seconds": round(took, 1), "findings_seconds": round(middle - began, 1), "mb_per_s": round(size / took, 2), "peak_mb": round(most[0]), "findings": found.count()}


def main() -> None:
    from wiretide.operators import facts, protocols
    from wiretide.operators.decode import decode
    from wiretide.sources.pcap import read_captures

    size, cpus = int(os.environ.get("BENCH_MB", "200")), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="captures-")
    made = make(folder, size, 2 * int(cpus))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    packets = decode(read_captures(spark, folder))
    took = {}
    for name, df in (("warm-up", packets.limit(10)), ("decode", packets.drop("payload")), ("flows", facts.flows(packets)), ("hosts", facts.hosts(packets)), ("dns", protocols.dns(packets)), ("timeline", facts.timeline(packets))):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
    took.pop("warm-up")
    whole = analysed(spark, folder, size)
    print(json.dumps({"metric": "capture_MB_per_second", "value": whole["mb_per_s"], "unit": "MB/s", "packets": made, "seconds": took, "analyse": whole, "cpus": int(cpus)}))
    spark.stop()
    shutil.rmtree(folder)


if __name__ == "__main__":
    main()
