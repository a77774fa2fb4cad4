"""python -m wiretide CAPTURES OUT [--html FILE] [--baseline OUT]: analyse captures and write the report tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import captures, report


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("captures")
    p.add_argument("out")
    p.add_argument("--html")
    p.add_argument("--baseline", metavar="OUT", help="folder of an earlier report, against which this one is compared")
    a = p.parse_args()
    spark = SparkSession.builder.appName("wiretide").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tables, found = captures.analyse(spark, a.captures)
    report.write(tables, found, a.out)
    if a.html:
        with open(a.html, "w") as f:
            f.write(report.html(tables, found))
    report.verdict(report.capture_risk(found), found).show(truncate=False)
    if a.baseline:
        now, before = report.stored(spark, a.out), report.stored(spark, a.baseline)
        report.compare_stored(now, before).write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/compared")
        report.compare_summary(now, before).show(truncate=False)


if __name__ == "__main__":
    main()
