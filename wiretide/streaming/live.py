"""Captures as streams: packets arrive in files, tables grow behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_private
from ..operators.decode import decode


def stream_packets(spark: SparkSession, path: str, schema) -> DataFrame:
    """Packets from Parquet files that keep coming, with the columns of ``sources.pcap``."""
    return spark.readStream.schema(schema).parquet(path)


def timed(packets: DataFrame, late: str = "60 seconds") -> DataFrame:
    return packets.withColumn("time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))).withWatermark("time", late)


def seconds(packets: DataFrame, late: str = "60 seconds") -> DataFrame:
    """Packets and bytes of each second."""
    return timed(packets, late).groupBy("capture_id", F.window("time", "1 second")).agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"))


def sessions(packets: DataFrame, gap: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """Conversations of two addresses that end after a silence."""
    d = timed(decode(packets), late).where("src_ip IS NOT NULL")
    return d.groupBy("capture_id", F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b"), F.session_window("time", gap)).agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"))


def scans(packets: DataFrame, least: int = 25, width: str = "5 minutes", late: str = "60 seconds") -> DataFrame:
    """Sources that try about ``least`` ports of one target within a window; the count is approximate so that state
    stays small."""
    d = timed(decode(packets), late).where("protocol = 6 AND (tcp_flags & 18) = 2")
    n = d.groupBy("capture_id", "src_ip", "dst_ip", F.window("time", width)).agg(F.approx_count_distinct("dst_port").alias("ports"))
    return n.where(F.col("ports") >= least).withColumn("inside", is_private(F.col("src_ip")))
