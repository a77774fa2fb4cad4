"""Column functions on values chosen by hand."""

import math

import pytest
from pyspark.sql import functions as F

from wiretide.functions import columns as C


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, bits", [("", 0.0), ("aaaa", 0.0), ("ab", 1.0), ("abcd", 2.0), ("aab", -(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))])
def test_entropy(spark, text, bits):
    assert one(spark, C.entropy, text) == pytest.approx(bits)


@pytest.mark.parametrize("name, want", [("a.b.example.com", "example.com"), ("x.example.co.uk.", "example.co.uk"), ("com", "com"), ("co.uk", "co.uk")])
def test_registered_domain(spark, name, want):
    assert one(spark, C.registered_domain, name) == want


@pytest.mark.parametrize("ip, scope, private", [("10.1.2.3", "private", True), ("8.8.8.8", "public", False), ("100.64.1.1", "cgnat", False), ("203.0.113.9", "documentation", True), ("999.1.1.1", None, False), ("fe80::1", None, True), ("2606:4700::1", None, False), ("2001:db8::1", None, True), ("", None, False)])
def test_scope(spark, ip, scope, private):
    assert one(spark, C.ip_scope, ip) == scope
    assert one(spark, C.is_private, ip) is private


def test_small_ones(spark):
    assert one(spark, C.url_host, "HTTP://me@Host.Example:80/x?y") == "host.example"
    assert one(spark, C.url_decoded, "a%2520b+c") == "a b c"
    assert one(spark, C.url_decoded, "%zz") == "%zz"
    assert one(spark, C.defang, "http://a.b") == "hxxp://a[.]b"
    assert one(spark, C.csv_guard, "=1+1") == "'=1+1" and one(spark, C.csv_guard, "x") == "x"
    assert one(spark, lambda x: C.file_type(x.cast("binary")), "MZ\0") == "exe"
    assert one(spark, C.subnet, "10.1.2.3") == "10.1.2.0/24"
    assert one(spark, C.subnet, "2001:db8::1") == "2001:0db8:0000:0000::/64" and one(spark, C.subnet, "fe80::1:2") == "fe80:0000:0000:0000::/64"
    assert one(spark, C.subnet, "1:2:3:4:5:6:7:8") == "0001:0002:0003:0004::/64" and one(spark, C.subnet, "no address") == "unknown"
    assert one(spark, lambda x: C.service_name(F.lit(443), F.lit(True)), "") == "QUIC"
    assert one(spark, lambda x: C.service_name(F.lit(50000), F.lit(False)), "") == "Ephemeral"
    assert one(spark, lambda x: C.service_name(F.lit(4), F.lit(False)), "") == "TCP/4"
