"""Blocklists: from feed files to verdicts and scores.

A feeds table has name, kind (ip, domain or url), parser (lines or cidr), severity and path; its text files are read by Spark.
Ranges are spread over the first octets that they touch, so addresses meet them in an equality join at any size of list.  IPv6
addresses and ranges meet by prefix length and prefix, for the lengths that the feeds have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_map, ip4_number, ip6_digits, ip6_prefix, is_private, url_host

# Points of a listing by severity, and of what is known of an address.
POINTS = {"critical": 55, "high": 35, "medium": 18, "low": 8}
OTHER_POINTS = 5
CONTEXT_POINTS = {"proxy": 20, "hosting": 8, "no_reverse_dns": 4}
RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def read_feed(spark: SparkSession, path: str, name: str, kind: str, parser: str, severity: str) -> DataFrame:
    """(feed, kind, severity, value, lo, hi) of a feed's lines; what isn't an entry of its kind is left out."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.rlike("^(#|;|//)"))
    first = F.lower(F.split(F.split(line, r"\s+")[0], ",")[0])
    if parser == "cidr":
        entry = F.trim(F.split(line, ";")[0])
        base, bits = F.split(entry, "/")[0], F.coalesce(F.try_element_at(F.split(entry, "/"), F.lit(2)).try_cast("int"), F.lit(32))
        size = F.pow(F.lit(2), 32 - bits).cast("long")
        lo = ip4_number(base) - F.pmod(ip4_number(base), size)
        six = F.lower(base).contains(":") & _six(F.lower(entry))["digits"].isNotNull()
        out = rows.select(F.when(six, F.lower(entry)).otherwise(entry).alias("v"), lo.alias("lo"), (lo + size - 1).alias("hi"), six.alias("six")).where("lo IS NOT NULL OR six").drop("six")
    else:
        value = {"ip": F.when(ip4_number(first).isNotNull() | first.contains(":"), first), "url": F.coalesce(F.nullif(url_host(line), F.lit("")), F.lower(F.regexp_extract(line, r"^([^/:?#\s]+\.[^/:?#\s]+)", 1))), "domain": F.when(first.contains("."), F.regexp_replace(first, r"^[*.]+", ""))}[kind]
        out = rows.select(value.alias("v"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")).where("v IS NOT NULL AND v <> ''")
    return out.distinct().select(F.lit(name).alias("feed"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col("v").alias("value"), "lo", "hi")


def _six(value: Column) -> Column:
    """Digits and prefix length of an IPv6 address or range; both null for other texts."""
    base, tail = F.split(value, "/")[0], F.try_element_at(F.split(value, "/"), F.lit(2))
    bits = F.when(value.contains("/"), tail.try_cast("int")).otherwise(F.lit(128))
    ok = ip6_digits(base).isNotNull() & bits.between(0, 128)
    return F.struct(F.when(ok, ip6_digits(base)).alias("digits"), F.when(ok, bits).alias("bits"))


def _within6(a: DataFrame, feeds: DataFrame) -> DataFrame:
    """(ip, feed, severity, detail) of IPv6 addresses: one equality join by length and prefix, an address having a row for each of
    the 129 lengths at most that some feed has."""
    nets = feeds.where(F.col("kind") == "ip").where(F.col("value").contains(":")).select("feed", "severity", "value", _six(F.lower("value")).alias("n")).where("n.bits IS NOT NULL")
    nets = nets.select("feed", "severity", "value", F.col("n.bits").alias("bits"), ip6_prefix(F.col("n.digits"), F.col("n.bits")).alias("prefix"))
    lengths = nets.groupBy().agg(F.collect_set("bits").alias("lengths"))
    six = a.withColumn("digits", ip6_digits(F.col("ip"))).where("digits IS NOT NULL").crossJoin(F.broadcast(lengths)).withColumn("bits", F.explode("lengths"))
    hits = six.select("ip", "bits", ip6_prefix(F.col("digits"), F.col("bits")).alias("prefix")).join(nets, ["bits", "prefix"])
    # of the ranges of a feed that hold an address, the narrowest; the address itself is listed
    best = hits.groupBy("ip", "feed", "severity").agg(F.max_by("value", F.struct("bits", "value")).alias("value"), F.max("bits").alias("bits"))
    return best.select("ip", "feed", "severity", F.when(F.col("bits") == 128, "listed").otherwise(F.concat(F.lit("within "), "value")).alias("detail"))


def check_ips(ips: DataFrame, feeds: DataFrame, ip: str = "ip") -> DataFrame:
    """(ip, feed, severity, detail) of outside addresses that are listed or lie in a listed range."""
    a = ips.select(F.lower(ip).alias("ip")).distinct().where(~is_private(F.col("ip")))
    exact = a.join(feeds.where("kind = 'ip' AND lo IS NULL AND NOT contains(value, ':')").select("feed", "severity", F.col("value").alias("ip")), "ip").select("ip", "feed", "severity", F.lit("listed").alias("detail"))
    spread = feeds.where("lo IS NOT NULL").withColumn("octet", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))
    n = a.withColumn("n", ip4_number(F.col("ip"))).where("n IS NOT NULL").withColumn("octet", F.shiftright("n", 24))
    within = n.join(spread, "octet").where("n BETWEEN lo AND hi").groupBy("ip", "feed", "severity").agg(F.concat(F.lit("within "), F.min("value")).alias("detail"))
    return exact.union(within.select("ip", "feed", "severity", "detail")).union(_within6(a, feeds))


def check_domains(names: DataFrame, feeds: DataFrame, name: str = "domain") -> DataFrame:
    """(domain, feed, severity, detail) of names of which they or a parent are listed, by each feed that lists one: a name meets
    the lists with all its parents of two labels and more, and of what one feed lists the first by code point is told."""
    d = names.select(F.lower(F.regexp_replace(name, r"\.+$", "")).alias("domain")).distinct().where(F.col("domain").contains("."))
    labels = F.split("domain", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = feeds.where("kind IN ('domain', 'url')").select("feed", "severity", "value").distinct()
    hits = d.select("domain", F.explode(F.array_distinct(parents)).alias("value")).join(listed, "value")
    return hits.groupBy("domain", "feed", "severity").agg(F.concat(F.lit("matched "), F.min("value")).alias("detail"))


def verdicts(hits: DataFrame, key: str) -> DataFrame:
    """Per indicator its worst severity and the feeds that list it."""
    rank = by_map(F.col("severity"), RANK)
    return hits.groupBy(key).agg(F.max_by("severity", rank).alias("worst_severity"), F.sort_array(F.collect_set("feed")).alias("feeds"), F.count("*").alias("listings"))


def scores(hits: DataFrame, context: DataFrame, key: str = "ip") -> DataFrame:
    """Per address a score of 100 at most: its listings' points, and more for proxies, hosting and no reverse name.

    ``context`` has the key, proxy, hosting (booleans) and reverse_dns (text), as an address service gives them."""
    listed = hits.groupBy(key).agg(F.sum(F.coalesce(by_map(F.col("severity"), POINTS), F.lit(OTHER_POINTS))).alias("points"))
    both = listed.join(context, key, "full")
    more: Column = F.when(F.col("proxy"), CONTEXT_POINTS["proxy"]).otherwise(0) + F.when(F.col("hosting"), CONTEXT_POINTS["hosting"]).otherwise(0)
    more = more + F.when(F.col("proxy").isNotNull() & (F.coalesce("reverse_dns", F.lit("")) == ""), CONTEXT_POINTS["no_reverse_dns"]).otherwise(0)
    return both.select(key, F.least(F.coalesce("points", F.lit(0)) + more, F.lit(100)).cast("long").alias("score"))


#: How old a feed may be before a clean answer means less.
STALE_HOURS = 168.0
# Pages where an analyst looks on, which ask for no account; the indicator stands for {}.
IP_LINKS = (
    ("VirusTotal", "https://www.virustotal.com/gui/ip-address/{}"),
    ("AbuseIPDB", "https://www.abuseipdb.com/check/{}"),
    ("Shodan", "https://www.shodan.io/host/{}"),
    ("GreyNoise", "https://viz.greynoise.io/ip/{}"),
    ("RDAP registry", "https://rdap.org/ip/{}"),
    ("ThreatFox", "https://threatfox.abuse.ch/browse.php?search=ioc%3A{}"),
)
NAME_LINKS = (
    ("VirusTotal", "https://www.virustotal.com/gui/domain/{}"),
    ("URLhaus", "https://urlhaus.abuse.ch/browse.php?search={}"),
    ("crt.sh certificates", "https://crt.sh/?q={}"),
    ("URLScan", "https://urlscan.io/search/#{}"),
)


def pivot_links(indicator: Column, kind: Column) -> Column:
    """An array of (name, url): where to look on after an address (kind ``ip``) or a name; the indicator is escaped for a URL, but
    for ``.:-_``.  Null for a null indicator."""
    escaped = F.url_encode(indicator)
    for made, kept in (("+", "%20"), ("*", "%2A"), ("%3A", ":"), ("%7E", "~")):
        escaped = F.replace(escaped, F.lit(made), F.lit(kept))
    links = lambda some: F.array(*[F.struct(F.lit(name).alias("name"), F.replace(F.lit(url), F.lit("{}"), escaped).alias("url")) for name, url in some])
    return F.when(indicator.isNotNull(), F.when(kind == "ip", links(IP_LINKS)).otherwise(links(NAME_LINKS)))


def feed_status(listed: DataFrame, feeds: DataFrame, now: Column | None = None) -> DataFrame:
    """A row for each feed: name, kind, severity, entries, fetched_at, age_hours, cached, stale.

    ``listed`` names the feeds (name, kind, severity, fetched_at: timestamp or null), ``feeds`` has the entries as ``read_feed``
    gives them; entries are counted before they meet the names.  A feed without entries is not cached, one of over a week is
    stale, of one with no time both age and staleness are unknown and told as null and false."""
    n = feeds.groupBy(F.col("feed").alias("name")).agg(F.count("*").alias("entries"))
    at = F.unix_micros(F.current_timestamp() if now is None else now)
    hours = (at - F.unix_micros("fetched_at")) / F.lit(3_600_000_000)
    rows = listed.select("name", "kind", "severity", "fetched_at").join(n, "name", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    return rows.select("name", "kind", "severity", "entries", "fetched_at", F.round(hours, 1).alias("age_hours"), (F.col("entries") > 0).alias("cached"), F.coalesce(hours > STALE_HOURS, F.lit(False)).alias("stale"))


def enriched_report(addresses: DataFrame, names: DataFrame, feeds: DataFrame, status: DataFrame) -> DataFrame:
    """One row for each listed outside address (``ip``) and name (``domain``) of a report: indicator, kind, worst_severity, sources
    (feed, severity, detail, fetched_at; by feed), checked_feeds, stale_feeds and links.

    Addresses are checked against feeds of kind ip, names against those of kind domain and url.  All are checked: there's no
    limit, as a join over all costs what a join over some costs.  ``checked_feeds`` counts the cached feeds of the indicator's
    kind; ``stale_feeds`` names all that are over a week old.  Sources of one indicator are as many as there are feeds, so no row
    grows with the report; the two numbers are of one row and reach all rows by a join with it."""
    hits = check_ips(addresses, feeds).select(F.col("ip").alias("indicator"), F.lit("ip").alias("kind"), "feed", "severity", "detail")
    hits = hits.union(check_domains(names, feeds).select("domain", F.lit("domain"), "feed", "severity", "detail"))
    when = status.select(F.col("name").alias("feed"), "fetched_at")
    source = F.struct("feed", "severity", "detail", "fetched_at")
    rank = by_map(F.col("severity"), RANK)
    found = hits.join(when, "feed", "left").groupBy("indicator", "kind").agg(F.max_by("severity", rank).alias("worst_severity"), F.sort_array(F.collect_set(source)).alias("sources"))
    cached = lambda *kinds: F.count_if(F.col("cached") & F.col("kind").isin(*kinds))
    state = status.agg(cached("ip").alias("for_ips"), cached("domain", "url").alias("for_names"), F.sort_array(F.collect_set(F.when(F.col("stale"), F.col("name")))).alias("stale_feeds"))
    return found.crossJoin(F.broadcast(state)).select(
        "indicator", "kind", "worst_severity", "sources", F.when(F.col("kind") == "ip", F.col("for_ips")).otherwise(F.col("for_names")).alias("checked_feeds"), "stale_feeds", pivot_links(F.col("indicator"), F.col("kind")).alias("links")
    )
