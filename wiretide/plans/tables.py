"""The engine's operators over the driver's tables; each query stands beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from ..functions import fixed
from ..operators import intervals, patterns, spread

TABLE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        TABLE_QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", C.micros(F.col("ts")))


def values(rows: list[tuple]) -> str:
    """A SQL VALUES list."""
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


SQL_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', ''))"


def sql_entropy(text: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({text}, '')), lambda c: -(len({text}) - len(replace({text}, c, ''))) / CAST(len({text}) AS DOUBLE) * log2((len({text}) - len(replace({text}, c, ''))) / CAST(len({text}) AS DOUBLE)))), 0.0)"


def sql_domain(name: str) -> str:
    two = ", ".join(f"'{s}'" for s in fixed.TWO_PART_SUFFIXES)
    p = f"string_split({name}, '.')"
    last = lambda n: f"array_to_string(list_slice({p}, greatest(len({p}) - {n - 1}, 1), len({p})), '.')"
    return f"CASE WHEN len({p}) <= 2 THEN {name} WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END"


# intervals ----------------------------------------------------------------------------------------------------

SQL_STATS = """
WITH t AS (SELECT user_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events),
g AS (SELECT * FROM t WHERE gap > 0),
s AS (SELECT user_id, event_type, count(*) AS n_gaps, avg(gap) AS mean_us, median(gap) AS median_us, stddev_pop(gap) AS stdev_us, min(gap) AS min_us, max(gap) AS max_us
  FROM g GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT user_id, event_type, median(abs(gap - median_us)) AS mad_us FROM g JOIN s USING (user_id, event_type) GROUP BY ALL),
st AS (SELECT *, CASE WHEN mean_us > 0 THEN stdev_us / mean_us ELSE 0 END AS cv, CASE WHEN median_us > 0 THEN mad_us / median_us ELSE 1 END AS mad_ratio FROM s JOIN m USING (user_id, event_type))
"""


@query(SQL_STATS + """SELECT user_id, event_type, n_gaps, round(mean_us / 1e6, 3) AS mean_s, round(median_us / 1e6, 3) AS median_s, round(stdev_us / 1e6, 3) AS stdev_s,
  round(mad_us / 1e6, 3) AS mad_s, round(cv, 4) AS cv, round(mad_ratio, 4) AS mad_ratio, min_us, max_us FROM st""")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = intervals.interval_stats(events(spark, sf_dir), ["user_id", "event_type"], "us")
    sec = lambda c: F.round(F.col(f"{c}_us") / 1e6, 3).alias(f"{c}_s")
    return s.select("user_id", "event_type", "n_gaps", sec("mean"), sec("median"), sec("stdev"), sec("mad"), F.round("cv", 4).alias("cv"), F.round("mad_ratio", 4).alias("mad_ratio"), "min_us", "max_us")


SQL_SCORE = SQL_STATS + """, c AS (SELECT user_id, event_type, count(*) AS n_events, avg(value) AS mean_value FROM events GROUP BY ALL),
sc AS (SELECT user_id, event_type, n_events, n_gaps, cv, mad_ratio,
  n_events >= 8 AND n_gaps >= 7 AND median_us BETWEEN 900000 AND 86400000000 AND cv <= 0.55 AND mad_ratio <= 0.45 AS periodic,
  CAST(CASE WHEN cv < 0.15 THEN 40 WHEN cv < 0.3 THEN 28 ELSE 15 END + CASE WHEN mad_ratio < 0.1 THEN 25 WHEN mad_ratio < 0.25 THEN 15 ELSE 0 END
    + CASE WHEN n_events >= 40 THEN 20 WHEN n_events >= 20 THEN 12 WHEN n_events >= 12 THEN 6 ELSE 0 END
    + CASE WHEN mean_value < 2000 THEN 10 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 10 ELSE 0 END AS BIGINT) AS score
  FROM st JOIN c USING (user_id, event_type))
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    stats = intervals.interval_stats(e, ["user_id", "event_type"], "us")
    counts = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n_events"), F.avg("value").alias("mean_value"))
    rows = stats.join(counts, ["user_id", "event_type"])
    score = intervals.periodicity(F.col("n_events"), F.col("mean_value"), F.col("user_id") % 2 == 0, F.col("cv"), F.col("mad_ratio"))
    return rows.select("user_id", "event_type", "n_events", "n_gaps", "cv", "mad_ratio", ((F.col("n_events") >= 8) & intervals.periodic(rows)).alias("periodic"), score.cast("long").alias("score"))


@query(SQL_SCORE + "SELECT user_id, event_type, n_events, n_gaps, round(cv, 4) AS cv, round(mad_ratio, 4) AS mad_ratio, periodic, score FROM sc")
def beacon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumns({"cv": F.round("cv", 4), "mad_ratio": F.round("mad_ratio", 4)})


@query(SQL_SCORE + "SELECT user_id, event_type, score FROM sc WHERE score >= 45")
def beacon_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("score >= 45").select("user_id", "event_type", "score")


@query("""
WITH l AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts) AS t FROM events GROUP BY user_id),
k AS (SELECT user_id, t, list_reduce(list_transform(t, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 43200000000 THEN list_concat(a, x) ELSE a END) AS kept FROM l)
SELECT user_id, CAST(len(t) AS BIGINT) AS n_events, CAST(len(kept) AS BIGINT) AS n_kept, kept[1] AS first_us, kept[-1] AS last_us FROM k""")
def collapse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.collapse(events(spark, sf_dir), "user_id", "us", 12 * 3600 * 1_000_000)


HOT = "CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END"
SQL_HOT = SQL_STATS.replace("event_type, epoch_us", "event_type, epoch_us").replace("FROM events)", f"FROM (SELECT {HOT} AS user_id, 'x' AS event_type, ts FROM events))")


@query(SQL_HOT + "SELECT user_id, n_gaps, mean_us, median_us, round(stdev_us, 3) AS stdev_us, mad_us, min_us, max_us FROM st")
def interval_stats_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval statistics where one key has half of all rows."""
    e = events(spark, sf_dir).select(F.expr(HOT).alias("user_id"), "us")
    return spread.interval_stats(e, ["user_id"], "us").select("user_id", "n_gaps", "mean_us", "median_us", F.round("stdev_us", 3).alias("stdev_us"), "mad_us", "min_us", "max_us")


@query(f"""
WITH l AS (SELECT user_id, list(us ORDER BY us) AS t FROM (SELECT {HOT} AS user_id, epoch_us(ts) AS us FROM events) GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(t, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 1800000000 THEN list_concat(a, x) ELSE a END) AS kept FROM l)
SELECT user_id, unnest(kept) AS us FROM k""")
def collapse_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that are over half an hour after the last kept one, where one key has half of all rows."""
    return spread.kept(events(spark, sf_dir).select(F.expr(HOT).alias("user_id"), "us"), ["user_id"], "us", 1_800_000_000)


# fan-out, rates, rare values ----------------------------------------------------------------------------------


@query("SELECT l_suppkey, p_brand, count(DISTINCT l_partkey) AS n_targets FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 25")
def vertical_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return patterns.fan_out(rows, ["l_suppkey", "p_brand"], "l_partkey", 25)


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_targets FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 20")
def horizontal_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.fan_out(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", 20)


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS hits FROM events GROUP BY ALL HAVING count(*) >= 40 AND count(*) FILTER (event_type = 'error') > 0.2 * count(*)")
def unanswered_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.share(events(spark, sf_dir), ["user_id"], F.col("event_type") == "error", 40, 0.2)


@query("""SELECT l_suppkey, CAST(sum(l_quantity) FILTER (l_returnflag = 'N') AS BIGINT) AS sent, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS received
FROM lineitem GROUP BY ALL HAVING sum(l_quantity) FILTER (l_returnflag = 'N') >= 1.1 * greatest(1, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0))""")
def asymmetric_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(of("N").cast("long").alias("sent"), F.coalesce(of("R"), F.lit(0)).cast("long").alias("received"))
    return sums.where(F.col("sent") >= 1.1 * F.greatest(F.lit(1), F.col("received")))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_targets FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) >= 5")
def account_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.fan_out(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", 5)


@query("SELECT c_nationkey, count(DISTINCT o_custkey) AS n_targets FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL HAVING count(DISTINCT o_custkey) >= 8")
def spraying(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return patterns.fan_out(rows, ["c_nationkey"], "o_custkey", 8)


@query("""SELECT user_id, event_type, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY ALL
HAVING count(*) >= 10 AND count(*) / greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 1) >= 0.000005""")
def rate_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.burst(events(spark, sf_dir), ["user_id", "event_type"], "us", 10, 0.000005).drop("rate")


@query("""WITH v AS (SELECT concat(event_type, ':', json_extract_string(props, '$.k')) AS v, event_id FROM events),
c AS (SELECT v, count(*) AS n, min(event_id) AS sample FROM v GROUP BY v),
w AS (SELECT count(*) AS kinds, sum(n) AS rows_, sum(CASE WHEN n <= 12 THEN n ELSE 0 END) AS few FROM c)
SELECT v, n, sample FROM c, w WHERE n <= 12 AND kinds > 5 AND few < 0.5 * rows_""")
def rare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("v"), "event_id")
    return patterns.rare(rows, "v", 12, 5, "event_id")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_targets FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) >= 2")
def multi_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.fan_out(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", 2)


# names and texts ----------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, round({sql_entropy('p_name')}, 6) AS bits FROM part")
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(C.entropy(F.col("p_name")), 6).alias("bits"))


@query(f"""WITH h AS (SELECT DISTINCT string_split({SQL_HOST}, '.')[1] AS label FROM pages)
SELECT label, CAST(len(label) AS BIGINT) AS n, round({sql_entropy('label')}, 6) AS bits FROM h
WHERE len(label) >= 6 AND {sql_entropy('label')} > 2.2 AND len(regexp_replace(label, '[^aeiou]', '', 'g')) < 0.3 * len(label)""")
def random_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = table(spark, sf_dir, "pages").select(F.split(C.url_host(F.col("url")), r"\.")[0].alias("label")).distinct()
    rows = label.withColumn("n", F.length("label").cast("long")).withColumn("e", C.entropy(F.col("label")))
    vowels = F.length(F.regexp_replace("label", "[^aeiou]", ""))
    return rows.where((F.col("n") >= 6) & (F.col("e") > 2.2) & (vowels < 0.3 * F.col("n"))).select("label", "n", F.round("e", 6).alias("bits"))


@query(f"""WITH h AS (SELECT DISTINCT {SQL_HOST} AS host FROM pages), d AS (SELECT host, {sql_domain('host')} AS domain FROM h),
s AS (SELECT domain, CASE WHEN host = domain THEN '' ELSE left(host, len(host) - len(domain) - 1) END AS sub FROM d)
SELECT domain, count(*) AS n_subdomains, round(avg(len(sub)), 6) AS avg_length, round(avg({sql_entropy('sub')}), 6) AS avg_bits FROM s GROUP BY domain""")
def domain_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select(C.url_host(F.col("url")).alias("host")).distinct().withColumn("domain", C.registered_domain(F.col("host")))
    sub = F.when(F.col("host") == F.col("domain"), "").otherwise(F.expr("left(host, length(host) - length(domain) - 1)"))
    s = d.withColumn("sub", sub)
    return s.groupBy("domain").agg(F.count("*").alias("n_subdomains"), F.round(F.avg(F.length("sub")), 6).alias("avg_length"), F.round(F.avg(C.entropy(F.col("sub"))), 6).alias("avg_bits"))


LOOK = ("exampel.com", "examples.net", "example.org", "brand#12")


@query(f"""WITH n AS (SELECT DISTINCT array_to_string(string_split({SQL_HOST}, '.')[-2:], '.') AS name FROM pages UNION SELECT DISTINCT lower(p_brand) FROM part),
b AS (SELECT * FROM (VALUES {values([(i, x) for i, x in enumerate(LOOK)])}) t(i, brand))
SELECT name, min_by(brand, i) AS brand FROM n, b WHERE name NOT IN (SELECT brand FROM b) AND levenshtein(name, brand) BETWEEN 1 AND 2 AND abs(len(name) - len(brand)) <= 2 GROUP BY name""")
def lookalike(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(F.array_join(F.slice(F.split(C.url_host(F.col("url")), r"\."), -2, 2), ".").alias("name"))
    names = hosts.union(table(spark, sf_dir, "part").select(F.lower("p_brand"))).distinct()
    near = [F.when(F.levenshtein("name", F.lit(b)).between(1, 2) & (F.abs(F.length("name") - len(b)) <= 2), F.lit(b)) for b in LOOK]
    return names.select("name", F.when(~F.col("name").isin(*LOOK), F.coalesce(*near)).alias("brand")).where("brand IS NOT NULL")


@query("SELECT page_id, url_decode(url_decode(replace(replace(url, '/', '%252F'), '+', ' '))) AS decoded FROM pages")
def url_decode_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.url_decoded(F.regexp_replace("url", "/", "%252F")).alias("decoded"))


WEB_SQL = ", ".join(f"CASE WHEN regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}') THEN '{t}' END" for t, _, _, p in fixed.WEB_PATTERNS)


@query(f"""WITH t AS (SELECT page_id AS id, coalesce(html, '') || ' ' || CASE page_id % 5 WHEN 0 THEN 'id=1 OR 1=1' WHEN 1 THEN '../../etc/passwd' WHEN 2 THEN '; cat x' WHEN 3 THEN 'shell.php' ELSE '' END AS x FROM pages)
SELECT id, array_to_string(list_filter([{WEB_SQL}], lambda v: v IS NOT NULL), ',') AS titles FROM t""")
def payload_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.expr("CASE page_id % 5 WHEN 0 THEN 'id=1 OR 1=1' WHEN 1 THEN '../../etc/passwd' WHEN 2 THEN '; cat x' WHEN 3 THEN 'shell.php' ELSE '' END")
    x = F.concat(F.coalesce("html", F.lit("")), F.lit(" "), more)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.array_join(patterns.matched(x), ",").alias("titles"))


@query("""SELECT page_id, regexp_extract(html, '(.{0,20})<script', 1) AS before, regexp_extract(html, '<script[^>]*>(.{0,20})', 1) AS after FROM pages WHERE regexp_matches(html, '<script')""")
def matched_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where(F.col("html").rlike("<script"))
    return p.select("page_id", F.regexp_extract("html", "(.{0,20})<script", 1).alias("before"), F.regexp_extract("html", "<script[^>]*>(.{0,20})", 1).alias("after"))


CRED = r"(?i)(password|passwd|pwd|token|secret|api_?key)\s*[:=]\s*[\x22']?([A-Za-z0-9+/_.=-]{4,})"


@query(f"""SELECT doc_id, lower(regexp_extract(text, '{CRED.replace(chr(39), chr(39) * 2)}', 1)) AS parameter, md5(regexp_extract(text, '{CRED.replace(chr(39), chr(39) * 2)}', 2)) AS secret_md5
FROM documents WHERE regexp_matches(text, '{CRED.replace(chr(39), chr(39) * 2)}')""")
def credential_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(CRED))
    return d.select("doc_id", F.lower(F.regexp_extract("text", CRED, 1)).alias("parameter"), F.md5(F.regexp_extract("text", CRED, 2)).alias("secret_md5"))


@query(f"""WITH m AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{CRED.replace(chr(39), chr(39) * 2)}', 1), regexp_extract_all(text, '{CRED.replace(chr(39), chr(39) * 2)}', 2))) AS m FROM documents)
SELECT doc_id, lower(m[1]) AS parameter, md5(m[2]) AS secret_md5 FROM m""")
def credential_params_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match of each text, not the first one only."""
    every = lambda g: F.regexp_extract_all("text", F.lit(CRED), g)
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.arrays_zip(every(1).alias("a"), every(2).alias("b"))).alias("m"))
    return d.select("doc_id", F.lower("m.a").alias("parameter"), F.md5("m.b").alias("secret_md5"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'AKIA[A-Z0-9]{16}')) AS BIGINT) AS n_cloud, CAST(len(regexp_extract_all(text, '-----BEGIN [A-Z ]+-----')) AS BIGINT) AS n_pem, CAST(len(regexp_extract_all(text, '[0-9a-f]{32,}')) AS BIGINT) AS n_hex FROM documents")
def exposed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p, a: F.regexp_count("text", F.lit(p)).cast("long").alias(a)
    return table(spark, sf_dir, "documents").select("doc_id", n("AKIA[A-Z0-9]{16}", "n_cloud"), n("-----BEGIN [A-Z ]+-----", "n_pem"), n("[0-9a-f]{32,}", "n_hex"))


# addresses ----------------------------------------------------------------------------------------------------

IP = r"\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b"
SQL_IPS = f"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{IP}')) AS ip FROM documents
  UNION ALL SELECT s_suppkey, concat(s_suppkey * 37 % 224, '.', s_suppkey * 11 % 256, '.', s_suppkey % 256, '.1') FROM supplier),
ips AS (SELECT DISTINCT doc_id, ip, CAST(string_split(ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(ip, '.')[2] AS BIGINT) * 65536 + CAST(string_split(ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip, '.')[4] AS BIGINT) AS n FROM found)
"""


def _ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(IP), 0)).alias("ip"))
    made = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat(s_suppkey * 37 % 224, '.', s_suppkey * 11 % 256, '.', s_suppkey % 256, '.1')")
    return d.union(made).distinct()


def _cases(ranges: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN n BETWEEN {C.bounds(c)[0]} AND {C.bounds(c)[1]} THEN '{x}'" for c, x in ranges) + f" ELSE {otherwise} END"


@query(SQL_IPS + f"SELECT doc_id, ip, {_cases([(c, s) for c, _, s in fixed.SPECIAL_RANGES if ':' not in c], chr(39) + 'public' + chr(39))} AS scope FROM ips")
def ip_extract_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ips(spark, sf_dir).select("doc_id", "ip", C.ip_scope(F.col("ip")).alias("scope"))


@query(SQL_IPS + f"SELECT ip, {_cases([(c, o) for c, o, _ in fixed.KNOWN_NETWORKS], 'NULL')} AS operator FROM (SELECT DISTINCT ip, n FROM ips)")
def cidr_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = _ips(spark, sf_dir).select("ip").distinct()
    return ips.select("ip", C.first_range(C.ip4_number(F.col("ip")), [(c, o) for c, o, _ in fixed.KNOWN_NETWORKS], F.lit(None)).alias("operator"))


@query(SQL_IPS + "SELECT concat(array_to_string(string_split(ip, '.')[1:3], '.'), '.0/24') AS subnet, count(DISTINCT ip) AS n_hosts FROM ips GROUP BY ALL")
def subnet_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ips(spark, sf_dir).select("ip").distinct().groupBy(C.subnet(F.col("ip")).alias("subnet")).agg(F.count("*").alias("n_hosts"))


LISTED = ("example.com", "blog.ththan.example.net", "example")


@query(f"""WITH h AS (SELECT DISTINCT {SQL_HOST} AS host FROM pages), p AS (SELECT host, string_split(host, '.') AS l FROM h),
c AS (SELECT host, array_to_string(l[i:], '.') AS parent FROM (SELECT host, l, unnest(range(1, greatest(len(l), 2))) AS i FROM p))
SELECT host, max_by(parent, len(parent)) AS listed FROM c WHERE parent IN ({', '.join(repr(x) for x in LISTED)}) GROUP BY host""")
def domain_parent_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(C.url_host(F.col("url")).alias("host")).distinct()
    return patterns.domain_matches(hosts, "host", spark.createDataFrame([(x,) for x in LISTED], "entry string"), "entry")


# joins, timelines, graphs -------------------------------------------------------------------------------------


@query("SELECT a.event_id, a.event_type AS request, b.event_type AS response FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1")
def next_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "events"), table(spark, sf_dir, "events")
    nxt = b.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("response"))
    return a.select("event_id", F.col("event_type").alias("request")).join(nxt, "event_id", "left")


@query("SELECT epoch_us(ts) // 1000000 AS bucket, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL")
def per_second_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.buckets(events(spark, sf_dir), "us", 1_000_000, F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH s AS (SELECT min(epoch_us(ts) // 1000000) AS a, max(epoch_us(ts) // 1000000) AS b FROM events)
SELECT (epoch_us(ts) // 1000000 - a) // greatest(1, (b - a) // 180) AS bucket, count(*) AS n FROM events, s GROUP BY ALL""")
def downsample_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.floor(F.col("us") / 1_000_000).alias("s"))
    ends = e.agg(F.min("s").alias("a"), F.max("s").alias("b"))
    return e.crossJoin(F.broadcast(ends)).groupBy(F.expr("(s - a) div greatest(1, (b - a) div 180)").alias("bucket")).agg(F.count("*").alias("n"))  # one row


@query("""WITH f AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_id, event_type, us FROM f WHERE r = 1 ORDER BY us, event_id LIMIT 60""")
def first_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    first = e.groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type", "us"), F.struct("us", "event_id")).alias("f")).select("user_id", "f.*")
    return first.orderBy("us", "event_id").limit(60)  # the report's sixty


@query("(SELECT event_id, 'head' AS part FROM events ORDER BY ts, event_id LIMIT 200) UNION ALL (SELECT event_id, 'tail' FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)")
def event_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    head = e.orderBy("us", "event_id").limit(200).select("event_id", F.lit("head").alias("part"))
    return head.union(e.orderBy(F.col("us").desc(), F.col("event_id").desc()).limit(200).select("event_id", F.lit("tail")))


SQL_PAIRS = """WITH r AS (SELECT c.c_nationkey AS x, s.s_nationkey AS y, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer c ON o_custkey = c.c_custkey JOIN supplier s ON l_suppkey = s.s_suppkey),
p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n, CAST(sum(q) AS BIGINT) AS volume FROM r GROUP BY ALL)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return patterns.pair_volume(rows.withColumn("q", F.col("l_quantity").cast("long")), "c_nationkey", "s_nationkey", "q")


@query(SQL_PAIRS + "SELECT a, b, n, volume FROM p ORDER BY volume DESC, a, b LIMIT 25")
def pair_volume_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).orderBy(F.col("volume").desc(), "a", "b").limit(25)  # a top-k report


@query(SQL_PAIRS + """, m AS (SELECT node, CAST(sum(volume) AS BIGINT) AS volume, count(DISTINCT peer) AS n_peers FROM (SELECT a AS node, b AS peer, volume FROM p UNION ALL SELECT b, a, volume FROM p WHERE a <> b) GROUP BY node)
SELECT node, volume, n_peers, round(pow(volume / CAST(max(volume) OVER () AS DOUBLE), 0.4), 4) AS weight FROM m""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    ends = p.select(F.col("a").alias("node"), F.col("b").alias("peer"), "volume").union(p.where("a <> b").select("b", "a", "volume"))
    nodes = ends.groupBy("node").agg(F.sum("volume").alias("volume"), F.count_distinct("peer").alias("n_peers"))
    top = nodes.agg(F.max("volume").alias("top"))
    return nodes.crossJoin(F.broadcast(top)).select("node", "volume", "n_peers", F.round(F.pow(F.col("volume") / F.col("top"), F.lit(0.4)), 4).alias("weight"))  # one row


@query(SQL_PAIRS + "SELECT a, b, n, volume, round(pow(volume / CAST((SELECT max(volume) FROM p) AS DOUBLE), 0.35), 4) AS weight FROM p WHERE a <> b")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.crossJoin(F.broadcast(p.agg(F.max("volume").alias("top")))).where("a <> b").select("a", "b", "n", "volume", F.round(F.pow(F.col("volume") / F.col("top"), F.lit(0.35)), 4).alias("weight"))  # one row


# findings -----------------------------------------------------------------------------------------------------

SEVERITY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'signup' THEN 'low' ELSE 'info' END"
CONF = "CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


@query(f"""WITH f AS (SELECT user_id, event_type, event_id, CASE {SEVERITY} WHEN 'critical' THEN 0.42 WHEN 'high' THEN 0.24 WHEN 'medium' THEN 0.10 WHEN 'low' THEN 0.035 ELSE 0 END AS w,
  CASE {CONF} WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END AS c FROM events),
p AS (SELECT user_id, CAST(w AS DOUBLE) * CAST(c AS DOUBLE) * pow(0.5, row_number() OVER (PARTITION BY user_id, event_type ORDER BY w DESC, event_id) - 1) AS p FROM f WHERE w > 0),
r AS (SELECT user_id, CAST(round((1 - exp(sum(ln(1 - p)))) * 100) AS BIGINT) AS risk FROM p GROUP BY user_id)
SELECT user_id, risk, n FROM r JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)""")
def noisy_or_score_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as findings, and their number, as risks come near 100."""
    e = table(spark, sf_dir, "events")
    f = e.select("user_id", "event_type", "event_id", F.expr(SEVERITY).alias("severity"), F.expr(CONF).alias("confidence"))
    return patterns.risk_score(f, "user_id", "event_type", "severity", "confidence", "event_id").join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query(f"""SELECT user_id, CAST(least(100, sum(CASE {SEVERITY} WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END)) AS BIGINT) AS risk, count(*) AS n FROM events GROUP BY user_id""")
def host_risk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as findings, and their number, as risks come near 100."""
    e = table(spark, sf_dir, "events")
    return patterns.host_risk(e.withColumn("severity", F.expr(SEVERITY)), "user_id", "severity").join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-05')
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN b.user_id IS NULL THEN 'new' WHEN a.user_id IS NULL THEN 'missing' ELSE 'common' END AS state
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return patterns.compare(e.where("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'"), e.where("ts < TIMESTAMP_NTZ '2024-01-05 00:00:00'"), ["user_id", "event_type"])


@query(f"SELECT page_id, replace(regexp_replace(url, '(?i)^http', 'hxxp'), '.', '[.]') AS indicator, replace({SQL_HOST}, '.', '[.]') AS host FROM pages")
def ioc_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.defang(F.col("url")).alias("indicator"), C.defang(C.url_host(F.col("url"))).alias("host"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || p_name AS x FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(x, '^[=+\\-@\\t\\r]') THEN '''' || x ELSE x END AS cell FROM t""")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.expr("CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", C.csv_guard(x).alias("cell"))


MADE = "CASE page_id % 6 WHEN 0 THEN 'MZ' WHEN 1 THEN '%PDF-1.7' WHEN 2 THEN '#!/bin/sh' WHEN 3 THEN 'GIF89a' WHEN 4 THEN '-----BEGIN KEY' ELSE '' END"


@query(f"""SELECT page_id, CASE WHEN x LIKE 'MZ%' THEN 'exe' WHEN starts_with(x, '%PDF') THEN 'pdf' WHEN x LIKE 'GIF89a%' THEN 'gif' WHEN x LIKE '-----BEGIN%' THEN 'pem' WHEN x LIKE '<?xml%' THEN 'xml'
  WHEN x LIKE '<!DOCTYPE html%' OR x LIKE '<html%' THEN 'html' WHEN x LIKE '#!/%' THEN 'script' END AS kind FROM (SELECT page_id, {MADE} || html AS x FROM pages)""")
def magic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.file_type(F.concat(F.expr(MADE), "html").cast("binary")).alias("kind"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, count(DISTINCT source) AS n_sources, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("sha256"), "source", "doc_id")
    by = d.groupBy("sha256", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return by.groupBy("sha256").agg(F.sum("n").alias("n"), F.count("source").alias("n_sources"), F.min("first_id").alias("first_id")).where("n >= 2")


# sequences ----------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, count(*) AS packets, CAST(greatest(max(l_linenumber) - min(l_linenumber) + 1, count(*)) AS BIGINT) AS expected,
CAST(greatest(max(l_linenumber) - min(l_linenumber) + 1, count(*)) - count(*) AS BIGINT) AS lost FROM lineitem GROUP BY ALL""")
def sequence_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("packets"), F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    want = F.greatest((F.col("b") - F.col("a") + 1).cast("long"), F.col("packets"))
    return s.select("l_orderkey", "packets", want.alias("expected"), (want - F.col("packets")).alias("lost"))


@query("""SELECT conv_id, count(*) AS n_turns, min(turn) FILTER (role = 'user') AS first_user, min(turn) FILTER (role = 'assistant') AS first_assistant, max_by(role, turn) AS last_role,
CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'unanswered' WHEN max_by(role, turn) = 'user' THEN 'open' ELSE 'answered' END AS state FROM conversations GROUP BY ALL""")
def call_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = lambda r: F.min(F.when(F.col("role") == r, F.col("turn")))
    s = c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), at("user").alias("first_user"), at("assistant").alias("first_assistant"), F.max_by("role", "turn").alias("last_role"))
    return s.withColumn("state", F.when(F.col("first_assistant").isNull(), "unanswered").when(F.col("last_role") == "user", "open").otherwise("answered"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 65536 AS src_port, l_suppkey % 65536 AS dst_port, CAST(l_quantity AS BIGINT) AS seq FROM lineitem")
def frame_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports and sequence number packed into a TCP header and read back by the decoder's expressions."""
    from ..operators.decode import number

    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.unhex(F.format_string("%04X%04X%08X%08X50180000", F.expr("l_partkey % 65536"), F.expr("l_suppkey % 65536"), F.col("l_quantity").cast("long"), F.lit(0).cast("long"))).alias("h"),
    )
    h = F.col("h")
    return rows.select("l_orderkey", "l_linenumber", number(h, F.lit(0), 2).alias("src_port"), number(h, F.lit(2), 2).alias("dst_port"), number(h, F.lit(4), 4).alias("seq"))
