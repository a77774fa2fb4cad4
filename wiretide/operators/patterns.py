"""Shapes that most detections share: fan-out, rates, rare values, scores, differences, timelines, graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.columns import by_map, let


def fan_out(df: DataFrame, keys: list[str], target: str, least: int, name: str = "n_targets") -> DataFrame:
    """Keys that reach ``least`` distinct targets.  Distinct pairs first: a hot key is spread by its targets."""
    return df.select(*keys, target).where(F.col(target).isNotNull()).distinct().groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) >= least)


def share(df: DataFrame, keys: list[str], hit: Column, least: int, over: float) -> DataFrame:
    """Keys with ``least`` rows of which more than the share ``over`` are hits."""
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(hit).alias("hits"))
    return out.where((F.col("total") >= least) & (F.col("hits") > over * F.col("total")))


def burst(df: DataFrame, keys: list[str], us: str, least: int, per_second: float, least_span_s: float = 1.0) -> DataFrame:
    """Keys with ``least`` rows at ``per_second`` or more over their span (a second at least)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    span = F.greatest((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(least_span_s))
    return out.withColumn("rate", F.col("n") / span).where((F.col("n") >= least) & (F.col("rate") >= per_second))


def rare(df: DataFrame, value: str, most: int, least_distinct: int, order: str) -> DataFrame:
    """Values seen ``most`` times at most, where there are over ``least_distinct`` values and the rare ones have under half of
    the rows; ``sample`` is the least ``order`` of each."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("sample"))
    whole = counts.agg(F.count("*").alias("kinds"), F.sum("n").alias("rows"), F.sum(F.when(F.col("n") <= most, F.col("n")).otherwise(0)).alias("few"))
    return counts.crossJoin(F.broadcast(whole)).where((F.col("n") <= most) & (F.col("kinds") > least_distinct) & (F.col("few") < 0.5 * F.col("rows"))).select(value, "n", "sample")  # one row


def risk_score(findings: DataFrame, key: str, family: str, severity: str, confidence: str, order: str) -> DataFrame:
    """Per key the noisy-or of its findings in percent: severity times confidence, halved with each further one of a
    family, strongest first."""
    weight = by_map(F.col(severity), fixed.RISK_WEIGHTS)
    f = findings.withColumn("__w", weight).where("__w > 0")
    place = F.row_number().over(W.partitionBy(key, family).orderBy(F.col("__w").desc(), order)) - 1
    part = F.col("__w") * F.coalesce(by_map(F.col(confidence), fixed.CONFIDENCE), F.lit(0.75)) * F.pow(F.lit(0.5), place)
    return f.withColumn("__p", part).groupBy(key).agg(F.round((1 - F.exp(F.sum(F.log(1 - F.col("__p"))))) * 100).cast("long").alias("risk"))


def host_risk(findings: DataFrame, host: str, severity: str) -> DataFrame:
    """Per host the summed weights of the findings that name it, 100 at most."""
    return findings.groupBy(host).agg(F.least(F.sum(by_map(F.col(severity), fixed.HOST_WEIGHTS)), F.lit(100)).cast("long").alias("risk"))


def compare(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state: new, missing or common."""
    a, b = now.select(*keys).distinct().withColumn("__a", F.lit(1)), before.select(*keys).distinct().withColumn("__b", F.lit(1))
    state = F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "missing").otherwise("common")
    return a.join(b, keys, "full").withColumn("state", state).select(*keys, "state")


def pair_volume(df: DataFrame, a: str, b: str, size: str) -> DataFrame:
    """Rows and summed size of each unordered pair."""
    return df.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("n"), F.sum(size).alias("volume"))


def domain_matches(names: DataFrame, name: str, listed: DataFrame, entry: str) -> DataFrame:
    """Names of which they or a parent (of two labels at least) are listed, with the longest listed one."""
    parts = F.split(F.lower(name), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = names.select(name, F.explode(parents).alias("__p"))
    hits = rows.join(listed.select(F.lower(entry).alias("__p")).distinct(), "__p")
    return hits.groupBy(name).agg(F.max_by("__p", F.length("__p")).alias("listed"))


def imitates(name: Column, brands: tuple[str, ...] = fixed.BRANDS) -> Column:
    """The first brand within an edit distance of 1 or 2 of the name's last two labels; null for a brand itself."""

    def first(tail: Column) -> Column:
        near = [F.when((F.abs(F.length(tail) - len(b)) <= 2) & F.levenshtein(tail, F.lit(b), 2).between(1, 2), F.lit(b)) for b in brands]
        return F.when(~tail.isin(*brands), F.coalesce(*near))

    return let(F.split(name, r"\."), lambda p: F.when(F.size(p) >= 2, let(F.array_join(F.slice(p, -2, 2), "."), first)))


def matched(text: Column, patterns: tuple = fixed.WEB_PATTERNS) -> Column:
    """Array of the titles whose pattern the text has."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(title)) for title, _, _, p in patterns]), lambda x: x.isNotNull())


def buckets(df: DataFrame, us: str, width_us: int, *aggs: Column) -> DataFrame:
    return df.groupBy(F.floor(F.col(us) / width_us).alias("bucket")).agg(*aggs)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
