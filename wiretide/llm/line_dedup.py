"""Site-relative line removal, with DataFrame functions only.

Lines of a page are what its block elements part.  For each host the pages that contain a line are counted (a page
counts once; partial counts are summed before the shuffle) and divided by the host's pages; a line over the ratio is
boilerplate.  A host can have no more than (mean distinct lines a page) / ratio such lines, so they travel as one array for each
host.  Pages are parsed once; where all those arrays are small, by their summed bytes, they go to the pages, which then
aren't shuffled, else both are dealt by host and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Tasks to which the pages of one host are dealt.
SALTS = 32
#: Applied in order, each to the text that the one before leaves; the second value takes the match's place.
MARKUP = (
    (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", ""),
    (r"(?i)</?(?:address|article|aside|blockquote|body|br|div|dd|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user and port; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":[0-9]*$", ""))
    return F.when(host != "", host)


def lines_of(html: Column) -> Column:
    """The page's lines, trimmed of spaces and tabs, without empty ones."""
    text = F.coalesce(html, F.lit(""))
    for pattern, to in MARKUP:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    lines = F.transform(F.split(text, "[\r\n]+"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    return F.filter(lines, lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float, min_pages: int, least: int, broadcast_bytes: int) -> DataFrame:
    """(host, lines) of pages -> (host, common): each host's lines that go.  Where the hosts' page counts are small they go to the
    lines, which are then dealt once, by host and line; which join is taken isn't left to what happens to be done first."""
    total = materialise(pages.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages), "sites")
    held = pages.where("host IS NOT NULL").select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    size = total.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    rows = held.join(F.broadcast(total) if size <= broadcast_bytes else total, "host").where((F.col("n") > ratio * F.col("pages")) & (F.col("n") >= least))
    return rows.groupBy("host").agg(F.collect_list("line").alias("common"))


def drop_site_lines(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 0.3, min_pages: int = 3, least: int = 2, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: id, host, n_lines, n_dropped and text, the lines that stay.

    A line goes if its host has ``min_pages`` pages or more, and over ``ratio`` of them and ``least`` pages at least
    contain it: what stands on one page only is that page's content.  Pages without a host keep all lines; null and empty pages have none but count for their host.  Repeated rows count as pages each.
    An empty table gives no rows.  Very long pages are read whole.  Other columns are left out.
    """
    pages = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines"))
    pages = materialise(pages, "lines")
    common = boilerplate(pages, ratio, min_pages, least, broadcast_bytes)
    common = materialise(common, "boilerplate")
    size = common.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("common", "\n")) + 16 * F.size("common"))).first()[0] or 0
    if size <= broadcast_bytes:
        rows = pages.join(F.broadcast(common), "host", "left")
    else:  # a hot host's pages are dealt to several tasks
        dealt = pages.withColumn("salt", F.pmod(F.xxhash64("id", "lines"), F.lit(SALTS)))
        rows = dealt.join(common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    rows = rows.withColumn("kept", F.expr("CASE WHEN common IS NULL THEN lines ELSE filter(lines, x -> NOT array_contains(common, x)) END"))
    return rows.select(F.col("id").alias(id_col), "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
