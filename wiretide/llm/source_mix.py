"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the mix takes the point frac(i / golden ratio) through the sources' cumulated targets; the rank of a slot
among its source's slots is the block that it takes.  Each source's documents, in an order shuffled by a hash, are a
stream of words passed over twice and cut into equal blocks, to which the ranked slots are joined.

Ranks and running sums are made in two levels (within a bucket, then over the buckets' sums), so a source with a third
of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, fresh_prefix, materialise

WEIGHTS = (5, 2, 1)
EPOCHS = 2
GOLDEN = 0.6180339887498949
#: Leading digits by which a source's stream is cut for running sums: 4,096 parts.
BUCKET_DIGITS = 3
#: Parts of [0, 1) by which points meet their source.
BINS = 4096
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text, null: 0.  Counts the places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(id_: Column, text: Column, seed: int) -> Column:
    """A document's place in its source's stream: hex digits by id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_num: int = 3, share_den: int = 2, epochs: int = EPOCHS) -> DataFrame:
    """(source, size) rows -> source, source_size, rank (code point order, null last), target.

    The mix has share_num / share_den of all words.  A source's target is its weight's share, at most ``epochs``
    times its size; what is over is shared again by weight: sources are taken in order of size per weight, and each
    stops at its cap while the even share of the rest lies above it.  The table has one row for each source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    # s / w ascending, compared in whole numbers by the weights' product
    unit = 1
    for w in weights:
        unit *= w
    src = src.withColumn("per", F.col("source_size") * (F.lit(unit) / F.col("w")).cast("long"))
    order = W.orderBy("per", "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share_num * F.sum("source_size").over(whole) - share_den * epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    src = src.withColumn("left", left).withColumn("wsum", F.sum("w").over(rest))
    # capped: den * epochs * s * wsum <= left * w
    src = src.withColumn("capped", share_den * epochs * F.col("source_size").cast("decimal(38,0)") * F.col("wsum") <= F.col("left").cast("decimal(38,0)") * F.col("w"))
    open_ = src.where("NOT capped").agg(F.min_by("left", F.struct("per", "rank")).alias("o_left"), F.min_by("wsum", F.struct("per", "rank")).alias("o_wsum"))
    return src.crossJoin(F.broadcast(open_)).select(  # of one row
        "source", "source_size", "rank",
        F.when(F.col("capped") | F.col("o_wsum").isNull(), (epochs * F.col("source_size")).cast("double"))
        .otherwise(F.col("w").cast("double") * F.col("o_left").cast("double") / (share_den * F.col("o_wsum")).cast("double")).alias("target"),
    )


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(rank, target) -> (rank, block, slot): the blocks that the slots take, each block of a source at most once.

    A source has as many slots as points fall into its part of [0, 1), to within a few blocks its target.
    """
    t = targets.where("target > 0").withColumn("hi", F.sum("target").over(W.orderBy("rank")))
    total = t.agg(F.max("hi")).first()[0]
    if total is None:
        return targets.select("rank", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot")).limit(0)
    t = t.select("rank", ((F.col("hi") - F.col("target")) / total).alias("lo"), (F.col("hi") / total).alias("hi"))
    t = t.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1)))))
    product = F.col("id") * F.lit(GOLDEN)
    s = targets.sparkSession.range(max(1, math.floor(total / block + 0.5))).withColumn("u", product - F.floor(product)).withColumn("bin", F.floor(F.col("u") * BINS))
    s = s.join(t, "bin").where("u >= lo AND u < hi")
    s = s.withColumn("chunk", F.floor(F.col("id") / CHUNK)).select("rank", "chunk", "id")
    sums = s.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    first = sums.select("rank", "chunk", (F.sum("n").over(W.partitionBy("rank").orderBy("chunk")) - F.col("n")).alias("first"))
    inner = s.withColumn("r", F.row_number().over(W.partitionBy("rank", "chunk").orderBy("id")) - 1)
    return inner.join(first, ["rank", "chunk"]).select("rank", (F.col("first") + F.col("r")).alias("block"), F.col("id").alias("slot"))


def stream_places(rows: DataFrame, by: str, size: str, order: list[Column]) -> DataFrame:
    """rows and ``at``: the sum of ``size`` of the rows of the same ``by`` that come before, in order of hex digits."""
    rows = rows.withColumn("__b", F.substring(order[0], 1, BUCKET_DIGITS))
    sums = rows.groupBy(by, "__b").agg(F.sum(size).alias("__n"))
    first = sums.select(by, "__b", (F.sum("__n").over(W.partitionBy(by).orderBy("__b")) - F.col("__n")).alias("__first"))
    inner = rows.withColumn("__in", F.sum(size).over(W.partitionBy(by, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(size))
    return inner.join(first, [by, "__b"]).withColumn("at", F.col("__first") + F.col("__in")).drop("__b", "__n", "__first", "__in")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, seed: int = 42, keep: list[str] | None = None
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, the words that the mix takes of the document, and slot,
    the first place of the mix's order that takes any of them (null if none does).

    ``taken`` is at most twice the size, and a source's sum is within a few blocks of its target; larger blocks make
    fewer slots for a larger mix.  Null, empty and wordless texts have size 0 and nothing taken; null is a
    source of its own, last.  Rows that repeat an id take part each, in an order by a hash of id and text.  An empty table gives no rows.
    """
    extra = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep or [])]
    docs = df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), shuffled(F.col(id_col), F.col(text_col), seed).alias("h"), *extra)
    docs = materialise(docs, "sizes")
    targets = materialise(source_targets(docs), "targets")
    docs = docs.join(targets, docs.source.eqNullSafe(targets.source)).drop("source")
    placed = materialise(stream_places(docs, "rank", "size", [F.col("h"), F.col("__id")]).withColumn("row", F.monotonically_increasing_id()), "places")
    # a document's blocks in both passes, and the words it has in each
    pass_ = placed.where("size > 0").select("row", "rank", "size", F.explode(F.array(F.col("at"), F.col("at") + F.col("source_size"))).alias("a"))
    parts = pass_.select("row", "rank", "a", (F.col("a") + F.col("size")).alias("e"), F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block))).alias("block"))
    parts = parts.select("row", "rank", "block", (F.least("e", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)).alias("words"))
    got = parts.join(schedule(targets, block), ["rank", "block"]).groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    return placed.join(got, "row", "left").select(
        F.col("__id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot", *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep or [])]
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, slot: str | None = None) -> DataFrame:
    """The mix as documents, all columns of df: each row as often as it is taken, to whole copies (half up).

    ``slot`` names a column for the first slot that takes the document; sorted by it, rows stand in the order of the mix.
    A document that the mix cuts is the last of its source's stream, so a source is off by one document at most.
    Rows equal in id, source and text share what they are given alike.  Rows without words are in no mix, so a table
    without words, or an empty one, gives none.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("t"))
    take = mix(rows, "id", "text", "source", block, keep=["t", "source"])
    times = take.where("size > 0").groupBy("id", "t", "source").agg(F.sum("taken").alias("k"), F.sum("size").alias("z"), F.min("slot").alias("slot"))
    p = fresh_prefix(df.columns, "m")
    times = times.withColumn("c", F.floor((2 * F.col("k") + F.col("z")) / (2 * F.col("z")))).where("c > 0").select(*[F.col(c).alias(p + c) for c in ("id", "t", "source", "c", "slot")])
    hashed = df.withColumn(p + "h", F.xxhash64(text_col))
    on = hashed[id_col].eqNullSafe(F.col(p + "id")) & (F.col(p + "h") == F.col(p + "t")) & hashed[source_col].eqNullSafe(F.col(p + "source"))
    again = hashed.join(times, on).withColumn(p + "again", F.explode(F.sequence(F.lit(1).cast("long"), F.col(p + "c"))))
    return again.select(*df.columns, *([F.col(p + "slot").alias(fresh(df.columns, slot))] if slot else []))
