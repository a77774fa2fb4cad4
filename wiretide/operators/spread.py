"""Intervals of keys of any size: the rows of a key lie in as many tasks as they need.

Rows are dealt by ranges of key and time, so a key that holds half of all rows holds half of all tasks.  What crosses the border
of two parts is carried by one row a part: the last time for gaps, and for greedy collapse the function that takes the time
kept last before a part to the one kept last in it.  Medians of keys too large for one task are found by counting: each round
counts a key's values in ``BINS`` equal bins and goes on in the one that holds the middle, so what is shuffled is counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.store import written
from .intervals import ratios

#: Bins that a key's values are counted in at a time, and the parts of a task's share from which a key counts as large.
BINS = 1024
SHARE = 4


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, keys: list[str], us: str, tasks: int | None = None) -> DataFrame:
    """The different times of each key with ``part``, parts being ranges of key and time of about the same size; written once, as
    the ranges of another run need not be the same.  Null times are left out."""
    n = tasks or tasks_of(df)
    times = df.select(*keys, us).where(F.col(us).isNotNull()).distinct()
    return written(times.repartitionByRange(n, *keys, us).withColumn("part", F.spark_partition_id()), "dealt")


def in_order(rows: DataFrame, keys: list[str], us: str, tasks: int | None = None) -> DataFrame:
    return rows.repartitionById(tasks or tasks_of(rows), F.col("part")).sortWithinPartitions("part", *keys, us)


def runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, tuple, np.ndarray]]:
    """(part, key, times) of the runs of (keys, time, part) that stream past in order; a run that goes on in the next batch comes in
    pieces, the next of which has the same part and key."""
    for b in batches:
        if not b.num_rows:
            continue
        t = b.column(n).to_numpy(zero_copy_only=False)
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in [*b.columns[:n], b.column(n + 1)]:
            x, y = c.slice(1), c.slice(0, len(c) - 1)
            other = pc.or_(pc.xor(pc.is_null(x), pc.is_null(y)), pc.fill_null(pc.not_equal(x, y), False))
            new[1:] |= other.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        for s, e in zip(at.tolist(), [*at[1:].tolist(), b.num_rows]):
            yield b.column(n + 1)[s].as_py(), tuple(c[s].as_py() for c in b.columns[:n]), t[s:e]


def _schema(df: DataFrame, keys: list[str], more: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField(n, t) for n, t in more])


def gaps(df: DataFrame, keys: list[str], us: str, tasks: int | None = None) -> DataFrame:
    """keys and gap, as ``intervals.gaps``, with no key in one task; written once."""
    spark, n = df.sparkSession, len(keys)
    rows = dealt(df, keys, us, tasks)
    schema = _schema(rows, keys, [("gap", T.LongType()), ("part", T.LongType()), ("first", T.LongType()), ("last", T.LongType())])
    types = [f.type for f in pa.schema([(f.name, _arrow(f.dataType)) for f in schema])]

    def table(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each part the first and the last key stand in border rows; gaps inside a part are complete
        for part, of_part in groupby(runs(batches, n), lambda r: r[0]):
            first, before, last = None, None, None
            for _, key, t in of_part:
                d = np.diff(t) if before != key else np.diff(np.concatenate(([last], t)))
                if first is None:
                    first = (key, int(t[0]))
                elif before != key and before == first[0]:
                    yield table([(*before, None, part, first[1], last)])
                before, last = key, int(t[-1])
                if len(d):
                    fixed = [pa.array([k] * len(d), y) for k, y in zip(key, types)]
                    none = pa.nulls(len(d), pa.int64())
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(d), none, none, none], names=schema.names)
            if before is not None:
                yield table([(*before, None, part, first[1] if before == first[0] else None, last)])

    # a part has one border row (one key) or two: its first key's has ``first``, its last key's has the largest key
    out = written(in_order(rows.select(*keys, us, "part"), keys, us, tasks).mapInArrow(run, schema), "gaps")
    edges = out.where("part IS NOT NULL")
    rank = F.when(F.col("first").isNotNull(), 0).otherwise(1)
    after = W.orderBy("part", rank)
    same = [F.col(k).eqNullSafe(F.lag(k).over(after)) for k in keys]
    border = edges.select(*keys, (F.col("first") - F.lag("last").over(after)).alias("gap"), *[s.alias(f"same_{i}") for i, s in enumerate(same)])
    border = border.where(" AND ".join(f"same_{i}" for i in range(n))).select(*keys, "gap")
    return written(out.where("part IS NULL").select(*keys, "gap").union(border.where("gap > 0")), "all-gaps")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def middle(values: DataFrame, keys: list[str], value: str, large: DataFrame) -> DataFrame:
    """keys and ``twice``, the sum of the two middle values, for the keys of ``large`` (keys, n, low, high), whose number is small.

    Each round counts in bins, keeps the bin that holds a rank and starts again in it: seven rounds at most for 64 bits."""
    spark = values.sparkSession
    ranks = F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    state = large.select(*keys, ranks.alias("rank"), "low", "high").distinct()
    schema = state.schema
    rows, done = state.collect(), []
    own = [F.col(f"s.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]
    on = own[0]
    for c in own[1:]:
        on = on & c
    while True:
        done += [r for r in rows if r.low == r.high]
        rows = [r for r in rows if r.low < r.high]
        if not rows:
            break
        s = spark.createDataFrame([(i, *r, -(-(r.high - r.low + 1) // BINS)) for i, r in enumerate(rows)], T.StructType([T.StructField("id", T.LongType()), *schema.fields, T.StructField("width", T.LongType())]))
        binned = values.alias("v").join(F.broadcast(s).alias("s"), on & F.col(f"v.{value}").between(F.col("s.low"), F.col("s.high"))).groupBy("s.id", F.expr(f"(v.{value} - s.low) div s.width").alias("bin")).count()
        upto = F.sum("count").over(W.partitionBy("id").orderBy("bin"))
        found = binned.withColumn("upto", upto).join(F.broadcast(s.select("id", "rank", "low", "high", "width")), "id").where("rank < upto AND rank >= upto - count")
        next_ = {r.id: (r.rank - (r.upto - r["count"]), r.low + r.bin * r.width, min(r.high, r.low + (r.bin + 1) * r.width - 1)) for r in found.collect()}
        rows = [T.Row(*r.__fields__)(*r[: len(keys)], *next_[i]) for i, r in enumerate(rows)]
        # the rank a row was asked for isn't needed once it is found: rows of one key are added up in pairs below
    sums: dict[tuple, list[int]] = {}
    for r in done:
        sums.setdefault(tuple(r[: len(keys)]), []).append(r.low)
    # an odd number of values has one middle, which counts twice
    twice = [(*k, 2 * v[0] if len(v) == 1 else sum(v)) for k, v in sums.items()]
    return spark.createDataFrame(twice, T.StructType([*schema.fields[: len(keys)], T.StructField("twice", T.LongType())]))


def medians(values: DataFrame, keys: list[str], value: str, stats: DataFrame) -> DataFrame:
    """keys and ``median`` (exact) of whole numbers; ``stats`` has keys, n, low and high.  Keys of more than a quarter of a task's
    share go through ``middle``; there are four times as many as tasks at most, so they are broadcast."""
    tasks = tasks_of(values)
    total = stats.agg(F.sum("n")).first()[0] or 0
    large = stats.where(F.col("n") > max(total // (SHARE * tasks), BINS))
    held = large.collect()
    if not held:
        return values.groupBy(*keys).agg(F.median(value).alias("median"))
    large = values.sparkSession.createDataFrame(held, large.schema)
    names = large.select(*[F.col(k).alias(f"l_{k}") for k in keys])
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"l_{k}"))
    few = values.join(F.broadcast(names), on, "left_anti").groupBy(*keys).agg(F.median(value).alias("median"))
    return few.union(middle(values, keys, value, large).select(*keys, F.col("twice") / 2))


def interval_stats(df: DataFrame, keys: list[str], us: str, least: int = 3, tasks: int | None = None) -> DataFrame:
    """As ``intervals.interval_stats``, for keys of any size.  Keys may be null, as one key."""
    g = gaps(df, keys, us, tasks)
    stats = g.groupBy(*keys).agg(
        F.count("*").alias("n_gaps"), F.avg("gap").alias("mean_us"), F.stddev_pop("gap").alias("stdev_us"), F.min("gap").alias("min_us"), F.max("gap").alias("max_us"),
    ).where(F.col("n_gaps") >= least)
    stats = written(stats, "interval-stats")

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        named = b.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        on: Column = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
        return a.join(named, on).drop(*[f"r_{k}" for k in keys])

    middle_ = written(medians(g, keys, "gap", stats.selectExpr(*keys, "n_gaps AS n", "min_us AS low", "max_us AS high")).withColumnRenamed("median", "median_us"), "medians")
    # twice the distance to the median is a whole number
    apart = join(g, join(stats.select(*keys), middle_)).select(*keys, F.abs(2 * F.col("gap") - (2 * F.col("median_us")).cast("long")).alias("apart"))
    apart = written(apart, "apart")
    span = apart.groupBy(*keys).agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high"))
    mad = medians(apart, keys, "apart", span).select(*keys, (F.col("median") / 2).alias("mad_us"))
    out = join(join(stats, middle_), mad)
    return ratios(out).select(*keys, "n_gaps", "mean_us", "median_us", "stdev_us", "min_us", "max_us", "mad_us", "cv", "mad_ratio")


def chain(t: np.ndarray, window: int) -> np.ndarray:
    """For each index, the index of the last time that is kept if the one at the index is."""
    follows = np.searchsorted(t, t + window, "right").tolist()
    n = len(t)
    out = list(range(n))
    for i in range(n - 1, -1, -1):
        if follows[i] < n:
            out[i] = out[follows[i]]
    return np.array(out)


def pieces(t: np.ndarray, window: int) -> list[tuple[int, int]]:
    """A part's function: (time, last kept) so that from a kept time before the part, the first piece whose time is over
    ``window`` after it tells the last time kept in the part; if there is none, that kept time itself stays the last."""
    upto = min(len(t), int(np.searchsorted(t, t[0] + window, "right")) + 1)
    to = t[chain(t, window)[:upto]]
    last = np.append(to[1:] != to[:-1], True)
    return list(zip(t[:upto][last].tolist(), to[last].tolist()))


def greedy(t: np.ndarray, window: int, last: int | None) -> np.ndarray:
    """The times that are kept, the one kept before being ``last``."""
    i = 0 if last is None else int(np.searchsorted(t, last + window, "right"))
    keep = []
    while i < len(t):
        keep.append(i)
        i = int(np.searchsorted(t, t[i] + window, "right"))
    return t[keep]


def kept(df: DataFrame, keys: list[str], us: str, window_us: int, tasks: int | None = None) -> DataFrame:
    """As ``intervals.kept``, for keys of any size: each part's function is made in its own task, one task goes through the parts'
    pieces in order (a few a part, as chains of kept times soon meet), and each part then starts from the time it is given.

    A part's times of one key are held in memory, eight bytes each.  Null times are left out, null keys are a key.
    """
    spark, n = df.sparkSession, len(keys)
    rows = dealt(df, keys, us, tasks).select(*keys, us, "part")
    kinds = [_arrow(rows.schema[k].dataType) for k in keys]

    def whole(of_part: Iterator[tuple[int, tuple, np.ndarray]]) -> Iterator[tuple[tuple, np.ndarray]]:
        for key, same in groupby(of_part, lambda r: r[1]):
            yield key, np.concatenate([t for _, _, t in same])

    names = [f"{side}_{k}" for side in ("first", "last") for k in keys]
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("time", T.LongType()), T.StructField("to", T.LongType()), T.StructField("single", T.BooleanType()), *[T.StructField(x, rows.schema[k].dataType) for x, k in zip(names, keys * 2)]])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, of_part in groupby(runs(batches, n), lambda r: r[0]):
            first, made, last, end = None, [], None, 0
            for key, t in whole(of_part):
                if first is None:
                    first, made = key, pieces(t, window_us)
                    end = int(t[chain(t, window_us)[0]])
                    start = end
                else:
                    end = int(greedy(t, window_us, None)[-1])
                last = key
            # without an entry: what the first key ends with, and what the last one does
            out = [(part, None, start, last == first, *first, *last), (part, None, end, None, *first, *last), *((part, a, b, last == first, *first, *last) for a, b in made)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *kinds, *kinds]
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 10_000]), types)], names=schema.names)

    made = written(in_order(rows, keys, us, tasks).mapInArrow(functions, schema), "functions")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        before, exit_ = None, None
        for part, of_part in groupby(lists, lambda r: r[0]):
            fresh = next(of_part)
            end = next(of_part)
            first, last = fresh[4 : 4 + n], fresh[4 + n :]
            entry = exit_ if before == first else None
            to = fresh[2]
            if entry is not None:
                to = next((r[2] for r in of_part if r[1] > entry + window_us), entry)
            for _ in of_part:
                pass
            before, exit_ = last, to if fresh[3] else end[2]
            if entry is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([entry])], names=["part", "entry"])

    # rows without an entry first: those of the first key (single is set), then those of the last one
    lined = made.repartition(1).sortWithinPartitions("part", F.col("time").asc_nulls_first(), F.col("single").asc_nulls_last())
    entries = {r.part: r.entry for r in lined.mapInArrow(scan, "part long, entry long").collect()}
    shared = spark.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, of_part in groupby(runs(batches, n), lambda r: r[0]):
            for i, (key, t) in enumerate(whole(of_part)):
                t = greedy(t, window_us, shared.value.get(part) if i == 0 else None)
                if len(t):
                    yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(t), y) for k, y in zip(key, kinds)), pa.array(t)], names=[*keys, us])

    return in_order(rows, keys, us, tasks).mapInArrow(run, _schema(rows, keys, [(us, T.LongType())]))
