"""Regular intervals: gap statistics, periodicity scores, greedy collapse of close events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def gaps(df: DataFrame, keys: list[str], us: str) -> DataFrame:
    """keys and gap, the positive differences of consecutive times (microseconds) of each key."""
    before = F.lag(us).over(W.partitionBy(*keys).orderBy(us))
    return df.select(*keys, (F.col(us) - before).alias("gap")).where("gap > 0")


def interval_stats(df: DataFrame, keys: list[str], us: str, least: int = 3) -> DataFrame:
    """Per key with ``least`` positive gaps: n_gaps, mean, median, population deviation, their ratio, the median absolute
    deviation and its ratio to the median, least and most gap, in microseconds."""
    g = gaps(df, keys, us)
    stats = g.groupBy(*keys).agg(
        F.count("*").alias("n_gaps"), F.avg("gap").alias("mean_us"), F.median("gap").alias("median_us"), F.stddev_pop("gap").alias("stdev_us"),
        F.min("gap").alias("min_us"), F.max("gap").alias("max_us"),
    ).where(F.col("n_gaps") >= least)
    mad = g.join(stats.select(*keys, "median_us"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("gap") - F.col("median_us"))).alias("mad_us"))
    return ratios(stats.join(mad, keys))


def ratios(out: DataFrame) -> DataFrame:
    """cv and mad_ratio beside the statistics that they are made of."""
    return out.withColumn("cv", F.when(F.col("mean_us") > 0, F.col("stdev_us") / F.col("mean_us")).otherwise(0.0)).withColumn(
        "mad_ratio", F.when(F.col("median_us") > 0, F.col("mad_us") / F.col("median_us")).otherwise(1.0)
    )


def periodicity(count: Column, mean_bytes: Column, external: Column, cv: Column, mad_ratio: Column) -> Column:
    """Points for steadiness, number, smallness and leaving the network."""
    return (
        F.when(cv < 0.15, 40).when(cv < 0.3, 28).otherwise(15)
        + F.when(mad_ratio < 0.1, 25).when(mad_ratio < 0.25, 15).otherwise(0)
        + F.when(count >= 40, 20).when(count >= 20, 12).when(count >= 12, 6).otherwise(0)
        + F.when(mean_bytes < 2000, 10).otherwise(0)
        + F.when(external, 10).otherwise(0)
    )


def periodic(stats: DataFrame) -> Column:
    """Whether the intervals are steady enough to be called periodic."""
    return (F.col("n_gaps") >= 7) & F.col("median_us").between(900_000, 86_400_000_000) & (F.col("cv") <= 0.55) & (F.col("mad_ratio") <= 0.45)


def kept(df: DataFrame, keys: list[str], us: str, window_us: int) -> DataFrame:
    """Keys and time of the events that are kept: the first of each key and each that is over ``window_us`` after the last
    kept one.  Rows stream past in order of key and time, so a key of any size needs one time in memory."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(us, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(len(keys)).to_numpy(zero_copy_only=False)
            new = np.zeros(b.num_rows, bool)
            for c in b.columns[: len(keys)]:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            first = [c[0].as_py() for c in b.columns[: len(keys)]]
            begins = np.concatenate(([0], np.flatnonzero(new)))
            keep = []
            for s, e in zip(begins.tolist(), [*begins[1:].tolist(), b.num_rows]):
                i = s + int(np.searchsorted(t[s:e], last + window_us, "right")) if s == 0 and first == key else s
                while i < e:
                    keep.append(i)
                    last = int(t[i])
                    i += int(np.searchsorted(t[i:e], last + window_us, "right"))
            key = [c[b.num_rows - 1].as_py() for c in b.columns[: len(keys)]]
            yield b.take(pa.array(keep, pa.int64()))

    return df.select(*keys, us).repartition(*keys).sortWithinPartitions(*keys, us).mapInArrow(run, schema)


def collapse(df: DataFrame, key: str, us: str, window_us: int) -> DataFrame:
    """Per key: n_events, n_kept, first_us, last_us, where an event is kept if it is over ``window_us`` after the last
    kept one.  Rows stream past in order of key and time, so a key of any size needs one counter."""
    schema = T.StructType([df.schema[key], *[T.StructField(n, T.LongType()) for n in ("n_events", "n_kept", "first_us", "last_us")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # key, events, kept, first, last kept
        for b in batches:
            done = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or k != state[0]:
                    if state:
                        done.append(state)
                    state = [k, 1, 1, t, t]
                else:
                    state[1] += 1
                    if t - state[4] > window_us:
                        state[2] += 1
                        state[4] = t
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], b.column(0).type)] + [pa.array([d[i] for d in done], pa.int64()) for i in range(1, 5)], names=schema.names)
            kind = b.column(0).type
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], kind)] + [pa.array([state[i]], pa.int64()) for i in range(1, 5)], names=schema.names)

    return df.select(key, us).repartition(key).sortWithinPartitions(key, us).mapInArrow(run, schema)
