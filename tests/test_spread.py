"""Intervals of keys that lie in many tasks: the values of the plain operators."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from wiretide.operators import intervals, spread


def brute_kept(times, window):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] > window:
            out.append(t)
    return out


@pytest.fixture
def frame(spark):
    rng = random.Random(4)
    rows = [(0, "a", rng.randrange(10**9)) for _ in range(6000)] + [(0, "b", rng.randrange(2000)) for _ in range(3000)]  # one sparse and one dense hot key
    rows += [(k, rng.choice("ab"), rng.randrange(10**7)) for k in range(1, 60) for _ in range(rng.randrange(1, 60))] + [(None, "a", t) for t in (5, 5, 9, 40, 41)] + [(3, None, 7), (4, "a", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, c string, us long").repartition(5)


def by_key(rows):
    out = {}
    for *k, t in rows:
        if t is not None:
            out.setdefault(tuple(k), set()).add(t)
    return out


@pytest.mark.parametrize("tasks", [1, 3, 16])
@pytest.mark.parametrize("window", [0, 300, 5000, 10**6])
def test_kept(frame, tasks, window):
    rows, df = frame
    got = {}
    for r in spread.kept(df, ["k", "c"], "us", window, tasks).collect():
        got.setdefault((r.k, r.c), []).append(r.us)
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_kept(v, window) for k, v in by_key(rows).items()}


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_interval_stats(frame, monkeypatch, bins):
    monkeypatch.setattr(spread, "BINS", bins)
    rows, df = frame
    got = {(r.k, r.c): r for r in spread.interval_stats(df, ["k", "c"], "us", tasks=9).collect()}
    want = {}
    for k, v in by_key(rows).items():
        t = sorted(v)
        g = [b - a for a, b in zip(t, t[1:])]
        if len(g) >= 3:
            want[k] = g
    assert got.keys() == want.keys()
    for k, g in want.items():
        r, m = got[k], statistics.median(g)
        assert (r.n_gaps, r.median_us, r.min_us, r.max_us) == (len(g), m, min(g), max(g))
        assert r.mad_us == statistics.median(abs(x - m) for x in g)
        assert r.mean_us == pytest.approx(statistics.fmean(g)) and r.stdev_us == pytest.approx(statistics.pstdev(g))
    plain = {(r.k, r.c): r for r in intervals.interval_stats(df.where("k IS NOT NULL AND c IS NOT NULL"), ["k", "c"], "us").collect()}
    for k, r in plain.items():
        assert r.mad_ratio == got[k].mad_ratio and r.cv == pytest.approx(got[k].cv) and r.asDict().keys() == got[k].asDict().keys()


def test_a_hot_key_lies_in_many_parts(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 500).alias("k"), (F.col("id") * 7919 % 10_000_019).alias("us"))
    parts = spread.dealt(df, ["k"], "us", 16)
    sizes = sorted(r["count"] for r in parts.groupBy("part").count().collect())
    assert len(sizes) >= 14 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert parts.where("k = 0").select("part").distinct().count() >= 6
    # each part is a task, in order
    found = spread.in_order(parts, ["k"], "us", 16).withColumn("task", F.spark_partition_id())
    assert found.groupBy("task").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_nothing(spark):
    none = spark.createDataFrame([], "k long, us long")
    assert spread.kept(none, ["k"], "us", 5).count() == 0
    assert spread.interval_stats(none, ["k"], "us").count() == 0
    assert [tuple(r) for r in spread.kept(spark.createDataFrame([(1, 5)], "k long, us long"), ["k"], "us", 5).collect()] == [(1, 5)]
