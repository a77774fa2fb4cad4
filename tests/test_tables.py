"""Each query over the driver's tables against its SQL."""

import os
from collections import Counter

import duckdb
import pytest

from wiretide import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, sf_dir, con, name):
    df = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    r = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = Counter(tuple(row[names.index(c)] for c in cols) for row in r.fetchall())
    assert Counter(map(tuple, df.select(*cols).collect())) == want


def test_every_query_is_registered(spark, sf_dir):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_whole_scores_see_all_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for name in ("noisy_or_score_whole", "host_risk_whole"):
        rows = plans.QUERIES[name](spark, sf_dir).collect()
        assert sum(r.n for r in rows) == e.where("user_id IS NOT NULL").count()
        assert len(rows) == e.select("user_id").distinct().count()
