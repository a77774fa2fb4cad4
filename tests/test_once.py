"""What a row is asked is asked once, and findings are folded within tasks."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from wiretide.functions import columns as C
from wiretide.plans import rule_queries, rules


def plan(df, mode="executedPlan"):
    return getattr(df._jdf.queryExecution(), mode)().toString()


def test_events_are_read_once(spark):
    events = rules.findings(spark.range(50).selectExpr("'a' capture_id", "id ts", "concat('h', id % 30) h"), "x", "X", "high", "c", F.col("h"), ["ts"])
    assert plan(rules.folded(events)).count("Range (") == 1
    got = rules.folded(events).first()
    assert got["count"] == 50 and got.hosts == sorted(f"h{i}" for i in range(30))[:20] and len(got.evidence) == 12 and got.severity == "high"
    assert rules.folded(events.limit(0)).count() == 0


def test_fold_of_a_task(monkeypatch):
    """Many findings, nulls and repeated values, in batches that are folded again and again, against plain sets."""
    monkeypatch.setattr(rules, "HELD", 64)
    pick = random.Random(3)
    text = lambda n: pick.choice([None, *[f"v{i}" for i in range(n)]])
    rows = [
        {"capture_id": pick.choice(["a", None]), "id": "r", "title": f"t{pick.randrange(3)}", "apart": str(pick.randrange(4)), "rank": pick.randrange(5), "category": "c", "confidence": pick.choice(["high", "low"]), "least": 1,
         "host": text(60), "evidence": text(40), "first": pick.random(), "last": pick.random(), "count": 1}
        for _ in range(3000)
    ]
    schema = pa.schema([(k, pa.float64() if k in ("first", "last") else pa.int32() if k in ("rank", "least") else pa.int64() if k == "count" else pa.string()) for k in rows[0]])
    out = [r for b in rules._fold_task(iter(pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=50))) for r in b.to_pylist()]
    assert len(out) <= len(rows)
    for key in {tuple(r[k] for k in rules.KEYS) for r in rows}:
        of, got = ([r for r in x if tuple(r[k] for k in rules.KEYS) == key] for x in (rows, out))
        assert sum(r["count"] or 0 for r in got) == len(of)
        for c, f in (("rank", max), ("first", min), ("last", max), ("confidence", min)):
            assert f(r[c] for r in got if r[c] is not None) == f(r[c] for r in of)
        for c, n in rules.KEPT.items():
            assert sorted({r[c] for r in got} - {None})[:n] == sorted({r[c] for r in of} - {None})[:n]


def test_requests_are_decoded_once(spark, sf_dir):
    t = {x: rule_queries.made(spark, sf_dir, x) for x in ("http_requests", "http_responses")}
    assert 0 < plan(rules.EVENTS["web.attack"](t), "optimizedPlan").count("decode(") <= 3
    for text, want in (("a%252520b+c", "a b c"), ("%41%zz", "%41%zz"), ("plain", "plain"), ("%2541%25zz", "%41%zz"), (None, None)):
        assert spark.createDataFrame([(text,)], "x string").select(C.url_decoded(F.col("x"))).first()[0] == want


def test_brands_are_sought_among_distinct_names(spark, sf_dir):
    t = {x: rule_queries.made(spark, sf_dir, x) for x in ("dns", "http_requests", "tls", "quic_hellos")}
    shown = plan(rules.EVENTS["phishing.lookalike_domain"](t))
    assert shown.rindex("levenshtein") < shown.index("Aggregate(")


def test_an_address_is_parsed_once(spark):
    df = spark.createDataFrame([(x,) for x in ("8.8.8.8", "10.0.0.1", "2001:db8::1", "2606:4700::1", "::1", "no", "1.2.3", "1::2::3", None)], "ip string")
    rows = df.select("ip", C.enriched(F.col("ip")).alias("e")).select("ip", "e.*")
    assert plan(rows, "optimizedPlan").count("RLIKE") <= 2
    got = {r.ip: r for r in rows.collect()}
    assert got["8.8.8.8"].scope == "public" and got["10.0.0.1"].scope != "public" and got["2001:db8::1"].scope != "public" and got["2606:4700::1"].scope == "public"
    assert all(got[x].scope is None and got[x].operator is None for x in ("no", "1.2.3", "1::2::3", None))
