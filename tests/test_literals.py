"""Literals in one pass, and signatures screened by them."""

import random
import re

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wiretide.operators import literals, reassembly


def brute(data, words):
    return sorted({w.id for w in words if (w.text.lower() in data.lower() if w.fold else w.text in data)})


def test_ids_against_brute_force():
    rng = random.Random(5)
    words = [literals.Literal(i % 9, bytes(rng.choice(b"abAB\x00\xe9\xc9") for _ in range(rng.randint(1, 5))), bool(i % 2)) for i in range(40)]
    tree = literals.automaton(words)
    values = [None, b"", *[bytes(rng.choice(b"abAB\x00\xe9\xc9 ") for _ in range(rng.randint(0, 30))) for _ in range(400)]]
    got = literals.ids_in(pa.array(values, pa.binary()), tree).to_pylist()
    assert got == [brute(v or b"", words) for v in values]
    cut = literals.ids_in(pa.array(values, pa.binary()), tree, 7).to_pylist()
    assert cut == [brute((v or b"")[:7], words) for v in values]
    assert literals.ids_in(pa.array([b"abc"]), literals.automaton([])).to_pylist() == [[]]


def test_every_match_has_what_its_pattern_needs():
    pairs = [(p, reassembly.NEEDED[name][i]) for name, _, _, patterns, _, _ in reassembly.SIGNATURES for i, p in enumerate(patterns)]
    assert sum(len(n) for n in reassembly.NEEDED.values()) == len(pairs)
    for pattern, needs in pairs:

        @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True, alphabet=st.characters(codec="latin-1")))
        def has(text):
            assert any(n.encode() in text.encode("latin-1").lower() for n in needs), (pattern, text)

        has()


def test_columns(spark):
    df = spark.createDataFrame([(1, "Éa LOGIN", b"xUPX0"), (2, None, None), (3, "", b""), (4, "login" * 300_000, b"upx0")], "id long, text string, data binary")
    words = [literals.Literal(3, b"login", True), literals.Literal(1, "Éa".encode()), literals.Literal(2, b"UPX0")]
    assert {r.id: r.got for r in literals.with_literals(df, "text", words, "got").collect()} == {1: [1, 3], 2: [], 3: [], 4: [3]}
    assert {r.id: r.got for r in literals.with_literals(df, "data", words, "got").collect()} == {1: [2], 2: [], 3: [], 4: []}
    assert literals.with_literals(df.limit(0), "text", words).collect() == []


def test_signatures_as_by_single_tests(spark):
    """Random mixtures of words and parts of patterns: the same hits as by trying each test on each file."""
    rng = random.Random(11)
    parts = [w for _, _, words, _, _, _ in reassembly.SIGNATURES for w in words] + [n for some in reassembly.NEEDED.values() for needs in some for n in needs]
    parts += ["eval( $_GET", "All your files are encrypted", "vssadmin delete shadows", "shell (", "AKIA" + "Z" * 16, "ghp_" + "a" * 36, '"pool" :', "nc -e /bin/sh", "iwr (", "powershell -e " + "A" * 41, "%PDF-1.4", "\n", " "]
    rows = []
    for i in range(600):
        some = [rng.choice(parts) for _ in range(rng.randint(0, 6))]
        text = rng.choice(["", " ", "-"]).join(x.upper() if rng.random() < 0.2 else x for x in some)
        rows.append(("c", "HTTP", "a", "b", str(i), 0.0, i, (rng.choice(["%PDF ", "", "PK\x03\x04 word/ "]) + text).encode("latin-1")))
    df = spark.createDataFrame(rows, "capture_id string, protocol string, source string, target string, name string, ts double, number long, data binary")
    head = F.decode("data", "ISO-8859-1")
    plain = []
    for name, _, words, patterns, least, types in reassembly.SIGNATURES:
        tests = [head.contains(w).cast("int") for w in words] + [head.rlike(p).cast("int") for p in patterns]
        hit = sum(tests[1:], tests[0]) >= (least or len(tests))
        plain.append(F.when((F.col("kind").isin(*types) & hit) if types else hit, name))
    got = reassembly.described(df).select("number", "kind", F.sort_array("signatures.name").alias("got"))
    both = df.join(got, "number").select("number", "got", F.sort_array(F.array_compact(F.array(*plain))).alias("want")).collect()
    assert len(both) == 600 and [r.number for r in both if r.got != r.want] == []
    assert len({x for r in both for x in r.want}) >= 15
