"""Vector codes, language identification and fill-in-middle: brute force, held-out accuracy, round trips, awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretide.llm import fill_middle, language_id, queries, vector_codes

CLASH = ["id", "label_", "vector", "of", "salt", "salt_", "code", "error", "n", "form", "output", "cut", "spm", "a", "b", "text_", "held_out", "h", "rank", "score"]


def with_clash(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


# vector codes -------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale=256):
    good = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(v) for _, v, _ in good] + [1]) // parts) * parts
    x = [[max(-(1 << 26), min(1 << 26, math.floor(c * scale))) for c in v] + [0] * (width - len(v)) for _, v, _ in good]
    order = sorted(range(len(good)), key=lambda r: (good[r][0] is None, good[r][0] or 0, [c for c in good[r][1]]))[:entries]
    w = width // parts
    cut = [[tuple(r[p * w : (p + 1) * w]) for p in range(parts)] for r in x]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for r in cut:
                groups.setdefault(near(p, r[p])[1], []).append(r[p])
            new.append([tuple(sum(c) // len(groups[i]) for c in zip(*groups[i])) if i in groups else e for i, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(p, r[p]) for p in range(parts)] for r in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = Counter()
    for (_, _, k), e in zip(good, errors):
        by[k] += e
    return Counter((i, "".join(f"{j:02x}" for _, j in f), e, by[k], sha) for (i, _, k), f, e in zip(good, found, errors))


def test_nearest_keeps_the_lower_index_of_ties():
    rng = np.random.default_rng(1)
    for wide, most in ((1, 3), (2, 2), (4, 1), (4, 60)):
        points = rng.integers(-most, most + 1, (64, wide))
        x = rng.integers(-most - 1, most + 2, (500, wide))
        far = ((x[:, None] - points) ** 2).sum(2)
        who, d = vector_codes.nearest(vector_codes.grow(points), x)
        assert (who == far.argmin(1)).all() and (d == far.min(1)).all()


VECTORS = [
    (3, [0.5, -0.5, 1.0, 2.0], 1), (1, [0.25, 0.25, -0.25, 0.0], None), (1, [0.25, 0.25, -0.25, 0.0], None), (None, [9.0, 9.0, 9.0, 9.0], 2), (7, None, 1), (8, [1.0, None, 1.0, 1.0], 1),
    (9, [math.nan, 0.0, 0.0, 0.0], 1), (10, [0.0, math.inf, 0.0, 0.0], 1), (11, [1e30, -1e30, 0.0, -0.001], 3), (12, [0.5, 0.5], None), (13, [], 1), (14, [-0.0, 0.1, 0.2, 0.3], 1), (2, [0.5, -0.5, 1.0, 2.0], 2),
] + [(100 + i, [((i * 7919 + j * 104729) % 1000 - 500) / 300 for j in range(4)], i % 3) for i in range(150)]


@pytest.mark.parametrize("parts,entries,rounds", [(2, 4, 2), (4, 16, 3), (2, 200, 1), (3, 5, 2)])
def test_vector_codes_brute_force(spark, parts, entries, rounds):
    df = with_clash(spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int")).repartition(3)
    out = vector_codes.vector_codes(df, parts=parts, entries=entries, rounds=rounds)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, out.collect())) == brute_codes(VECTORS, parts, entries, rounds)


def test_vector_codes_salted_labels_and_nothing(spark, sf_dir, monkeypatch):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int")
    want = Counter(map(tuple, vector_codes.vector_codes(df, parts=2, entries=4).collect()))
    monkeypatch.setattr(vector_codes, "LABELS", 1)
    assert Counter(map(tuple, vector_codes.vector_codes(df, parts=2, entries=4).collect())) == want
    for none in (df.limit(0), df.where("vec_id IN (7, 8, 9, 10)")):
        out = vector_codes.vector_codes(none)
        assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.vector_codes(df, entries=300)


def test_vector_codes_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert Counter(map(tuple, queries.op11_vector_codes(spark, sf_dir).collect())) == brute_codes(rows, 16, 64, 2)


# language -----------------------------------------------------------------------------------------------------


def test_grams_are_those_of_letters():
    def brute(text):
        a = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip()
        return {(f" {a} ")[i : i + n] for n in range(1, 5) for i in range(len(a) + 3 - n)} if a else set()

    for text in ("", "12 !", "a", "Ab,ab  9AB", "Größe ñandú", "ﬁ İ 한국어 𝒳y", " lead and trail "):
        want, got = brute(text), np.count_nonzero(language_id.grams(text))
        assert got <= len(want) and got >= len(want) - 1 and (got > 0) == (len(want) > 0), text
    assert (language_id.grams("Ein Haus") == language_id.grams("1: ein... HAUS!\n")).all()
    a, b = (set(np.flatnonzero(language_id.grams(x))) for x in ("xyz", "xyz xyz abc"))
    assert a < b


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.op12_language_id(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r.doc_id: r for r in out.collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert rows.keys() == truth.keys() and len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items()) and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i, r in rows.items() if r.held_out]
    assert len(held) > 20 and sum(rows[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)


LANGS = [("the quick brown fox and the lazy dog of the house", "en"), ("der schnelle braune fuchs und der faule hund von nebenan", "de"), ("le renard brun et rapide saute par dessus le chien", "fr")]


def test_language_awkward_rows(spark):
    rows = [(i, " ".join(LANGS[i % 3][0].split()[(i + j) % 8] for j in range(30)), LANGS[i % 3][1] if i % 7 else None) for i in range(200)]
    rows += [(None, LANGS[0][0], "en"), (None, None, None), (1000, None, "en"), (1001, "", "de"), (1002, "12 34 !?", "de"), (1003, "der hund und der fuchs " * 100_000, None), (1003, "dog", "en"), (1003, "dog", "en"), (1004, "ß", None)]
    df = with_clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = language_id.identify_language(df)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) and out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = {r[0]: r for r in got}
    for i in (1000, 1001, 1002):
        assert by[i][2:] == ("und", 0.0)
    assert {r[2] for r in got if r[0] is None} == {"en", "und"} and not any(r[1] for r in got if r[0] is None)
    assert sum(by[i][2] == LANGS[i % 3][1] for i in range(200)) >= 195
    assert "de" in {r[2] for r in got if r[0] == 1003} and sum(r[0] == 1003 for r in got) == 3
    # nothing to learn from, one language, no rows
    assert {r.lang_pred for r in language_id.identify_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify_language(df.withColumn("lang", F.lit("xx"))).collect()} == {"xx", "und"}
    assert language_id.identify_language(df.limit(0)).count() == 0


def test_language_sample_is_bounded(spark):
    """A text that half of all rows have is fitted once, and a language of few rows is drawn whole."""
    rows = [(i, LANGS[0][0] if i % 2 else f"{LANGS[i // 2 % 2][0]} w{i}", LANGS[i // 2 % 2][1] if i % 2 == 0 else "en") for i in range(600)] + [(9000 + i, f"{LANGS[2][0]} u{i}", "fr") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in language_id.identify_language(df, sample=60, landmarks=9).collect()}
    assert sum(out[i] == k for i, _, k in rows) >= 0.97 * len(rows)


# fill in the middle -------------------------------------------------------------------------------------------


def brute_fill(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return i, n, form, len(p), len(m), sha(out), sha(text)


TEXTS = [None, "", "\n", "\n\n\n", "one", "a\nb\nc", "a\r\nb\r\n", "with <P> mark\nx", "<S>", "almost <P\n<\nS>\nM>\n<", "ü\U0001f600\nñ\n\x00\n", "x" * 50_000 + "\n", "line\n" * 20_000, "<<P\n>S>\n"] + [f"l{i}\n" * (i % 9) + "end" * (i % 2) for i in range(60)]


def test_fill_middle_brute_force(spark, sf_dir, tmp_path):
    made = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[5]), (None, None), (5, TEXTS[5])]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spark_docs = with_clash(docs.unionByName(spark.createDataFrame(made, "doc_id long, text string")))
    spark_docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_fill_middle(spark, str(tmp_path))
    want = Counter(brute_fill(r.doc_id, r.text) for r in spark_docs.collect())
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, out.collect())) == want
    assert fill_middle.fill_middle(spark_docs.limit(0)).count() == 0


def test_fill_middle_other_units_and_shares(spark):
    df = spark.createDataFrame([(i, f"some words of text {i} and more") for i in range(300)], "doc_id long, text string")
    out = fill_middle.fill_middle(df, units=r"\S+\s*", percent=40, spm_percent=100, marks=("[p]", "[s]", "[m]"))
    rows = out.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).join(df, "doc_id").collect()
    kinds = Counter(r.form for r in rows)
    assert set(kinds) == {"spm", "plain"} and 80 < kinds["spm"] < 160
    assert all(r.again == r.text and r.n == 7 for r in rows)
