"""Clashing names, empty tables and very long texts through each operator that keeps rows whole, and each stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wiretide.llm import decontaminate, license_scan, line_dedup, quality_rules, secret_scan, simhash_dedup, similar, source_mix, suffix_dedup, token_counts, token_store

CLASH = ["__n", "__x", "__h", "__fp", "__q_n_words", "__q_kept", "__d_n", "__d_in", "__c_contaminated", "__m_c", "__m_again", "__node", "__spans", "__items", "node", "row", "fp", "slot", "H", "Root", "least", "key", "text_", "size"]
TEXT = " ".join(f"word{i} and some more" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT.replace("word", f"w{i % 7}x"), f"s{i % 3}") for i in range(40)] + [(None, TEXT, None), (41, None, "s1"), (42, "", "s2"), (42, "", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH]).cache()


def whole(out, docs):
    """Columns and values of the rows that stay are those of the input."""
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASH)
    return rows


@pytest.mark.parametrize("name", ["quality", "words", "fingerprints", "one block", "many blocks", "mix"])
def test_columns_stay_as_they_are(spark, docs, name):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "w3x5 and some more w3x6 and some more w3x7 and some more w3x8 and"), (2, None), (None, "nothing of this")], "item_id long, text string")
    if name == "quality":
        whole(quality_rules.keep_good(docs, labels), docs)
    elif name == "words":
        assert len(whole(similar.keep_one(docs), docs)) == 9
    elif name == "fingerprints":
        whole(simhash_dedup.keep_one(docs), docs)
    elif name == "mix":
        whole(source_mix.mixed(docs), docs)
        assert source_mix.mixed(docs, slot="slot").columns == [*docs.columns, "slot_"]
    elif name == "one block":
        kept = whole(decontaminate.drop_contaminated(docs, bench), docs)
        assert {r.doc_id for r in kept} == {None, *range(40), 41, 42} - {i for i in range(40) if i % 7 == 3}
    else:
        one = decontaminate.find_contamination(docs, bench, docs.columns)
        many = decontaminate.find_contamination(docs, bench, docs.columns, block_bytes=20)
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        quality_rules.keep_good(none, labels), simhash_dedup.keep_one(none), simhash_dedup.near_duplicates(none), similar.keep_one(none), source_mix.mixed(none), source_mix.mix(none), decontaminate.drop_contaminated(none, bench), suffix_dedup.remove_repeats(none),
        secret_scan.secret_scan(none), license_scan.license_scan(none), token_counts.token_counts(none), token_store.token_store(none), line_dedup.drop_site_lines(pages),
    ):
        assert out.count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()


def test_very_long_texts(spark, sf_dir):
    """One text of two million characters among short ones: each operator reads it whole, and the stages keep it."""
    long_ = " ".join(f"term{i} of the long text" for i in range(80_000))
    rows = [(1, long_, "s1"), (2, long_ + " tail", "s1"), (3, "bearer q7Zk2LmX0vB9tRw4YhNc8sJd " + TEXT, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.n_words for r in quality_rules.quality_rules(df, spark.createDataFrame([], "doc_id long, quality int")).orderBy("doc_id").collect()][0] == 400_000
    assert [r.doc_id for r in similar.keep_one(df).orderBy("doc_id").collect()] == [1, 3]
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.spans for r in secret_scan.secret_scan(df).collect()}[3] == "novel:7:31"
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()}
    assert counts[2] > counts[1] > 400_000
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df, with_kept=False).collect()}
    assert removed[1] == len(long_) and removed[3] == 0
    assert source_mix.mix(df).agg(F.sum("taken")).first()[0] > 0
    bench = spark.createDataFrame([(1, "term79990 of the long text term79991 of the long text term79992 of the long")], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.find_contamination(df, bench, ["doc_id"]).collect()}
    assert hits == {1: 14, 2: 14, 3: 0}


def test_stages_on_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_lines_by_salted_hosts(spark, sf_dir):
    """Large boilerplate is dealt by host and salt; the rows are those of the small one that goes to the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(spark.createDataFrame([(None, None, "<p>x</p>"), (1, "http://a.example/", None)], "page_id long, url string, html string"))
    small, large = (line_dedup.drop_site_lines(pages, broadcast_bytes=b).collect() for b in (1 << 30, 0))
    assert sorted(map(str, small)) == sorted(map(str, large)) and len(small) == pages.count()


def test_lines_are_dealt_once(spark):
    """The hosts' page counts go to the lines where they are few, whatever is done first; else both are dealt by host."""
    pages = spark.createDataFrame([(h, [f"line{i % 5}", "menu"]) for h in ("a", "b") for i in range(4)], "host string, lines array<string>")
    few, many = (line_dedup.boilerplate(pages, 0.3, 3, 2, b) for b in (1 << 30, 0))
    shown = [x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
    assert "BroadcastHashJoin" in shown[0] and "SortMergeJoin" not in shown[0]
    assert sorted(few.collect()) == sorted(many.collect()) and {r.host: r.common for r in few.collect()} == {"a": ["menu"], "b": ["menu"]}
