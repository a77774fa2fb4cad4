"""The thin queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, language_id, license_scan, line_dedup, quality_rules, secret_scan, simhash_dedup, source_mix, suffix_dedup, token_counts, token_store, vector_codes
from .common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read_table(spark, sf_dir, "documents")).drop("slot")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), with_kept=False)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL has it: on a host of three pages, each line counts as repeated."""
    return line_dedup.drop_site_lines(read_table(spark, sf_dir, "pages"), least=1)


def op9_line_dedup_two_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines go only where two pages of the host or more have them."""
    return line_dedup.drop_site_lines(read_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(read_table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_middle(read_table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_source_mix, op3_secret_scan, op4_suffix_dedup, op5_simhash_dedup, op6_decontaminate, op7_license_scan, op8_token_store, op9_line_dedup, op9_line_dedup_two_pages, op10_token_counts, op11_vector_codes, op12_language_id, op13_fill_middle, pipeline)
}


def _line_sql(more: str = "") -> str:
    text = "coalesce(html, '')"
    for pattern, to in line_dedup.MARKUP:
        text = f"regexp_replace({text}, '{pattern}', {'chr(10)' if to else chr(39) * 2}, 'g')"
    return f"""
WITH pages_ AS (
  SELECT page_id, nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', '')), '') AS host,
         list_filter(list_transform(regexp_split_to_array({text}, '[\\r\\n]+'), lambda x: regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
total AS (SELECT host, count(*) AS pages FROM pages_ WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= 3),
held AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM pages_ WHERE host IS NOT NULL) GROUP BY host, line),
common AS (SELECT host, list(line) AS common FROM held JOIN total USING (host) WHERE n > 0.3 * pages{more} GROUP BY host),
rows_ AS (SELECT page_id, p.host, lines, CASE WHEN common IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(common, x)) END AS kept
  FROM pages_ p LEFT JOIN common c ON p.host = c.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM rows_
"""


_CAPS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _mix_sql(block: int = 128) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws('|', '42', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS w FROM s),
p AS (SELECT *, source_size * (10 // w) AS per FROM w),
l AS (SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY per, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
    sum(w) OVER (ORDER BY per, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM p),
c AS (SELECT *, 4 * source_size * ws <= l * w AS capped FROM l),
o AS (SELECT l AS ol, ws AS ows FROM c WHERE NOT capped ORDER BY per, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN capped OR ows IS NULL THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(ol AS DOUBLE) / CAST(2 * ows AS DOUBLE) END AS target FROM c LEFT JOIN o ON true),
e AS (SELECT *, sum(target) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hi, sum(target) OVER () AS total FROM t),
n AS (SELECT unnest(range(CAST(greatest(1, floor((SELECT max(total) FROM e) / {block} + 0.5)) AS BIGINT))) AS i),
u AS (SELECT i * {source_mix.GOLDEN!r} - floor(i * {source_mix.GOLDEN!r}) AS u FROM n),
b AS (SELECT rank, count(*) * {block} AS upto FROM u JOIN e ON u >= (hi - target) / total AND u < hi / total GROUP BY rank),
a AS (SELECT d.doc_id, d.size, e.source_size, e.target, coalesce(b.upto, 0) AS upto, sum(d.size) OVER (PARTITION BY e.rank ORDER BY h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS pos
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN b ON b.rank = e.rank)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(pos + size, upto) - pos) + greatest(0, least(pos + source_size + size, upto) - pos - source_size) AS BIGINT) AS taken FROM a
"""


_REPEATS_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM t)),
c AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM w JOIN c USING (m)),
g AS (SELECT r, i, sum(CASE WHEN step IS NULL OR step > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM s),
p AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, k),
l AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS q FROM p),
h AS (SELECT r, string_agg(substr(x, 2 * q + 1, 2 * (a - q)), '' ORDER BY a) AS head, max(b) AS upto, count(*) AS n_spans, sum(b - a) AS n_removed FROM l JOIN t USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN h USING (r)
"""

_DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
m AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, p)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Assignment and means, once a round; ``d * entries + entry`` puts the lower index first among equal distances."""
    near = """SELECT r, part, min(d * {e} + entry) // {e} AS d, min(d * {e} + entry) % {e} AS entry FROM (
      SELECT r, p.part, c.entry, CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT) AS d FROM p JOIN c{k} c ON p.part = c.part) GROUP BY r, part"""
    steps = ""
    for k in range(rounds):
        steps += f"""
a{k} AS ({near.format(e=entries, k=k)}),
m{k} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM (
    SELECT part, entry, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT a.part, a.entry, p.v, unnest(range(1, len(p.v) + 1)) AS i FROM a{k} a JOIN p USING (r, part)) GROUP BY part, entry, i) GROUP BY part, entry),
c{k + 1} AS (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry)),"""
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM (SELECT r, v, unnest(range({parts})) AS part FROM k)),
c0 AS (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {entries}),{steps}
f AS ({near.format(e=entries, k=rounds)}),
o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h
"""


_FILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, text, u, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
r AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
x AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM x
"""

ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _codes_sql(), "op13_fill_middle": _FILL_SQL, "op2_source_mix": _mix_sql(), "op4_suffix_dedup": _REPEATS_SQL, "op6_decontaminate": _DECONTAMINATE_SQL, "op9_line_dedup": _line_sql(), "op9_line_dedup_two_pages": _line_sql(" AND n >= 2")}
