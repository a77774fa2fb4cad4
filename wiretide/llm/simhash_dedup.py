"""Near-duplicate documents by SimHash, found through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits.  Two fingerprints that differ in at most
four bits have a segment in which they differ in at most one bit, so they share one of that segment's variants in
which a single bit is struck out.  The 64 variants of each *distinct* fingerprint are dealt by value, and the
fingerprints that meet in a variant are compared exactly.

* A variant met by more than ``hot`` fingerprints is dealt again by five parts of the remaining bits: where four
  bits differ at most, one of five parts is equal.  No bucket is cut off.
* A bucket gives the edges of a spanning forest of its links, at most one a fingerprint, never its pairs.
* Components come from alternating large-star and small-star steps, each a minimum by key and a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, fresh, materialise

SEED = 42
#: First bit and width of each segment; with three segments four differing bits leave one segment with one at most.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 4


def shingle_hashes(text: bytes | None, shingle: int = 4) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; under so many words the whole sequence is one; none without words."""
    words = text.lower().split() if text else []  # of bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts[: n - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of a text's shingles: bit set where over half of the shingles' XXH64 have it. No words, or null: 0."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 4, name: str = "fp") -> DataFrame:
    """``keep`` and the fingerprint of each row's text, as a signed long."""

    def run(values: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(x, shingle) for x in as_bytes(values)], np.uint64).view(np.int64))]

    return append_columns(df, text_col, [T.StructField(name, T.LongType())], run, keep)


def _variants(fps: DataFrame) -> DataFrame:
    """fp -> (fp, key) for each of the 64 bits struck out of its segment."""
    # spread first: few bytes of fingerprints become 64 times as many rows; by a hash, as they may be dealt by fp already
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    rows = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    value = F.expr(
        "shiftrightunsigned(fp & ~shiftleft(1L, bit), CASE WHEN bit < 21 THEN 0 WHEN bit < 42 THEN 21 ELSE 42 END)"
        " & CASE WHEN bit < 42 THEN 2097151L ELSE 4194303L END"
    )
    return rows.select("fp", (F.shiftleft(F.col("bit").cast("long"), 22) + value).alias("key"))


def _parts(bit: Column, fp: Column) -> Column:
    """Five values of the bits outside the segment of ``bit``; where at most four bits differ, one is equal."""
    out = []
    for seg, (off, width) in enumerate(SEGMENTS):
        rest = [b for b in range(64) if not off <= b < off + width]
        cut = [rest[len(rest) * i // 5 : len(rest) * (i + 1) // 5] for i in range(5)]
        masks = [sum(1 << b for b in c) for c in cut]
        masks = [m - (1 << 64) if m >> 63 else m for m in masks]
        out.append(F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(masks)]))
    return F.when(bit < 21, out[0]).when(bit < 42, out[1]).otherwise(out[2])


def _forest(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of key: for each row its fingerprint and that of the root of its component in its bucket."""
    n = len(key)
    root = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, n))
    small = np.repeat(size <= 64, size)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    shift = 1
    while shift < n and shift < 64:
        same = (key[shift:] == key[:-shift]) & small[shift:]
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= most]
        a.append(i)
        b.append(i + shift)
        shift += 1
    if a:
        u, v = np.concatenate(a), np.concatenate(b)
        while True:  # least row of each component: hook, then jump
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if (root == before).all():
                break
    for f, m in zip(first[size > 64].tolist(), size[size > 64].tolist()):
        left = np.arange(f, f + m)
        while len(left):  # breadth first; what is reached leaves the rows still to compare
            start, left, queue = left[0], left[1:], [left[0]]
            while queue and len(left):
                near = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= most
                if near.any():
                    root[left[near]] = start
                    queue.extend(left[near].tolist())
                    left = left[~near]
    other = root != np.arange(n)
    return fp[other], fp[root[other]]


def _links(buckets: DataFrame, most: int) -> DataFrame:
    """(fp, key) -> edges u > v of a forest of the links within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            k = np.concatenate((held_k, b.column(1).to_numpy(zero_copy_only=False)))
            f = np.concatenate((held_f, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            held_k, held_f = k[cut:], f[cut:]
            if cut:
                yield _edges(k[:cut], f[:cut], most)
        if len(held_k):
            yield _edges(held_k, held_f, most)

    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    return buckets.select("fp", "key").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _edges(k: np.ndarray, f: np.ndarray, most: int) -> pa.RecordBatch:
    x, y = (z.view(np.int64) for z in _forest(k, f, most))
    return pa.record_batch({"u": pa.array(np.maximum(x, y)), "v": pa.array(np.minimum(x, y))})


def fingerprint_links(fps: DataFrame, most: int = MAX_BITS, hot: int = 4096) -> DataFrame:
    """Edges (u > v) between distinct fingerprints, with the components of the graph of all pairs within ``most`` bits."""
    if not 0 <= most <= MAX_BITS:
        raise ValueError("three segments find up to four differing bits")
    rows = _variants(fps)
    heavy = materialise(rows.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-variants")
    if heavy.isEmpty():
        return _links(rows, most).distinct()
    rest = _links(rows.join(heavy, "key", "left_anti"), most)
    parts = rows.join(heavy, "key").select("fp", "key", F.explode(_parts(F.shiftright("key", 22), F.col("fp"))).alias("p"))
    again = parts.select("fp", F.xxhash64("key", "p.part", "p.value").alias("key"))
    return rest.union(_links(again, most)).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(u, v) edges -> (node, root): the least node of each component, for all nodes that have an edge and aren't it."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(limit):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {limit} rounds")


def classes(prints: DataFrame, id_col: str, most: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``prints`` (id, fp)."""
    fps = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(fingerprint_links(fps.select("fp"), most))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the least id reachable over links.

    Null, empty and wordless texts have fingerprint zero and link like any other; under ``shingle`` words the whole
    sequence is the one shingle.  Repeated rows and ids each keep a row.  Null ids stay null and never name a
    component that has another id.  An empty table gives no rows.  Other columns are left out.  Very long texts are read
    whole.
    """
    prints = materialise(with_fingerprint(df, [id_col], text_col, shingle), "fingerprints")
    named = classes(prints, id_col, most).select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = MAX_BITS) -> DataFrame:
    """One row of each group of near-duplicates, all columns: that of the least id; one without an id only if none has one.

    Rows that repeat both id and fingerprint are one row.  An empty table gives no rows.
    """
    fp = fresh(df.columns, "fp")
    marked = with_fingerprint(df, df.columns, text_col, shingle, fp)
    prints = materialise(marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp")), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("h")
    heads = least.join(classes(prints, "id", most).select("fp", "root"), "fp").groupBy("root").agg(first).select("h.id", "h.fp")
    one = marked.join(heads, marked[id_col].eqNullSafe(heads["id"]) & (marked[fp] == heads["fp"]), "left_semi")
    return one.dropDuplicates([id_col, fp]).select(*[one[c] for c in df.columns])
