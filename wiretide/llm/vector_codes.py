"""Product codes of vectors, with integer codebooks searched through kd-trees.

Components become integers, vectors are cut into equal parts, and each part position has a codebook.  Every round broadcasts
one kd-tree for each codebook (``parts`` times ``entries`` points, whatever the number of vectors).  Tasks search them by branch
and bound for all vectors of an Arrow batch at a time: a node is visited where its box is as near as the best entry so far
*or nearer*, so that an entry of lower index at the same distance is still met.  Tasks add up the parts of each entry as integers,
Spark adds up the tasks' sums, and the next codebooks are the floors of the means.  No sum depends on the order of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Points of a leaf; largest integer of a component (larger ones count as it, so that no distance or sum overflows).
LEAF = 8
MOST = 1 << 26
#: Labels whose sums may be sent to all tasks; beyond that they are joined over salted keys.
LABELS = 100_000
SALTS = 32


@dataclass
class Node:
    """A box around points: a leaf with the points and their indexes in ascending order, or two halves."""

    low: np.ndarray
    high: np.ndarray
    ids: np.ndarray
    points: np.ndarray
    halves: tuple[Node, Node] | None = None

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row of x to the box: no point in it is nearer."""
        out = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (out * out).sum(1)


def grow(points: np.ndarray, ids: np.ndarray | None = None) -> Node:
    """The kd-tree of the rows of ``points``: the widest side is cut in the middle of its points."""
    ids = np.arange(len(points)) if ids is None else np.sort(ids)
    held = points[ids]
    node = Node(held.min(0), held.max(0), ids, held)
    wide = int(np.argmax(node.high - node.low))
    if len(ids) > LEAF and node.high[wide] > node.low[wide]:
        order = ids[np.argsort(held[:, wide], kind="stable")]
        node.halves = (grow(points, order[: len(order) // 2]), grow(points, order[len(order) // 2 :]))
    return node


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest point to each row of x; of equally near ones, the lowest index."""
    best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.halves is None:
            apart = x[rows, None, :] - node.points
            far = np.einsum("ijk,ijk->ij", apart, apart)
            at = far.argmin(1)
            far, ids = far[np.arange(len(rows)), at], node.ids[at]
            closer = (far < best[rows]) | ((far == best[rows]) & (ids < who[rows]))
            best[rows[closer]], who[rows[closer]] = far[closer], ids[closer]
            return
        one, two = node.halves
        to_one, to_two = one.bound(x[rows]), two.bound(x[rows])
        first = to_one <= to_two
        for child, near, other, bound in ((one, first, two, to_two), (two, ~first, one, to_one)):
            visit(child, rows[near])
            visit(other, rows[near][bound[near] <= best[rows[near]]])

    visit(tree, np.arange(len(x)))
    return who, best


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, rows filled up with zeros to ``width``."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    whole = np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return whole.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(whole)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = whole
    return out


def _sums(vectors: DataFrame, codebooks: np.ndarray, width: int, scale: int) -> np.ndarray:
    """The codebooks of the next round: floored means of the parts nearest to each entry, unused entries as they are."""
    parts, entries, wide = codebooks.shape
    sc = vectors.sparkSession.sparkContext
    trees = sc.broadcast([grow(c) for c in codebooks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = integers(b.column(0), width, scale)
            for p, tree in enumerate(trees.value):
                own = x[:, p * wide : (p + 1) * wide]
                who, _ = nearest(tree, own)
                count[p] += np.bincount(who, minlength=entries)
                np.add.at(total[p], who, own)
        used = np.flatnonzero(np.repeat(count.ravel() > 0, wide))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used]), pa.array(np.repeat(count.ravel(), wide)[used])], names=["cell", "total", "n"])

    sums = vectors.select("vector").mapInArrow(run, "cell long, total long, n long").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    trees.unpersist()
    out = codebooks.copy()
    flat = out.reshape(-1)
    for r in sums:
        flat[r.cell] = r.total // r.n
    return out


def _coded(vectors: DataFrame, codebooks: np.ndarray, width: int, scale: int) -> DataFrame:
    wide = codebooks.shape[2]
    trees = vectors.sparkSession.sparkContext.broadcast([grow(c) for c in codebooks])
    schema = T.StructType([vectors.schema["id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column(2), width, scale)
            found = [nearest(t, x[:, p * wide : (p + 1) * wide]) for p, t in enumerate(trees.value)]
            text = np.stack([who for who, _ in found], 1).astype(np.uint8).tobytes().hex()
            step = 2 * len(found)
            code = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(sum(far for _, far in found))], names=schema.names)

    return vectors.select("id", "label", "vector").mapInArrow(run, schema)


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, width: int, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Codebooks (parts, entries, width / parts) of a DataFrame of ``id`` and usable ``vector``.  They begin as the parts of the
    vectors of the smallest ids (null ids last, equal ones by their components); with fewer vectors there are fewer entries."""
    first = vectors.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width, scale)
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        codebooks = _sums(vectors, codebooks, width, scale)
    return codebooks


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> DataFrame:
    """One row for each usable vector: id, code (an index of two hex digits for each part), error (squared distance to the coded
    vector), label_error (that of all rows of the label, null labels together), codebooks_sha256.

    Rows whose vector is null or holds null, NaN or infinite components are left out.  Vectors shorter than the longest, or
    whose length isn't a multiple of ``parts``, are filled up with zeros; components beyond 2 ** 26 / scale count as that.
    Repeated rows and ids keep a row each, null ids stay null and come last among the first entries, ties go to the lower
    index, other columns are left out.  An empty table gives no rows.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: 256 entries at most")
    vectors = df.select(df[id_col].alias("id"), df[label_col].alias("label"), df[vector_col].alias("vector")).where(usable(F.col("vector")))
    longest = vectors.agg(F.max(F.size("vector"))).first()[0]
    named = [F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256"]
    if longest is None:
        nothing = F.lit(None)
        return vectors.limit(0).withColumns({"code": nothing.cast("string"), "error": nothing.cast("long"), "label_error": nothing.cast("long"), "codebooks_sha256": nothing.cast("string")}).select(*named)
    width = max(1, -(-longest // parts)) * parts
    codebooks = train(vectors, width, parts, entries, rounds, scale)
    coded = materialise(_coded(vectors, codebooks, width, scale), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.limit(LABELS + 1).count() <= LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = coded.withColumn("salt_", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")).join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt_") == F.col("salt")))
    return out.withColumn("codebooks_sha256", F.lit(digest(codebooks))).select(*named)
