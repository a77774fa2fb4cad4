"""Language of a text by a string kernel.

A text is the set of the 1- to 4-grams of its lower-cased letters, other characters standing as one space (blended spectrum,
presence only, hashed to 18 bits).  The kernel of two texts is the number of grams that both have over the root of the product of
how many each has.  Nyström's method gives each text a vector from its kernels with some landmark texts, and ridge regression, one
language against the rest, is fitted on these vectors: tasks add up their products, and the system that is solved is as large as
the landmarks are many.

Scoring is a product of matrices for each batch: the texts' 0/1 rows over the landmarks' grams, times the landmarks' 0/1 rows
and the fitted weights, which are multiplied once beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import bounded_batches, materialise

#: Longest gram, bits of a hashed gram, texts of one matrix, and the answer for texts without letters.
GRAM = 4
BITS = 18
ROWS = 128
UNKNOWN = "und"
#: Landmarks are chosen among texts of so many characters where there are enough.
USUAL = (200, 20_000)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    if not _letters:
        _letters.append(np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """0 or 1 for each hashed gram of a text; none is set if it has no letter."""
    present = np.zeros(1 << BITS, bool)
    a = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    a = a[np.flatnonzero((a != 32) | np.concatenate(([False], a[:-1] != 32)))] if len(a) else a  # runs of spaces become one, none leads
    if not len(a) or (a == 32).all():
        return present
    if a[-1] != 32:
        a = np.append(a, np.uint32(32))
    a = np.concatenate((np.array([32], np.uint32), a)).astype(np.uint64)
    h = np.zeros(len(a), np.uint64)
    for n in range(1, min(GRAM, len(a)) + 1):
        h = (h[: len(a) - n + 1] ^ a[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        present[(h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)] = True
    return present


def rows_of(texts: list[str], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' 0/1 rows over some grams, and how many grams each has in all."""
    out, sizes = np.zeros((len(texts), len(columns)), np.float32), np.zeros(len(texts))
    for i, t in enumerate(texts):
        present = grams(t)
        sizes[i], out[i] = np.count_nonzero(present), present[columns]
    return out, sizes


@dataclass
class Model:
    """Languages in order, the landmarks' grams, and a weight for each gram and language."""

    languages: list[str]
    columns: np.ndarray
    weights: np.ndarray

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One row of margins for each text, about 1 for its language and -1 for others, and its number of grams."""
        got, sizes = rows_of(texts, self.columns)
        return got @ self.weights / np.sqrt(np.maximum(sizes, 1))[:, None], sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), ROWS):
            margins, sizes = self.margins([t or "" for t in texts[at : at + ROWS]])
            for m, n in zip(margins, sizes):
                known = n > 0 and len(m) > 0
                names.append(self.languages[int(m.argmax())] if known else UNKNOWN)
                scores.append(round(float(min(1.0, max(0.0, (m.max() + 1) / 2))), 6) if known else 0.0)
        return names, scores


def nystrom(landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The landmarks' scaled rows times the inverse root of their kernel matrix: (grams, rank)."""
    scaled = landmarks / np.sqrt(sizes)[:, None]
    values, vectors = np.linalg.eigh(scaled @ scaled.T)
    good = values > 1e-6 * values.max()
    return scaled.T @ (vectors[:, good] / np.sqrt(values[good]))


def train(labelled: DataFrame, sample: int = 20_000, landmarks: int = 96, ridge: float = 0.01, tasks: int = 32) -> Model:
    """A model from a DataFrame of ``text`` and ``lang``, both not null.

    About ``sample`` different texts at most are fitted, drawn by a hash of text and language from all rows, an equal share for
    each language (all, where it has fewer); rows weigh so that languages count alike.  Landmarks are the first of each language by that hash, at least
    one for each.  What reaches the driver is the landmarks' grams and ``tasks`` sums the size of the landmarks' square.
    """
    labelled = labelled.select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    n, names = sum(counts.values()), sorted(counts)
    none = Model([], np.zeros(0, np.int64), np.zeros((0, 0)))
    if not n:
        return none
    # a language of few rows is drawn whole, a large one by its share
    share = sample / len(names)
    most = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, share / counts[k]))])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64("h"), 11) / float(1 << 53)
    some = materialise(labelled.where(draw < most).dropDuplicates(["h"]), "language-sample")
    size = F.length("text")
    first = W.partitionBy("lang").orderBy((~size.between(*USUAL)).cast("int"), "h", "text")
    marks = some.select("lang", "text", "h", F.row_number().over(first).alias("rank")).where(F.col("rank") <= max(1, landmarks // len(names))).select("text")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.flatnonzero(grams(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["grams"])

    lists = [r.grams for r in bounded_batches(marks.distinct()).mapInArrow(held, "grams array<int>").orderBy("grams").collect() if r.grams]
    if not lists:
        return none
    columns = np.unique(np.concatenate(lists))
    matrix = np.zeros((len(lists), len(columns)), np.float32)
    for i, g in enumerate(lists):
        matrix[i, np.searchsorted(columns, g)] = 1
    space = nystrom(matrix, matrix.sum(1)).astype(np.float32)
    rank = space.shape[1]
    fitted = dict(some.groupBy("lang").count().collect())
    weight = {k: 1.0 / v for k, v in fitted.items()}
    shared = some.sparkSession.sparkContext.broadcast((columns, space))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, space = shared.value
        left, right = np.zeros((rank, rank)), np.zeros((rank, len(names)))
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), ROWS):
                got, sizes = rows_of(texts[at : at + ROWS], columns)
                x = (got @ space / np.sqrt(np.maximum(sizes, 1))[:, None]).astype(np.float64)
                of = langs[at : at + ROWS]
                w = np.array([weight[k] for k in of]) * (sizes > 0)
                y = np.where(np.array(of)[:, None] == np.array(names), 1.0, -1.0)
                left += (x * w[:, None]).T @ x
                right += (x * w[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.hstack((left, right)).tobytes()], pa.binary())], names=["sums"])

    sums = bounded_batches(some.select("text", "lang")).coalesce(tasks).mapInArrow(products, "sums binary").collect()
    shared.unpersist()
    total = sum(np.frombuffer(r.sums).reshape(rank, -1) for r in sums)
    beta = np.linalg.solve(total[:, :rank] + ridge * np.eye(rank), total[:, rank:])
    return Model(names, columns, (space @ beta).astype(np.float32))


def held_out(id_: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_language(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 20_000, landmarks: int = 96, ridge: float = 0.01
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (0 to 1).

    Learned from text and non-null language of rows that aren't held out; only the text is used for a prediction.  Null texts and
    texts without a letter are ``und`` with score 0, as is everything where nothing could be learned.  Repeated rows and ids keep
    a row each, a null id isn't held out, other columns are left out, very long texts are read whole, equal margins go to the
    first language by code point.  An empty table gives no rows.
    """
    rows = df.select(df[id_col].alias("id"), held_out(df[id_col]).alias("held_out"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"))
    model = train(rows.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL"), sample, landmarks, ridge)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names, scores = shared.value.predict(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return bounded_batches(rows.select("id", "held_out", "text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
