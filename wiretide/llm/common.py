"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch: texts can be long, and JVM and worker hold several batches each.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose Arrow batches hold BATCH_BYTES at most unless the session sets another bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def fresh(taken: list[str], name: str) -> str:
    """A column name like ``name`` that no column has, whatever its case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def fresh_prefix(taken: list[str], name: str) -> str:
    """A prefix like ``__name_`` with which no column begins, whatever its case."""
    prefix = f"__{name}_"
    while any(c.lower().startswith(prefix.lower()) for c in taken):
        prefix += "_"
    return prefix


def append_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    fn: Callable[[pa.Array], list[pa.Array]],
    keep: list[str],
) -> DataFrame:
    """``keep`` of df and the columns that ``fn`` makes from each Arrow batch of ``column``.

    A kept column that has the name of a new one gives way to it.
    """
    new = {f.name for f in fields}
    keep = [k for k in keep if k not in new]
    schema = T.StructType([df.schema[k] for k in keep] + fields)
    cols = list(dict.fromkeys([*keep, column]))
    at, names = cols.index(column), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(cols.index(k)) for k in keep] + fn(b.column(at)), names=names)

    return bounded_batches(df).select(*[df[c] for c in cols]).mapInArrow(run, schema)


def as_bytes(values: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text."""
    return values.cast(pa.binary()).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where none is set (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="wiretide-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/wiretide-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
