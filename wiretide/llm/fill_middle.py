"""Fill-in-middle texts, cut at units of a pattern.

A text is matched twice and its units are never held: the first pass counts them, the second moves one lazy iterator of
matches on to the two ranks at which prefix and middle end, so a text of any number of units needs two numbers beside itself.
The draws are digits of a hash of the row's id; ids, forms, lengths and digests stay in Spark's own expressions.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def count_units(text: str, units: re.Pattern) -> int:
    """First pass: how many units there are."""
    last = deque(enumerate(units.finditer(text), 1), 1)
    return last[0][0] if last else 0


def ends(text: str, units: re.Pattern, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first ``low`` and the first ``high`` units end (low <= high)."""
    matches = units.finditer(text)
    at = next((m.end() for m in islice(matches, low - 1, None)), 0) if low else 0
    return at, (next((m.end() for m in islice(matches, high - low - 1, None)), at) if high > low else at)


def draws(id_: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits: the first digits of SHA-256 of ``seed:id``, where a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: its parts stand between the first of each mark."""
    prefix, suffix, middle = marks

    def between(begin: str, end: str | None) -> Column:
        # each mark stands once in an output that isn't plain, so what follows it begins at its last
        tail = F.substring_index(output, begin, -1)
        return F.substring_index(tail, end, 1) if end else tail

    psm = F.concat(between(prefix, suffix), between(middle, None), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, None), between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = LINES, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """One row per input row: id, n (units of the text), form, prefix_chars, middle_chars, output.

    ``percent`` of the texts are cut, ``spm_percent`` of these with the suffix first.  A text stays plain if it is empty or
    holds a mark; null counts as empty, and plain texts have null lengths.  Repeated rows and ids keep a row each and ids alike
    are cut alike, a null id draws from the seed alone, other columns are left out, very long texts are read whole.  An
    empty table gives no rows.  ``units`` is a Python pattern that mustn't match nothing; what lies between matches goes with
    the unit after it, and what follows the last one to the suffix.
    """
    one, two, three, four = draws(df[id_col], seed)
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), one.alias("a"), two.alias("b"), (three % 100 < percent).alias("cut"), (four % 100 < spm_percent).alias("spm"))
    schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    (p, s, m), pattern = marks, re.compile(units)

    def made(text: str, a: int, b: int, cut: bool, spm: bool) -> tuple[int, str, int | None, int | None, str]:
        n = count_units(text, pattern)
        if not cut or not text or any(x in text for x in marks):
            return n, "plain", None, None, text
        a, b = a % (n + 1), b % (n + 1)
        i, j = ends(text, pattern, min(a, b), max(a, b))
        if spm:
            return n, "spm", i, j - i, "".join((s, text[j:], p, text[:i], m, text[i:j]))
        return n, "psm", i, j - i, "".join((p, text[:i], s, text[j:], m, text[i:j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = list(zip(*(made(x.as_py(), *d) for x, *d in zip(b.column(1), *(c.to_pylist() for c in b.columns[2:])))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), b.column(1).type)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=schema.names)

    out = bounded_batches(rows).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")
