"""Many literals in one pass over each value: an automaton over bytes (Aho-Corasick) tells which literals a value has.

Patterns that are dear are then tried only on values that have a literal which each of their matches must have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Literal(NamedTuple):
    """``text`` says that a value has ``id``: as it is written, or with ``fold`` with ASCII letters in either case."""

    id: int
    text: bytes
    fold: bool = False


def automaton(literals: Sequence[Literal]) -> ahocorasick.Automaton:
    """Of the literals in small letters; each end gives the ids, and what must stand there where case counts."""
    by_text: dict[str, list[tuple[int, bytes | None]]] = {}
    for one in literals:
        if not one.text:
            raise ValueError("an empty literal is in every value")
        by_text.setdefault(one.text.lower().decode("latin-1"), []).append((one.id, None if one.fold else one.text))
    out = ahocorasick.Automaton()
    for text, ends in by_text.items():
        out.add_word(text, (len(text), ends))
    if by_text:
        out.make_automaton()
    return out


def ids_in(values: pa.Array, words: ahocorasick.Automaton, most: int | None = None) -> pa.Array:
    """The ids of the literals in each value's first ``most`` bytes, ascending; none of a null or an empty value."""
    out = []
    for x in values:
        data = bytes(x.as_buffer()[:most] if most else x.as_buffer()) if x.is_valid else b""
        found: set[int] = set()
        for end, (size, ends) in words.iter(data.lower().decode("latin-1")) if len(words) else ():
            for id_, exact in ends:
                if id_ not in found and (exact is None or data[end + 1 - size : end + 1] == exact):
                    found.add(id_)
        out.append(sorted(found))
    return pa.array(out, pa.list_(pa.int32()))


def with_literals(df: DataFrame, column: str, literals: Sequence[Literal], name: str = "literals", most: int | None = None) -> DataFrame:
    """df with the ids of the literals that a text or binary column has, as ``name``.  Texts are looked at as UTF-8; a null has
    none; rows, their order within a task and all other columns stay.  Nothing is shuffled and a task holds one batch."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    at, words = df.columns.index(column), list(literals)
    schema = T.StructType([*df.schema, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, ids_in(b.column(at), tree, most)], names=schema.names)

    return df.mapInArrow(run, schema)
