"""Licenses by templates with markup, compiled to token automata.

A template is words with ``<<opt>> ... <<end>>`` around words that may be missing and ``<<var:a-b>>`` for a to b words
of any kind.  It is compiled to a graph of states with a word, any word or nothing on each edge; a text is accepted
from a place where the template's first words stand if the automaton reaches its end, so all mandatory words match
exactly, in order.  Case and punctuation don't count.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, as_bytes
from .decontaminate import words_of

#: Phrase and label, fixed.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label and template.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<<end>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software <<var:0-40>> subject to the following conditions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache", "licensed under the apache license <<opt>>version<<end>> <<opt>>v<<end>> 2 <<opt>>0<<end>>"),
    ("gpl", "licensed under the gnu <<opt>>lesser<<end>> <<opt>>affero<<end>> general public license <<opt>>version<<end>> <<opt>>v<<end>> <<var:1-1>>"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<<end>> <<opt>>affero<<end>> general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under <<opt>>a<<end>> <<opt>>the<<end>> creative commons attribution <<var:0-4>> license"),
    ("cc-by", "licensed under <<opt>>the<<end>> cc by <<opt>>sa<<end>> <<opt>>nc<<end>> <<opt>>nd<<end>> <<var:1-2>> license"),
    ("mit", "released under <<opt>>the<<end>> mit license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
_MARK = re.compile(rb"<<(opt|end|var:(\d+)-(\d+))>>|[^\s<]+")


class Automaton:
    """States 0..; edges[state] is a list of (word or None for any, next), skips[state] of states reached without one."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        opened: list[int] = []
        lead: list[bytes] = []
        leading = True
        for m in _MARK.finditer(template.lower().encode()):
            at = len(self.edges) - 1
            if m[1] == b"opt":
                leading = False
                opened.append(at)
            elif m[1] == b"end":
                self.skips[opened.pop()].append(at)
            elif m[1]:
                leading = False
                least, most = int(m[2]), int(m[3])
                for _ in range(most):
                    self._add(None)
                for i in range(least, most):
                    self.skips[at + i].append(at + most)
            else:
                for word in words_of(m[0]):
                    if leading:
                        lead.append(word)
                    self._add(word)
        if opened or not lead:
            raise ValueError("a template begins with mandatory words and closes what it opens")
        self.lead = b" " + b" ".join(lead) + b" "

    def _add(self, word: bytes | None) -> None:
        self.edges[-1].append((word, len(self.edges)))
        self.edges.append([])
        self.skips.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accept(self, words: list[bytes], start: int) -> int | None:
        """Where the longest match from ``start`` ends, or None."""
        states, found, final = self._closed({0}), None, len(self.edges) - 1
        for i in range(start, len(words) + 1):
            if final in states:
                found = i
            if i == len(words):
                break
            states = self._closed({n for s in states for w, n in self.edges[s] if w is None or w == words[i]})
            if not states:
                break
        return found


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word places of a phrase (both with a space at each end), overlaps included."""
    out, at, seen, count = [], joined.find(phrase), 0, 0
    while at >= 0:
        count += joined.count(b" ", seen, at)
        seen = at
        out.append(count)
        at = joined.find(phrase, at + 1)
    return out


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``score`` is the share of the text's words that lie in a phrase or an accepted template; ``matches`` lists the
    accepted ones as label:start:end in words.  Null, empty and wordless texts have no places (labels are empty, score
    0); repeated rows and null ids keep their rows; an empty table gives none; other columns are left out.
    """
    machines = [(label, Automaton(t)) for label, t in templates]
    phrases = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in PHRASES]

    def scan(text: bytes | None) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base = [(at, n, label) for p, n, label in phrases if p in joined for at in places(joined, p)]
        found = []
        for label, a in machines:
            for at in places(joined, a.lead) if a.lead in joined else []:
                end = a.accept(words, at)
                if end is not None:
                    found.append((at, end, label))
        starts = [b[0] for b in base]
        covered, upto = 0, 0
        for s, e in sorted([(s, s + n) for s, n, _ in base] + [(s, e) for s, e, _ in found]):
            covered += max(0, e - max(s, upto))
            upto = max(upto, e)
        mine = {b[2] for b in base}
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(mine)),
            ",".join(sorted(mine | {f[2] for f in found})), covered / len(words) if words else 0.0,
            ",".join(f"{label}:{s}:{e}" for s, e, label in sorted(found)),
        )

    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "matches": T.StringType()}
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(values: pa.Array) -> list[pa.Array]:
        rows = [scan(x) for x in as_bytes(values)]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]

    return append_columns(df, text_col, [T.StructField(k, t) for k, t in kinds.items()], run, [id_col])
