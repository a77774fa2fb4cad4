"""Quality rules: a decision list learned by sequential covering.

Each document gets statistics of its whole text.  From labelled documents (at most ``max_labelled``, the documented
bound of the sample) rules are grown one after another: a conjunction of thresholds is extended by the condition of
highest FOIL gain on two thirds of the rows, pruned from its end on the last third, and the rows that it covers are
taken out.  The list becomes one ordered Spark conditional, so applying it costs no Python beyond the statistics.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, fresh_prefix

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")

#: Statistics on which rules set thresholds, all from COUNTS.
FEATURES: dict[str, str] = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
}

_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_MARKS = bytes(c for c in range(256) if c not in b"!?|*#$%&<>")
_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_TAILS = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found at two places or more."""
    n = len(words)
    if n <= window:
        return 0
    last = dict(zip(words, range(n)))
    if len(last) == n:
        return 0
    rank, span = np.fromiter(map(last.__getitem__, words), np.int64, n), 1
    while span < window:  # the rank of 2 * span words from those of span words: exact, no hashing
        pair = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        found, rank, times = np.unique(pair, return_inverse=True, return_counts=True)
        if len(found) == len(pair):
            return 0
        span *= 2
    twice = np.flatnonzero(times[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text; null and empty texts have zeros (one line)."""
    if not text:
        return (0,) * 5 + (1, 0, 0, 0)
    words = text.split()  # of bytes: at \x20 and \x09-\x0D only
    solid = text.translate(None, _SPACE)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return (
        len(words), len(solid.translate(None, _TAILS)), len(text.translate(None, _SYMBOLS)), dup, repeated_words(words),
        len(lines), len(text.translate(None, _UPPER)), len(text.translate(None, _MARKS)), len(set(words)),
    )


def with_statistics(df: DataFrame, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    def run(values: pa.Array) -> list[pa.Array]:
        rows = np.array([statistics(x) for x in as_bytes(values)], np.int64).reshape(-1, len(COUNTS))
        return [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(COUNTS))]

    return append_columns(df, text_col, [T.StructField(prefix + c, T.LongType()) for c in COUNTS], run, keep)


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, at in rule:
        out &= x[name] >= at if op == ">=" else x[name] <= at
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (bad[inside].sum() < inside.sum()):
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (1e-9, None)
        for name, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, 65), method="nearest"))
            order = np.sort(v[inside])
            hits = np.sort(v[inside & bad])
            for op in (">=", "<="):
                if op == ">=":
                    p, n = len(hits) - np.searchsorted(hits, cuts), len(order) - np.searchsorted(order, cuts)
                else:
                    p, n = np.searchsorted(hits, cuts, "right"), np.searchsorted(order, cuts, "right")
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - np.log2(p0 / n0)), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (name, op, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _covers(rule, x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, max_rules: int = 16, max_conditions: int = 4, min_precision: float = 0.9) -> list[Rule]:
    """Ordered rules that reject; ``part`` (0, 1 or 2) deals the rows to growing (0, 1) and pruning (2).

    A list has ``max_rules`` rules of ``max_conditions`` thresholds at most; thresholds are tried at 65 quantiles of the rows
    that a rule still covers.  Learning ends at the first rule that is right on less than ``min_precision`` of its rows.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        g, p = left & (part < 2), left & (part == 2)
        if not bad[g].any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], max_conditions)
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray) -> tuple[int, int]:
            c = _covers(r, x) & rows
            return int((c & bad).sum()), int((c & ~bad).sum())

        scored = []
        for k in range(len(rule), 0, -1):
            good, wrong = worth(rule[:k], p if p.any() else g)
            scored.append(((good - wrong) / max(1, good + wrong), good, k))
        rule = rule[: max(scored)[2]]
        good, wrong = worth(rule, left)
        if good < 2 or good < min_precision * (good + wrong):
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Statistics, verdict and part of at most ``max_labelled`` labelled documents, chosen by a hash of the id; one row for
    each id, however many documents have it."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("__label"))
    few = one.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)  # the bound that lets it be broadcast
    few = few.select(F.col(id_col).alias("id"), "__label")
    some = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    rows = with_statistics(some, ["id", "__label"], "text").groupBy("id").agg(F.min(F.struct("__label", *COUNTS)).alias("s")).select("id", "s.*")
    table = rows.select("__label", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(3)).alias("__part"), *[F.expr(e).cast("double").alias("f_" + k) for k, e in FEATURES.items()])
    got = table.toPandas().sort_values(["__part", "__label", *("f_" + k for k in FEATURES)], kind="stable")
    return {k: got["f_" + k].to_numpy() for k in FEATURES}, got["__label"].to_numpy() == 0, got["__part"].to_numpy()


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The ordered conditional: false at the first rule that holds, else true."""

    def col(name: str) -> Column:
        return F.expr("".join(prefix + w if w in COUNTS else w for w in re.split(r"(\w+)", FEATURES[name]))).cast("double")

    out = None
    for rule in rules:
        test = F.lit(True)
        for name, op, at in rule:
            test = test & (col(name) >= at if op == ">=" else col(name) <= at)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


def quality_rules(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, keep: list[str] | None = None, prefix: str = ""
) -> DataFrame:
    """``keep`` (default: the id), the COUNTS, base_failed and kept, for each row of df.

    Null, empty and wordless texts fail the base rule.  Without labels (or with one verdict only) the list is empty
    and ``kept`` is the base rule's.  Labels that are null are left out; a document labelled twice has the lower one.
    Repeated rows and ids keep a row each; a null id is never a labelled one.  An empty table gives no rows.  Very long
    texts are read whole.  Rules that gain alike are taken in the order of FEATURES, >= before <=, least threshold first.
    """
    x, bad, part = labelled_sample(df, labels, id_col, text_col, label_col, max_labelled)
    rules = learn(x, bad, part) if len(bad) else []
    rows = with_statistics(df, keep or [id_col], text_col, prefix)
    failed = base_failed(prefix)
    return rows.withColumn(prefix + "base_failed", failed).withColumn(prefix + "kept", ~failed & verdict(rules, prefix))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that the rules keep, all columns."""
    q = fresh_prefix(df.columns, "q")
    return quality_rules(df, labels, id_col, text_col, keep=df.columns, prefix=q).where(F.col(q + "kept")).select(*df.columns)
