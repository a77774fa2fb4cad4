"""Benchmark decontamination with an FM-index for each shard of the training text.

A shard is one Arrow batch of documents as a sequence of word ids.  Words that no phrase has, and words in runs that
share no two-word sequence with a phrase for long enough to hold one, become separators first; what is left is
indexed: suffix order by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix, ranks by cumulated
bits, and suffix positions sampled at every eighth place and at each run's start.  All phrases of one length are
searched backwards at once, their occurrences located by walking to a sampled position, and the spans merged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, fresh_prefix, materialise

WINDOW = 13
SAMPLE = 8
#: A batch of more text is indexed as several shards.
SHARD_BYTES = 16_000_000
#: Lower-cases A-Z and makes every other ASCII character than digits and letters a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Wavelet:
    """Ranks over an integer sequence: one level for each bit, high to low; rows with the bit unset go first."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            self.levels.append((b, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(upto), upto.copy()
        for b, ones, zeros in self.levels:
            bit = ((symbol >> b) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Of symbols >= 1 in runs that end with separators (0)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        n = len(seq)
        seps = seq == 0
        rank = np.where(seps, np.cumsum(seps) - 1, seq + int(seps.sum()))  # separators: all different, by place
        span = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - span] = rank[span:] + 1 if span < n else 0
            order = np.lexsort((nxt, rank))
            a, b = rank[order], nxt[order]
            new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            span *= 2
        self.bwt = seq[order - 1]
        self.wavelet = Wavelet(self.bwt, max(1, int(sigma).bit_length()))
        self.less = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 1))))
        marked = (order % SAMPLE == 0) | (self.bwt == 0)
        self.marked, self.at = marked, np.cumsum(marked) - 1
        self.sampled = order[marked]
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of each pattern (a matrix: one pattern a row), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            a = self.less[c] + self.wavelet.rank(c, low[alive])
            b = self.less[c] + self.wavelet.rank(c, high[alive])
            low[alive], high[alive] = a, np.maximum(a, b)
            alive = alive[b > a]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place of each row's suffix: walk back to a sampled one."""
        out, row, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked[row]
            out[todo[hit]] = self.sampled[self.at[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            c = self.bwt[row]
            row = self.less[c] + self.wavelet.rank(c, row)
            steps += 1
        return out


class Phrases:
    """Windows of the items' words: by length a matrix of word ids, and the items of each row."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        pairs = set()
        for name, words in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words]
            k = min(window, len(w))
            for i in range(len(w) - k + 1 if k else 0):
                found.setdefault(tuple(w[i : i + k]), set()).update([] if name is None else [name])
            pairs.update(zip(w, w[1:]))
        self.sigma = len(self.ids)
        self.pairs = np.sort(np.array([a * (self.sigma + 1) + b for a, b in pairs], np.int64))
        self.by_length: dict[int, tuple[np.ndarray, list[tuple[str, ...]]]] = {}
        for k in sorted({len(t) for t in found}):
            rows = sorted(t for t in found if len(t) == k)
            self.by_length[k] = (np.array(rows, np.int64), [tuple(sorted(found[t])) for t in rows])
        self.shortest = min(self.by_length, default=0)


def search_shard(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text: its words, the merged spans of words hit, and the items that occur."""
    if len(texts) > 1 and sum(len(t) for t in texts if t) > SHARD_BYTES:
        half = len(texts) // 2
        return search_shard(texts[:half], phrases) + search_shard(texts[half:], phrases)
    ids, sizes = [], []
    for t in texts:
        w = words_of(t)
        sizes.append(len(w))
        ids.append(np.fromiter((phrases.ids.get(x, 0) for x in w), np.int64, len(w)))
    out = [(n, [], []) for n in sizes]
    total = sum(sizes)
    if not total or not phrases.sigma:
        return out
    seq = np.concatenate(ids)
    ends = np.cumsum(sizes)
    # words that go on from the one before within a phrase
    code = seq[:-1] * (phrases.sigma + 1) + seq[1:]
    at = np.minimum(np.searchsorted(phrases.pairs, code), max(0, len(phrases.pairs) - 1))
    goes_on = np.zeros(total, bool)
    if len(phrases.pairs):
        goes_on[1:] = (phrases.pairs[at] == code) & (seq[:-1] > 0) & (seq[1:] > 0)
    goes_on[ends[:-1][ends[:-1] < total]] = False
    starts = np.flatnonzero(~goes_on)
    length = np.diff(np.append(starts, total))
    good = (length >= phrases.shortest) & (seq[starts] > 0)
    starts, length = starts[good], length[good]
    if not len(starts):
        return out
    # each run, then a separator
    m = int(length.sum() + len(length))
    step = np.ones(m, np.int64)
    first = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    step[first[0]] = starts[0]
    step[first[1:]] = starts[1:] - (starts[:-1] + length[:-1])
    where = np.cumsum(step)
    sep = first + length
    text = seq[np.minimum(where, total - 1)]
    text[sep] = 0
    index = FMIndex(text, phrases.sigma)
    edge = np.zeros(total + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for k, (rows, names) in phrases.by_length.items():
        low, high = index.search(rows)
        times = high - low
        which = np.repeat(np.arange(len(rows)), times)
        if not len(which):
            continue
        inner = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        places = where[index.locate(low[which] + inner)]
        np.add.at(edge, places, 1)
        np.add.at(edge, places + k, -1)
        doc = np.searchsorted(ends, places, "right")
        for code in np.unique(doc * len(rows) + which).tolist():
            items[code // len(rows)].update(names[code % len(rows)])
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    # a document's spans never run into the next one's
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(hit), "right")).tolist():
        e, s = int(ends[i]), int(ends[i]) - sizes[i]
        lo, hi = np.searchsorted(end, s, "right"), np.searchsorted(begin, e, "left")
        spans = [(max(int(a), s) - s, min(int(b), e) - s) for a, b in zip(begin[lo:hi], end[lo:hi])]
        out[i] = (sizes[i], spans, sorted(items[i]))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = 8_000_000,
    prefix: str = "",
) -> DataFrame:
    """``keep``, n_words, spans (of words hit, merged), items (sorted as strings), n_hit and contaminated, for each row.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.  Texts and items that are null
    or without words have no windows and no hits; an item id that is null counts for hits only, items with the same
    id are one, repeated rows keep a row each.  An empty table gives no rows, an empty benchmark no hits.  Very long texts
    are searched whole.  Items are sent to the tasks in blocks of about ``block_bytes`` of
    text; a benchmark of more blocks is searched in as many passes, whose spans are merged.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    seen, p = None, fresh_prefix(df.columns, "d")
    need = list(dict.fromkeys([*keep, text_col])) if blocks > 1 else keep
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = sorted((((r.name, words_of(r.text.encode() if r.text else None)) for r in block.toLocalIterator())), key=lambda r: (r[0] or "", r[1]))
        sent = df.sparkSession.sparkContext.broadcast(Phrases(rows, window))

        def run(values: pa.Array, sent=sent, again=seen is not None) -> list[pa.Array]:
            old = values.field("hits").to_pylist() if again else None
            found = search_shard(as_bytes(values.field("text") if again else values), sent.value)
            if again:
                found = [(n, _merge(s, [(x["start"], x["end"]) for x in o["spans"]]), sorted({*i, *o["items"]})) for (n, s, i), o in zip(found, old)]
            return [
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([i for _, _, i in found], pa.list_(pa.string())),
            ]

        fields = [T.StructField(p + "n", T.LongType()), T.StructField(p + "spans", _SPANS), T.StructField(p + "items", T.ArrayType(T.StringType()))]
        if seen is None:
            seen = append_columns(df, text_col, fields, run, need)
        else:
            before = seen.withColumn(p + "in", F.struct(F.col(text_col).alias("text"), F.struct(F.col(p + "spans").alias("spans"), F.col(p + "items").alias("items")).alias("hits")))
            seen = append_columns(before.drop(p + "n", p + "spans", p + "items"), p + "in", fields, run, need)
        if k + 1 < blocks:
            seen = materialise(seen, "contamination")
    hit = F.aggregate(p + "spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = seen.select(*keep, F.col(p + "n").alias(prefix + "n_words"), F.col(p + "spans").alias(prefix + "spans"), F.col(p + "items").alias(prefix + "items"), hit.alias(prefix + "n_hit"))
    n, h = F.col(prefix + "n_words"), F.col(prefix + "n_hit")
    return out.withColumn(prefix + "contaminated", (h > 0) & (20 * h >= n))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that aren't contaminated, all columns."""
    p = fresh_prefix(df.columns, "c")
    return find_contamination(df, benchmark, df.columns, text_col, prefix=p).where(~F.col(p + "contaminated")).select(*df.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
