"""Removal of byte strings that occur more than once, by sorting suffixes deep-shallow.

A byte goes if a string of ``length`` (200) bytes that covers it also starts anywhere else.  Only suffixes that can
take part are sorted:

1. Each 200-byte window belongs to its anchor, the 48-byte string in it of least hash; equal windows have equal
   anchors at equal places.  The consecutive windows of one anchor make a run, about 70 windows.
2. Anchors are counted over all documents (with map-side sums).  Runs whose anchor occurs once are done.
3. The other runs are dealt by anchor.  Per anchor, runs are sorted by what follows it and by what precedes it
   (backwards): multikey quicksort by 8-byte words to a shallow depth, then a blind trie for each group that still
   shares its prefix.  The longest common prefixes of neighbours give, for each offset, classes of equal left and
   right parts; a window is repeated where both classes are shared.
4. Anchors with more than ``hot`` runs aren't gathered: their distinct runs are counted by content, and windows of
   those that occur once by digest.

The spans go back to their documents by (id, hash of the text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, materialise

LENGTH = 200
ANCHOR = 48
SHALLOW = 3  # words of 8 bytes
HOT = 4096
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            inv = pow(_BASE, -1, 1 << 64)
            both = []
            for b in (_BASE, inv):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row: minima from both ends of blocks of w."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((x, pad)).reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()[:n]
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(back[: n - w + 1], fore[w - 1 :])


def anchors(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of each run of windows with one anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    width = length - anchor + 1
    for at in range(0, max(0, len(text) - length + 1), CHUNK):
        b = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - at), at)
        n = len(b)
        pw, inv = _power(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * pw[:n], out=sums[1:])
            h = (sums[anchor:] - sums[:-anchor]) * inv[: n - anchor + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        place = _sliding_min((h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64), width)
        place = (place & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        out.append((place[first] + at, h[place[first]].view(np.int64), first + at, last + at))
    if not out:
        e = np.empty(0, np.int64)
        return e, e, e, e
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _common(s: bytes, t: bytes) -> int:
    m = min(len(s), len(t))
    x = int.from_bytes(s[:m]) ^ int.from_bytes(t[:m])
    return m - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """Members in order of their strings.  Branches hold a depth and one byte for each child; a string goes down by
    those bytes alone, is compared once with the leaf it comes to, and then put where they part."""
    root = None
    for m in members:
        s = strings[m]
        if root is None:
            root = [m]
            continue
        node = root
        while type(node) is tuple:
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        t = strings[node[0]]
        n = _common(s, t)
        if n == len(s) == len(t):
            node.append(m)
            continue
        up, byte, node = None, 0, root
        while type(node) is tuple and node[0] < n:
            up, byte = node, s[node[0]]
            node = up[1][byte]
        mine = s[n] if n < len(s) else -1
        if type(node) is tuple and node[0] == n:
            node[1][mine] = [m]
            continue
        new = (n, {mine: [m], (t[n] if n < len(t) else -1): node})
        if up is None:
            root = new
        else:
            up[1][byte] = new
    out: list[int] = []
    stack = [root] if root is not None else []
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): strings of at most ``width`` bytes in order within their groups; common[i] is the prefix that
    order[i] shares with order[i - 1], -1 where a group begins."""
    n = len(strings)
    cols = -(-width // 8) * 8
    matrix = np.frombuffer(b"".join(s.ljust(cols, b"\0") for s in strings), np.uint8).reshape(n, cols)
    words = matrix.view(">u8").astype(np.uint64)

    def heads(new: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    def turns(*keys: np.ndarray) -> np.ndarray:
        return np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))

    order = np.argsort(group, kind="stable")
    start = np.empty(n, np.int64)  # first place of the part that a string is in
    start[order] = heads(turns(group[order]))
    size = np.bincount(start, minlength=n)
    todo = order[size[start[order]] > 1]
    for depth in range(min(SHALLOW, cols // 8)):  # multikey quicksort: parts split by their next word
        if not len(todo):
            break
        i = todo[np.lexsort((words[todo, depth], start[todo]))]
        place = start[i] + np.arange(len(i)) - heads(turns(start[i]))
        order[place] = i
        start[i] = place[heads(turns(start[i], words[i, depth]))]
        size = np.bincount(start, minlength=n)
        todo = i[size[start[i]] > 1]
    if len(todo):  # deep: one blind trie for each part that is left
        i = todo[np.argsort(start[todo], kind="stable")]
        cut = np.flatnonzero(turns(start[i]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(i)]):
            at = int(start[i[a]])
            order[at : at + b - a] = blind_trie(strings, i[a:b].tolist())
    size = np.fromiter(map(len, strings), np.int64, n)
    common = np.full(n, -1, np.int64)
    for lo in range(1, n, 65536):
        x, y = order[lo : lo + 65536], order[lo - 1 : lo - 1 + len(order[lo : lo + 65536])]
        differ = matrix[x] != matrix[y]
        far = np.where(differ.any(axis=1), differ.argmax(axis=1), cols)
        common[lo : lo + 65536] = np.where(group[x] == group[y], np.minimum(far, np.minimum(size[x], size[y])), -1)
    return order, common


def repeated_windows(runs: list[tuple[bytes, int, int]], length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Of distinct runs (bytes, least and most distance of a window's start before the anchor): a matrix by run and
    distance, true where the window of that distance is also in another run."""
    width = length - anchor + 1
    ids: dict[bytes, int] = {}
    group = np.array([ids.setdefault(d[most : most + anchor], len(ids)) for d, _, most in runs], np.int64)
    least, most = (np.array([r[i] for r in runs], np.int64) for i in (1, 2))
    right = [d[m + anchor :] for d, _, m in runs]
    left = [d[:m][::-1] for d, _, m in runs]
    out = np.zeros((len(runs), width), bool)
    classes = []
    for strings in (right, left):
        order, common = deep_shallow(strings, group, width)
        place = np.empty(len(runs), np.int64)
        place[order] = np.arange(len(runs))
        classes.append((place, common))
    (rp, rc), (lp, lc) = classes
    for d in range(width):
        live = np.flatnonzero((least <= d) & (d <= most))
        if len(live) < 2:
            continue
        code = np.cumsum(rc < length - anchor - d)[rp[live]] * (len(runs) + 1) + np.cumsum(lc < d)[lp[live]]
        order = np.argsort(code, kind="stable")
        same = np.concatenate(([False], code[order][1:] == code[order][:-1]))
        out[live[order[same | np.append(same[1:], False)]], d] = True
    return out


_RUN = ["key", "data", "least", "most", "n", "id", "h", "at", "end"]


def _runs(docs: DataFrame, keys: DataFrame, length: int, anchor: int) -> DataFrame:
    """Runs of the documents whose anchors are in the document's ``keys``.

    Runs that a task meets more than once (in 24 MB of runs) are repeated: their places come out at once as merged spans (data null), and
    the run itself without a place (n = 2).
    """
    id_type = docs.schema["id"].dataType
    kinds = [T.LongType(), T.BinaryType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), id_type, T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(_RUN, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), None, pa.int64(), pa.int64(), pa.int64()]

        def flush(seen: dict, again: list) -> pa.RecordBatch:
            rows: list[tuple] = []
            for (data, most), v in seen.items():
                key, least, times, name, h, at = v
                rows.append((key, data, least, most, 2, None, None, None, None) if times > 1 else (key, data, least, most, 1, name, h, at, None))
            place: dict[tuple, list] = {}
            for name, h, at, end in again:
                place.setdefault((name, h), []).append((at, end))
            for (name, h), spans in place.items():
                rows += [(h, None, None, None, None, name, h, a, e) for a, e in merge(spans)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_RUN)

        seen: dict[tuple[bytes, int], list] = {}
        again: list[tuple] = []
        size = 0
        for b in batches:
            types[5] = b.schema.field(0).type
            for name, h, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3)):
                place, key, first, last = anchors(text, length, anchor)
                want = np.sort(wanted.values.to_numpy())
                hit = np.flatnonzero(want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key)
                for k, a, s, e in zip(key[hit].tolist(), place[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                    of = (text[s : e + length], a - s)
                    v = seen.get(of)
                    if v is None:
                        seen[of] = [k, a - e, 1, name, h, s]
                        size += e - s + length
                    else:
                        if v[2] == 1:
                            again.append((v[3], v[4], v[5], v[5] + len(of[0])))
                        v[2] = 2
                        again.append((name, h, s, s + len(of[0])))
                if size > 24_000_000 or len(again) > 500_000:
                    yield flush(seen, again)
                    seen, again, size = {}, [], 0
        if types[5] is not None:
            yield flush(seen, again)

    joined = docs.join(keys, (docs.id.eqNullSafe(keys.kid)) & (docs.h == keys.kh)).select(docs.id, docs.h, "text", "keys")
    return joined.mapInArrow(run, schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _resolve(rows: list[tuple], length: int, anchor: int) -> list[tuple]:
    """(id, h, at, end) of the repeated windows of runs, all runs of their anchors being among them."""
    index: dict[tuple[bytes, int], int] = {}
    which = [index.setdefault((r[1], r[3]), len(index)) for r in rows]
    times = np.bincount(which, weights=[r[4] for r in rows], minlength=len(index))
    first: dict[int, tuple] = {}
    for w, r in zip(which, rows):
        first.setdefault(w, r)
    keys = np.array([first[i][0] for i in range(len(index))], np.int64)
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(count[back] > 1)
    spans: dict[int, list[tuple[int, int]]] = {}
    if (times[open_] < 2).any():
        found = repeated_windows([(first[i][1], first[i][2], first[i][3]) for i in open_.tolist()], length, anchor)
        for i, line in zip(open_.tolist(), found):
            if times[i] < 2 and line.any():
                start = first[i][3] - np.flatnonzero(line)
                spans[i] = merge([(int(s), int(s) + length) for s in start])
    out = []
    for w, r in zip(which, rows):
        if r[4] == 1:
            for a, e in [(0, len(r[1]))] if times[w] >= 2 else spans.get(w, []):
                out.append((r[5], r[6], r[7] + a, r[7] + e))
    return out


def _sorted_spans(runs: DataFrame, length: int, anchor: int) -> DataFrame:
    schema = T.StructType([runs.schema[c] for c in ("id", "h", "at", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

        for b in batches:
            kinds = kinds or [b.schema.field(i).type for i in range(5, 9)]
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            done = [r[5:] for r in rows if r[1] is None]
            if done:
                yield batch(done)
            held += [r for r in rows if r[1] is not None]
            if len(held) >= 20_000:
                last, cut = held[-1][0], len(held)
                while cut and held[cut - 1][0] == last:
                    cut -= 1
                if cut:
                    yield batch(_resolve(held[:cut], length, anchor))
                    held = held[cut:]
        if held:
            yield batch(_resolve(held, length, anchor))

    return runs.select(*_RUN).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _hot_spans(runs: DataFrame, length: int) -> DataFrame:
    """The same for runs of hot anchors, by counts with map-side sums instead of gathering an anchor's runs."""
    done = runs.where("data IS NULL").select("id", "h", "at", "end")
    rows = runs.where("data IS NOT NULL")
    kinds = rows.groupBy("data", "most").agg(F.sum("n").alias("times"), F.min("least").alias("least"))
    placed = rows.where("n = 1").select("data", "most", "id", "h", "at").join(kinds.select("data", "most", "times"), ["data", "most"])
    whole = placed.where("times >= 2").select("id", "h", "at", (F.col("at") + F.octet_length("data")).alias("end"))
    windows = kinds.select("data", "most", "times", F.explode(F.sequence(F.lit(0), F.col("most") - F.col("least"))).alias("off"))
    windows = windows.select(F.md5("data").alias("run"), "most", "times", "off", F.unhex(F.md5(F.expr(f"substring(data, off + 1, {length})"))).alias("digest"))
    twice = windows.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest")
    offs = windows.where("times = 1").join(twice, "digest", "left_semi").groupBy("run", "most").agg(F.collect_list("off").alias("offs"))  # at most 153
    single = placed.where("times = 1").withColumn("run", F.md5("data")).join(offs, ["run", "most"])
    part = single.select("id", "h", "at", F.explode("offs").alias("off")).select("id", "h", (F.col("at") + F.col("off")).alias("at"), (F.col("at") + F.col("off") + length).alias("end"))
    return done.union(whole).union(part)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(documents as id, h, text; id, h, spans): the merged byte spans to remove from each text that has any."""
    docs = bounded_batches(df).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long_ = docs.where(F.octet_length("text") >= length)
    schema = T.StructType([T.StructField("key", T.LongType()), docs.schema["id"], T.StructField("h", T.LongType()), T.StructField("c", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, times = [], []
            for text in as_bytes(b.column(2)):
                k, c = np.unique(anchors(text, length, anchor)[1], return_counts=True)
                keys.append(k)
                times.append(c)
            rows = pa.array(np.repeat(np.arange(b.num_rows), [len(k) for k in keys]))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(times))], names=schema.names)

    found = long_.mapInArrow(counted, schema)
    many = materialise(found.groupBy("key").agg(F.sum("c").alias("n")).where("n > 1"), "anchors")
    held = materialise(
        found.join(many, "key").groupBy("id", "h").agg(F.array_distinct(F.collect_list(F.when(F.col("n") <= hot, F.col("key")))).alias("cool"), F.array_distinct(F.collect_list(F.when(F.col("n") > hot, F.col("key")))).alias("hot")),
        "anchors-by-document",
    )
    name = lambda c: held.where(F.size(c) > 0).select(F.col("id").alias("kid"), F.col("h").alias("kh"), F.col(c).alias("keys"))
    spans = _sorted_spans(_runs(long_, name("cool"), length, anchor), length, anchor)
    if not many.where(F.col("n") > hot).isEmpty():
        spans = spans.union(_hot_spans(_runs(long_, name("hot"), length, anchor), length))
    return docs, spans.groupBy("id", "h").agg(F.collect_list(F.struct("at", "end")).alias("spans"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, with_kept: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes left).

    Null and empty texts have no bytes; texts under ``length`` bytes lose none.  Rows that repeat a text of that
    length or more lose all of it, whatever their ids.  Null ids stay null; an empty table gives no rows.
    """
    docs, spans = repeated_spans(df, id_col, text_col, length, anchor, hot)
    s = spans.select(F.col("id").alias("sid"), F.col("h").alias("sh"), "spans")
    rows = docs.join(s, docs.id.eqNullSafe(s.sid) & (docs.h == s.sh), "left").select(docs.id, "text", "spans")
    schema = T.StructType([T.StructField(id_col, docs.schema["id"].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.BinaryType())] * with_kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, counts = [], []
            for text, found in zip(as_bytes(b.column(1)), b.column(2)):
                v = found.values
                spans = [] if v is None else merge(list(zip(v.field("at").to_pylist(), v.field("end").to_pylist())))
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept.append(b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2])))
                counts.append((len(text), len(text) - len(kept[-1]), len(spans)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), *[pa.array(kept, pa.binary())] * with_kept], names=schema.names
            )

    return rows.mapInArrow(run, schema)
