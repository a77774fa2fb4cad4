"""Token ids written as Re-Pair grammars, one for each shard, and read back by document.

Rows are dealt by ranges of their id and sorted, so the shards, in order of (part, before), hold all documents in
ascending order.  Within a shard frequent id pairs are replaced by nonterminals, many pairs a round: pairs are counted
in hashed bins first and exactly where a bin is full enough, the most frequent get new symbols, and all their
places that don't overlap are replaced at once.  No rule crosses a document's end.  A shard holds its rules by round,
each rule's expansion length, each document's first symbol and the symbols (16 bits each while the symbols fit), so
one document is decoded without the others.

The file format is a Parquet table of shards (part, before, n_tokens, doc_ids, grammar) in the shared folder.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import bounded_batches, new_path
from .token_counts import load

MAGIC = b"RPG1"
END_ID = 1
SHARD_IDS = 1_000_000
BINS = 18
#: ASCII punctuation but the apostrophe.
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Letters below this are composed as they stand.
PLAIN_LETTERS = "\u0130"
_ends: dict[str, np.ndarray] = {}
_known: dict[str, dict[str, bytes]] = {}
_older: dict[str, dict[str, bytes]] = {}


def encode_documents(texts: pa.Array, name: str, cache_words: int = 500_000) -> list[np.ndarray]:
    """Ids of each whole text (null: none), each distinct word being encoded once.

    The tokenizer lower-cases, drops white space and takes nothing across it, so texts are cut at ASCII white space and
    their words made a dictionary by Arrow; ids are looked up for its entries and gathered by its indices.  Two generations of about ``cache_words`` words are remembered."""
    tok, known = load(name)[0], _known.setdefault(name, {})
    kind = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
    marks = [x.content for x in tok.get_added_tokens_decoder().values()]
    texts = texts.fill_null("")
    lower = pc.ascii_lower(texts)
    if marks:  # what only lower case would make a special string stays as it is
        head = os.path.commonprefix(marks)
        hit = pc.match_substring(texts, head) if head and not head.isalpha() and head == head.upper() else pa.array([True] * len(texts))
        lower = pc.if_else(hit, texts, lower)
    lists = pc.ascii_split_whitespace(lower)
    coded = lists.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    older = _older.setdefault(name, {})
    missing = []
    for w in vocabulary:
        if w not in known:
            if w in older:
                known[w] = older[w]
            else:
                missing.append(w)
    _learn(tok, known, missing, marks, name, kind)
    parts = [known[w] for w in vocabulary]
    flat = np.frombuffer(b"".join(parts), kind)
    length = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    start = np.cumsum(length) - length
    index = coded.indices.to_numpy(zero_copy_only=False)
    if len(known) > cache_words:  # two generations: words that don't come again leave with the older one
        _older[name], _known[name] = known, {}
    size = length[index]
    upto = np.cumsum(size)
    ids = flat[np.repeat(start[index] - (upto - size), size) + np.arange(int(size.sum()))]
    cut = np.concatenate(([0], upto))[np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    return np.split(ids, cut[:-1]) if len(cut) else []


def _learn(tok, known: dict[str, bytes], words: list[str], marks: list[str], name: str, kind: type) -> None:
    """Ids of new words into ``known``.

    A word of letters before other characters is its letters and its rest, unless an apostrophe, with which letters go,
    is in it; such units are single pre-tokens, which end with a token that ends a word, so many meet the library as
    one text.  Other words meet it as texts of their own."""
    later: list[tuple[str, str, str]] = []
    single: set[str] = set()
    alone: list[str] = []
    for w in words:
        if w.isalpha():
            core, tail = w, ""
        else:
            core = w.rstrip(PUNCTUATION)
            tail = w[len(core) :]
        if (core.isalpha() or not core) and (core.isascii() or max(core) < PLAIN_LETTERS) and not (tail and any(m in w for m in marks)):
            if tail:
                if core:
                    later.append((w, core, tail))
                single.add(tail)
            if core:
                single.add(core)
        else:
            alone.append(w)
    known[""] = b""
    _encode_alone(tok, known, alone, kind)
    _encode_single(tok, known, [u for u in single if u not in known], name, kind)
    for w, core, tail in later:
        known[w] = known[core] + known[tail]


def _encode_alone(tok, known: dict[str, bytes], units: list[str], kind: type) -> None:
    known.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(units, tok.encode_batch_fast(units, add_special_tokens=False)))


def _ends_word(tok, name: str) -> np.ndarray:
    """For each id whether its token ends a word."""
    if name not in _ends:
        suffix = getattr(tok.model, "end_of_word_suffix", None)
        _ends[name] = np.array([bool(suffix) and (tok.id_to_token(i) or "").endswith(suffix) for i in range(tok.get_vocab_size())])
    return _ends[name]


def _encode_single(tok, known: dict[str, bytes], units: list[str], name: str, kind: type) -> None:
    """Ids of units that are one pre-token each, 256 to a text; a text in which not each unit is one goes unit by unit."""
    ends, width = _ends_word(tok, name), np.dtype(kind).itemsize
    groups = [units[i : i + 256] for i in range(0, len(units), 256)]
    for i in range(0, len(groups), 64):
        for words, e in zip(groups[i : i + 64], tok.encode_batch_fast([" ".join(g) for g in groups[i : i + 64]], add_special_tokens=False)):
            ids = np.array(e.ids, kind)
            at = ((np.flatnonzero(ends[ids]) + 1) * width).tolist()
            if len(at) != len(words) or at[-1] != len(ids) * width:
                _encode_alone(tok, known, words, kind)
                continue
            raw = ids.tobytes()
            known.update((w, raw[a:b]) for w, a, b in zip(words, [0, *at], at))


def repair(seq: np.ndarray, last: np.ndarray, base: int, rounds: int = 6, each: int = 2048, least: int = 24) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, ends of documents, rules by round) of ids below ``base``; ``last`` marks each document's last id.

    Symbols stay below 65,536, so a pair is one 32-bit number; a vocabulary that leaves no room gets no rules."""
    rules: list[np.ndarray] = []
    if base >= 1 << 16:
        return seq.astype(np.uint32), last, rules
    seq, top = seq.astype(np.uint32), base
    for _ in range(rounds):
        room = min(each, (1 << 16) - top)
        if len(seq) < 2 or not room:
            break
        code = (seq[:-1] << np.uint32(16)) | seq[1:]
        bin_ = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS)
        bin_[last[:-1]] = 1 << BINS  # pairs over a document's end
        times = np.bincount(bin_, minlength=(1 << BINS) + 1)
        times[-1] = 0
        may = np.flatnonzero((times >= least)[bin_])
        codes = code[may]
        order = np.sort(codes)
        begin = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1]))) if len(order) else np.empty(0, np.int64)
        count = np.diff(np.append(begin, len(order)))
        best = np.flatnonzero(count >= least)
        if not len(best):
            break
        pairs = order[begin[best[np.lexsort((order[begin[best]], -count[best]))]]][: 2 * room]
        # of pairs that share a bin the most frequent is taken
        where = (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS)
        pairs = pairs[np.sort(np.unique(where, return_index=True)[1])][:room]
        symbol = np.full((1 << BINS) + 1, -1, np.int32)
        symbol[(pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS)] = np.arange(len(pairs))
        at = symbol[bin_[may]]
        chosen = (at >= 0) & (pairs[at] == codes)
        place, at = may[chosen], at[chosen]
        # where chosen pairs overlap, every other one of the chain from its start
        index = np.arange(len(place))
        head = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(place) != 1)), index, 0))
        free = ((index - head) & 1) == 0
        place, at = place[free], at[free]
        seq[place] = top + at
        gone = np.ones(len(seq), bool)
        gone[place + 1] = False
        last = last.copy()
        last[place] = last[place + 1]
        seq, last = seq[gone], last[gone]
        rules.append(np.stack((pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)), axis=1).astype(np.uint32))
        top += len(pairs)
    return seq, last, rules


def pack(ids: list[np.ndarray], base: int) -> bytes:
    """A shard's grammar from the ids of its documents (each with at least one id)."""
    sizes = np.array([len(x) for x in ids], np.int64)
    last = np.zeros(int(sizes.sum()), bool)
    last[np.cumsum(sizes) - 1] = True
    seq, last, rules = repair(np.concatenate(ids) if ids else np.empty(0, np.uint32), last, base)
    length = np.ones(base, np.int64)
    for r in rules:
        length = np.concatenate((length, length[r[:, 0]] + length[r[:, 1]]))
    ends = np.flatnonzero(last) + 1
    wide = len(length) > 1 << 16
    head = struct.pack("<4sIIII", MAGIC, base, len(rules), len(ids), wide)
    return head + b"".join(
        x.tobytes()
        for x in (
            np.array([len(r) for r in rules], "<u4"), *[r.astype("<u4") for r in rules], length[base:].astype("<u4"),
            np.concatenate(([0], ends)).astype("<u4"), seq.astype("<u4" if wide else "<u2"),
        )
    )


class Shard:
    """A packed grammar; ids(i) gives document i, decoding nothing else of the sequence."""

    def __init__(self, blob: bytes):
        magic, base, n_rounds, n_docs, wide = struct.unpack_from("<4sIIII", blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = 20

        def take(n: int, kind: str = "<u4") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += n * out.itemsize
            return out.astype(np.int64)

        counts = take(n_rounds)
        rules = [take(2 * int(n)).reshape(-1, 2) for n in counts]
        lengths = take(int(counts.sum()))
        self.offsets = take(n_docs + 1)
        self.seq = take(int(self.offsets[-1]), "<u4" if wide else "<u2")
        self.length = np.concatenate((np.ones(base, np.int64), lengths))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.empty(int(self.length.sum()), np.int64)
        self.flat[:base] = np.arange(base)
        top = base
        for r in rules:
            made = self.expand(r.ravel())
            s = self.start[top]
            self.flat[s : s + len(made)] = made
            top += len(r)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.length[symbols]
        shift = self.start[symbols] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))]

    def ids(self, i: int) -> np.ndarray:
        return self.expand(self.seq[self.offsets[i] : self.offsets[i + 1]]).astype("<u4")

    def __len__(self) -> int:
        return len(self.offsets) - 1


def write_tokens(
    df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> str:
    """Write df's texts as token shards and give the path.

    Null and empty texts are the end id alone.  Rows go in ascending order of id (nulls first), rows of one id by a
    hash of the text; repeated rows are written as often.  An empty table gives a table without shards.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("grammar", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        base = load(tokenizer)[0].get_vocab_size()
        names: list = []
        docs: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            rows = [{"part": part, "before": before, "n_tokens": size, "doc_ids": names, "grammar": pack(docs, base)}]
            return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(ids_type)), ("grammar", pa.binary())]))

        for b in batches:
            ids_type = b.schema.field(0).type
            keys = b.column(0).to_pylist()
            for lo in range(0, b.num_rows, 2048):
                for key, ids in zip(keys[lo : lo + 2048], encode_documents(b.column(1).slice(lo, 2048), tokenizer)):
                    docs.append(np.append(ids, end_id).astype(np.uint32))
                    names.append(key)
                    size += len(ids) + 1
                    if size >= shard_ids:
                        yield shard()
                        before, size, docs, names = before + size, 0, [], []
        if docs:
            yield shard()
        _older.pop(tokenizer, None)

    path = path or new_path(df.sparkSession, "tokens")
    rows = bounded_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(run, schema).write.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per written document: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    id_type = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, doc_ids, blob in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2), b.column(3)):
                s = Shard(blob.as_py())
                all_ids = s.expand(s.seq).astype("<u4")
                ends = np.cumsum(s.length[s.seq])[s.offsets[1:] - 1]
                sizes = np.diff(np.concatenate(([0], ends)))
                raw = memoryview(all_ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(s), pa.int32()), pa.array(before + ends - sizes), doc_ids.values, pa.array(sizes), pa.array(crc, pa.int64())], names=schema.names
                )

    docs = shards.select("part", "before", "doc_ids", "grammar").mapInArrow(run, schema)
    # one row for each part: as many as the write had tasks
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    firsts = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    return docs.join(firsts, "part").select(id_col, (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Write df's token shards to the shared folder and give the per-document rows read back from them."""
    return read_tokens(df.sparkSession, write_tokens(df, None, id_col, text_col, tokenizer), id_col)
